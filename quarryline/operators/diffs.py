"""Unified diffs: paths, counts, sections, line-numbered changes.

What a pattern can do stays in the JVM. The line-numbered parse is a state machine over the lines of one
diff, run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.joins import import_match

_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
CHANGE = "struct<path:string, old_path:string, line:int, old_line:int, before:string, after:string, change_type:string>"
CHANGES = f"array<{CHANGE}>"


def changed_paths(diff: Column) -> Column:
    """Destination paths of the headers, distinct, in order. Paths may hold blanks: the header is cut at " b/" after the source."""
    found = F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/.*? b/([^\r\n]+?)\s*$"), F.lit(1))
    return F.array_distinct(found)


def source_paths(diff: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.*?) b/"), F.lit(1)))


def line_counts(diff: Column) -> Column:
    """struct<added, deleted, files>; header lines are not counted."""
    count = lambda p: F.regexp_count(diff, F.lit(p))
    return F.struct(count(r"(?m)^\+(?!\+\+ )").alias("added"), count(r"(?m)^-(?!-- )").alias("deleted"), count(r"(?m)^diff --git ").alias("files"))


def sections(diff: Column) -> Column:
    """File sections, each from its header to before the next; what comes before the first header is left out."""
    return F.filter(F.split(diff, r"(?m)^(?=diff --git )"), lambda s: s.startswith("diff --git "))


def section_path(section: Column) -> Column:
    return F.regexp_extract(section, r"^diff --git a/.*? b/([^\r\n]+?)\s*(?:\r?\n|$)", 1)


def drop_sections(diff: Column, wanted: Callable[[Column], Column]) -> Column:
    """The diff without the sections for which ``wanted(path)`` is false."""
    return F.array_join(F.filter(sections(diff), lambda s: wanted(section_path(s))), "")


def hunk_lines(section: Column) -> Column:
    """Lines of a section from its first hunk on."""
    return F.split(F.regexp_extract(section, r"(?s)\n(@@ .*)$", 1), "\n")


def whitespace_only(section: Column) -> Column:
    """Whether removed and added lines are the same without blanks, pair by pair."""
    lines = hunk_lines(section)
    strip = lambda mark: F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.regexp_replace(F.substr(x, F.lit(2)), r"\s+", ""))
    old, new = strip("-"), strip("+")
    return (F.size(old) + F.size(new) > 0) & (old == new)


#: Tags of a file's diff, by what its text (or its text in lower case) holds and what its path ends with or holds.
TEXT_TAGS = {"definitions": ("def ", "class "), "type_hints": ("-> ",)}
LOWER_TAGS = {"imports": ("import", "from "), "returns": ("return",), "assertions": ("assert",)}
PATH_ENDS = {"config": (".toml", ".ini", ".cfg", ".yaml", ".yml", ".json"), "dependencies": (".txt", ".lock"), "docs": (".md",)}
PATH_PARTS = {"tests": "test", "docs": "readme"}


def change_tags(section: Column, path: Column) -> Column:
    """Tags of one file section in order of their names; ``code`` alone where no rule holds."""
    low, low_path = F.lower(section), F.lower(path)
    any_of = lambda hits: reduce(lambda a, b: a | b, hits)
    rules = {t: any_of(section.contains(m) for m in marks) for t, marks in TEXT_TAGS.items()}
    rules |= {t: any_of(low.contains(m) for m in marks) for t, marks in LOWER_TAGS.items()}
    ends = {t: any_of(path.endswith(m) for m in marks) for t, marks in PATH_ENDS.items()}
    rules |= {"config": ends["config"], "dependencies": ends["dependencies"] | path.contains("requirements"), "docs": ends["docs"] | low_path.contains(PATH_PARTS["docs"]), "tests": low_path.contains(PATH_PARTS["tests"])}
    found = F.filter(F.array(*[F.when(rules[t], F.lit(t)) for t in sorted(rules)]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("code")))


#: Fixed value: what an added line imports.
IMPORTED = r"(?:from\s+[.\w]+\s+)?import\s+([\w.\s,]+)"


def imported_names(section: Column) -> Column:
    """Names that the added lines of a section import, without their aliases; private ones are left out."""
    lines = F.filter(F.split(section, "\n"), lambda x: x.startswith("+") & x.contains("import "))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_extract(x, IMPORTED, 1), ",")))
    plain = F.transform(names, lambda n: F.regexp_replace(F.split(F.regexp_replace(n, r"^\s+|\s+$", ""), " as ")[0], r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(plain, lambda n: (n != "") & ~n.startswith("_")))


def module_names(path: Column) -> Column:
    """The dotted name of a Python file and its last part; none for other files."""
    whole = F.regexp_replace(F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")), r"^[./]+|[./]+$", "")
    return F.when(path.endswith(".py"), F.array_distinct(F.array(whole, F.substring_index(whole, ".", -1)))).otherwise(F.array().cast("array<string>"))


def import_graph(sections: DataFrame) -> DataFrame:
    """diff_id, name, src, dst: files of a diff that import another one of it, from (diff_id, section_pos, path, section).

    Where several files have a module name, the last one in the diff has it."""
    files = sections.select("diff_id", "section_pos", "path", F.explode(module_names(F.col("path"))).alias("module"))
    modules = files.groupBy("diff_id", "module").agg(F.max_by("path", "section_pos").alias("dst"))
    imports = sections.filter(F.col("path").endswith(".py")).select("diff_id", F.col("path").alias("src"), F.explode(imported_names(F.col("section"))).alias("name"))
    return import_match(imports, modules, ["diff_id"], "name", "module").filter("src <> dst").select("diff_id", "name", "src", "dst").distinct()


def added_imports(diff: Column) -> Column:
    """Modules that added lines import."""
    lines = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^\+\s*(?:import|from)\s+[\w.]+"))
    return F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^\+\s*(?:import|from)\s+([\w.]+)", 1)))


def looks_corrupt(message: Column) -> Column:
    """Whether an error message names a corrupt or an empty patch; null names nothing."""
    low = F.lower(message)
    return F.coalesce(low.contains("corrupt patch") | low.contains("no valid patches in input"), F.lit(False))


#: What any diff holds.
MARKERS = ("diff --git", "@@", "---", "+++", "index ")


def extracted_patches(rows: DataFrame) -> DataFrame:
    """id, repo, sha_fail, diff, marked: the patches of records under any of their names, unchanged.

    The repository is ``repo`` or owner and name, the diff the first of ``diff`` and ``diff_fix`` that is not empty. Records without a repository or with a
    blank diff are left out; ``marked`` is false where the text has nothing of a diff."""
    have = set(rows.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    repo = F.coalesce(col("repo"), F.concat(col("repo_owner"), F.lit("/"), col("repo_name")))
    diff = F.coalesce(F.when(col("diff") != "", col("diff")), col("diff_fix"))
    out = rows.select(F.col("id").cast("string").alias("id"), repo.alias("repo"), F.col("sha_fail").cast("string").alias("sha_fail"), diff.alias("diff"))
    marked = reduce(lambda a, b: a | b, [F.col("diff").contains(m) for m in MARKERS])
    return out.filter(F.col("repo").isNotNull() & F.col("diff").rlike(r"\S")).withColumn("marked", marked)


def parse(text: str | None, compat: bool = False) -> list[dict]:
    """Changes of a diff with both line numbers.

    A removed line directly followed by an added one is one modification. ``compat`` numbers as an older
    parser did: a modification does not move the line number of the new file on.
    """
    if not text:
        return []
    out, path, old_path, old, new = [], None, None, 0, 0
    lines = text.split("\n")
    i, in_hunk = 0, False
    while i < len(lines):
        line = lines[i]
        if line.startswith("diff --git "):
            in_hunk = False
            m = re.match(r"diff --git a/(.*?) b/(.+?)\s*$", line)
            old_path, path = (m[1], m[2]) if m else (None, None)
        elif (m := _HUNK.match(line)) is not None:
            old, new, in_hunk = int(m[1]), int(m[2]), True
        elif in_hunk and line.startswith("-"):
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if after.startswith("+"):
                out.append({"path": path, "old_path": old_path, "line": new, "old_line": old, "before": line[1:], "after": after[1:], "change_type": "modified"})
                old, new, i = old + 1, new + (not compat), i + 1
            else:
                out.append({"path": path, "old_path": old_path, "line": new, "old_line": old, "before": line[1:], "after": "", "change_type": "deleted"})
                old += 1
        elif in_hunk and line.startswith("+"):
            out.append({"path": path, "old_path": old_path, "line": new, "old_line": old, "before": "", "after": line[1:], "change_type": "added"})
            new += 1
        elif in_hunk and not line.startswith("\\"):
            old, new = old + 1, new + 1
        i += 1
    return out


def parsed_changes(diff: Column, compat: bool = False) -> Column:
    @F.pandas_udf(CHANGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: parse(t, compat))

    return run(diff)


def change_kinds(changes: Column) -> Column:
    """struct<added, deleted, modified> of parsed changes."""
    of = lambda k: F.size(F.filter(changes, lambda c: c["change_type"] == k))
    return F.struct(*[of(k).alias(k) for k in ("added", "deleted", "modified")])


def apply_section(source: str, section: str) -> str:
    """The source with the hunks of one file section applied, by their old line numbers."""
    old = source.split("\n")
    out, at, left = [], 0, False
    for line in section.split("\n"):
        if (m := _HUNK.match(line)) is not None:
            start = max(int(m[1]) - 1, 0)
            out += old[at:start]
            at, left = start, True
        elif left and line.startswith("-"):
            at += 1
        elif left and line.startswith("+"):
            out.append(line[1:])
        elif left and not line.startswith("\\"):
            out.append(old[at] if at < len(old) else line[1:])
            at += 1
    return "\n".join(out + old[at:])


def applied(source: Column, section: Column) -> Column:
    @F.pandas_udf("string")
    def run(sources: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or p is None else apply_section(s, p) for s, p in zip(sources, parts, strict=True)])

    return run(source, section)


CONFLICT = ("<<<<<<<", "=======", ">>>>>>>")


def _shared(x: list[str], y: list[str]) -> list[tuple[int, int, int]]:
    """(place in x, in y, length) of runs of equal lines, in order: what both begin and end with, and matches between."""
    most = min(len(x), len(y))
    head = next((i for i in range(most) if x[i] != y[i]), most)
    tail = next((i for i in range(most - head) if x[-1 - i] != y[-1 - i]), most - head)
    between = SequenceMatcher(None, x[head : len(x) - tail], y[head : len(y) - tail], autojunk=False).get_matching_blocks()
    runs = [(0, 0, head), *[(m.a + head, m.b + head, m.size) for m in between], (len(x) - tail, len(y) - tail, tail)]
    return [r for r in runs if r[2]]


def _synced(base: list[str], a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(place in base, in a, in b, length) of the runs of lines that all three share, in order."""
    left, right, out, i, k = _shared(base, a), _shared(base, b), [], 0, 0
    while i < len(left) and k < len(right):
        (x, in_a, n), (y, in_b, m) = left[i], right[k]
        low, high = max(x, y), min(x + n, y + m)
        if low < high:
            out.append((low, in_a + low - x, in_b + low - y, high - low))
        if x + n <= y + m:
            i += 1
        else:
            k += 1
    return [*out, (len(base), len(a), len(b), 0)]


def merge3(base: str, a: str, b: str) -> tuple[str, int]:
    """Both texts' changes to ``base`` in one, and how many places both changed differently; there both versions stand between marks."""
    base_lines, a_lines, b_lines = base.split("\n"), a.split("\n"), b.split("\n")
    out, conflicts, at, at_a, at_b = [], 0, 0, 0, 0
    for start, start_a, start_b, n in _synced(base_lines, a_lines, b_lines):
        old, one, two = base_lines[at:start], a_lines[at_a:start_a], b_lines[at_b:start_b]
        if one == two or two == old:
            out += one
        elif one == old:
            out += two
        else:
            conflicts += 1
            out += [CONFLICT[0], *one, CONFLICT[1], *two, CONFLICT[2]]
        out += base_lines[start : start + n]
        at, at_a, at_b = start + n, start_a + n, start_b + n
    return "\n".join(out), conflicts


def merged(base: Column, a: Column, b: Column) -> Column:
    """struct<text, conflicts> of two changed versions of a text; null where one of the three is."""

    @F.pandas_udf("struct<text:string, conflicts:int>")
    def run(bases: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        done = [(None, None) if o is None or x is None or y is None else merge3(o, x, y) for o, x, y in zip(bases, ones, twos, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in done], "conflicts": pd.array([c for _, c in done], "Int32")})

    return run(base, a, b)
