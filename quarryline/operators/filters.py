"""Predicates, normalisation and case rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; null keys match nothing. Spark broadcasts ``ids`` only if its size allows."""
    return rows.join(ids.select(key), key, "left_semi")


def non_empty(array: Column) -> Column:
    """True for arrays with an element; null and empty are false."""
    return F.coalesce(F.size(array) > 0, F.lit(False))


def id_slice(rows: DataFrame, key: str, pattern: str, start: int, stop: int) -> DataFrame:
    """Rows whose id begins with ``pattern``, positions ``start`` to ``stop`` in order of the id.

    The order is taken by a top-k of ``stop`` rows, never by a window over all rows.
    """
    first = rows.filter(F.col(key).rlike(f"^(?:{pattern})")).orderBy(key).limit(stop)
    return first if start == 0 else first.offset(start)


def matches_repo(full_name: Column, filters: Sequence[str]) -> Column:
    """A filter with a slash is part of the full name; one without is part of the short name, or the other way round."""
    name, short = F.lower(full_name), F.lower(F.substring_index(full_name, "/", -1))
    hit = F.lit(False)
    for f in (x.strip().lower() for x in filters):
        if f:
            hit = hit | (name.contains(f) if "/" in f else (short.contains(f) | (F.lit(f).contains(short) & (short != ""))))
    return hit


def resolve_aliases(rows: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each target is the first of its names that is not null; names that are not columns are passed over."""
    have = set(rows.columns)
    out = {t: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None).cast("string") for t, names in aliases.items()}
    used = {n for names in aliases.values() for n in names}
    return rows.select(*[c for c in rows.columns if c not in used and c not in out], *[x.alias(t) for t, x in out.items()])


def id_text(x: Column) -> Column:
    """Ids of any type as trimmed text, so that 7, "7" and " 7" are the same."""
    return F.trim(x.cast("string"))


def plain(x: Column) -> Column:
    """Lower case without outer spaces; null as empty."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def first_by_precedence(values: Column, order: Sequence[str], other: str) -> Column:
    """The value of an array that stands first in ``order``; ``other`` if none does."""
    out = F.when(F.lit(False), "")
    for v in order:
        out = out.when(F.coalesce(F.array_contains(values, v), F.lit(False)), v)
    return out.otherwise(other)


def bucket(value: Column, groups: Mapping[str, Sequence[str]], other: str) -> Column:
    """The name of the group that holds the value."""
    out = F.when(F.lit(False), "")
    for name, members in groups.items():
        out = out.when(value.isin(*members), name)
    return out.otherwise(other)


def first_rule(text: Column, exact: Mapping[str, str], patterns: Sequence[tuple[str, str]]) -> Column:
    """The reason of the first rule that holds: exact texts first, then patterns in order; else null."""
    out = F.when(F.lit(False), "")
    for t, reason in exact.items():
        out = out.when(F.lower(F.trim(text)) == t.lower(), reason)
    for p, reason in patterns:
        out = out.when(text.rlike(f"(?i){p}"), reason)
    return out.otherwise(None)


def partition_array(items: Column, why: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(kept elements, excluded as structs of name and reason); ``why`` maps an element to its reason or null."""
    kept = F.filter(items, lambda x: x.isNotNull() & why(x).isNull())
    out = F.transform(F.filter(items, lambda x: why(x).isNotNull()), lambda x: F.struct(x.alias("name"), why(x).alias("reason")))
    return kept, out


def ends_valid(array: Column, first: Callable[[Column], Column], last: Callable[[Column], Column]) -> Column:
    """Whether the first and the last element meet their predicates; false for empty and null."""
    return F.coalesce(first(F.try_element_at(array, F.lit(1))) & last(F.try_element_at(array, F.lit(-1))), F.lit(False))


def clean_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct trimmed keys, rows with a null or blank key dropped."""
    out = rows.select(*[F.trim(k).alias(k) for k in keys])
    for k in keys:
        out = out.filter(F.col(k) != "")
    return out.distinct()


def rename_in_array(array: Column, names: Mapping[str, str]) -> Column:
    """Structs of an array with the fields ``names`` (new name to old name), in this order."""
    return F.transform(array, lambda x: F.struct(*[x[old].alias(new) for new, old in names.items()]))


#: Roles of files by what their path holds (tests) or ends with, in order. The endings of config are fixed values.
ROLES = {"test": ("/test_", "/tests/", "_test."), "config": (".toml", ".ini", ".cfg", ".yaml", ".yml", ".json"), "docs": (".md", ".rst", ".txt"), "code": (".py", ".ts", ".js", ".java", ".go", ".rs")}


def file_role(path: Column, roles: Mapping[str, Sequence[str]] = ROLES) -> Column:
    """The first role that fits, else other."""
    p = F.concat(F.lit("/"), F.lower(path))
    out = F.when(path.isNull(), None)
    for role, marks in roles.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | (p.contains(m) if role == "test" else p.endswith(m))
        out = out.when(hit, role)
    return out.otherwise("other")


def band_counts(rows: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """band, low, n: how many values fall in each band [edge, next edge); bands without rows have 0.

    The bands are a list of parameters: one fixed aggregate per band, no join.
    """
    spans = list(zip(edges, edges[1:], strict=False))
    counts = rows.agg(*[F.count_if((value >= a) & (value < b)).alias(f"b{i}") for i, (a, b) in enumerate(spans)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("low"), F.col(f"b{i}").alias("n")) for i, (a, _) in enumerate(spans)])).alias("x")).select("x.*")


def looks_like_path(text: Column, suffixes: Sequence[str]) -> Column:
    """A reference to a file: no blanks or shell signs, and a slash or a known suffix."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.lower(text).endswith(s)
    return F.coalesce(~text.rlike(r"[\s|&;<>$`]") & ~text.contains("://") & (text.contains("/") | ends), F.lit(False))


def fits_window(used: Column, asked: Column, window: Column | int, most_reserve: int = 10_000, share: float = 0.02) -> Column:
    """Whether both parts and a reserve of a share of the window, at most ``most_reserve``, fit the window."""
    w = window if isinstance(window, Column) else F.lit(window)
    return used + asked + F.least(F.lit(most_reserve), F.floor(w * share)) <= w


def has_both(text: Column, a: Sequence[str], b: Sequence[str]) -> Column:
    """Whether words of both lists occur."""
    return F.coalesce(F.lower(text).rlike("|".join(a)) & F.lower(text).rlike("|".join(b)), F.lit(False))
