"""Queries of diffs, chunking and graphs (D, C and G of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import chunking, graph
from quarryline.operators import diffs as op
from quarryline.operators.text import STOP_WORDS
from quarryline.plans.joins import _EDGES_SQL, file_edges
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

_D = "d AS (SELECT DISTINCT diff_id, diff FROM diff_output WHERE diff IS NOT NULL)"
_LINES = f"{_D}, ln AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS l FROM d)"


_SECTIONS = f"""{_D}, lx AS (SELECT diff_id, ls[i] AS l, i FROM (SELECT diff_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM d))),
sx AS (SELECT diff_id, l, i, sum(CASE WHEN starts_with(l, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS sec FROM lx),
se AS (SELECT diff_id, CAST(sec - 1 AS INTEGER) AS section_pos, string_agg(l, chr(10) ORDER BY i) AS section, regexp_replace(regexp_extract(first(l ORDER BY i), '^diff --git a/.*? b/(.+)$', 1), '\\s+$', '') AS path FROM sx WHERE sec > 0 GROUP BY 1, 2)"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "diff_output").filter("diff is not null").select("diff_id", "diff").distinct()


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff_id, section_pos, path, section."""
    s = _diffs(spark, sf_dir).select("diff_id", F.posexplode(op.sections(F.col("diff"))).alias("section_pos", "section"))
    return s.select("diff_id", "section_pos", op.section_path(F.col("section")).alias("path"), "section")


@_R.add("d01_changed_paths", f"WITH {_LINES}, p AS (SELECT diff_id, trim(regexp_replace(regexp_extract(l, '^diff --git a/.*? b/(.+)$', 1), '\\s+$', '')) AS path FROM ln WHERE starts_with(l, 'diff --git a/')) SELECT d.diff_id, list_sort(coalesce(list(DISTINCT p.path) FILTER (p.path <> ''), [])) AS paths FROM d LEFT JOIN p ON d.diff_id = p.diff_id GROUP BY d.diff_id")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("diff_id", F.array_sort(op.changed_paths(F.col("diff"))).alias("paths"))


@_R.add("d02_line_counts", f"WITH {_LINES} SELECT diff_id, count(*) FILTER (starts_with(l, '+') AND NOT starts_with(l, '+++ ')) AS added, count(*) FILTER (starts_with(l, '-') AND NOT starts_with(l, '--- ')) AS deleted, count(*) FILTER (starts_with(l, 'diff --git ')) AS files FROM ln GROUP BY 1")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _diffs(spark, sf_dir).select("diff_id", op.line_counts(F.col("diff")).alias("c"))
    return c.select("diff_id", *[F.col(f"c.{n}").cast("bigint").alias(n) for n in ("added", "deleted", "files")])


_NUMBERED = f"""{_D}, lx AS (SELECT diff_id, ls[i] AS l, i FROM (SELECT diff_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM d))),
sx AS (SELECT *, sum(CASE WHEN starts_with(l, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS sec, regexp_extract(l, '^@@ -([0-9]+)(?:,[0-9]+)? [+]([0-9]+)(?:,[0-9]+)? @@', ['o', 'n']) AS h FROM lx),
hx AS (SELECT *, sum(CASE WHEN h.o <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id, sec ORDER BY i) AS hunk, lead(l) OVER (PARTITION BY diff_id ORDER BY i) AS nxt, lag(l) OVER (PARTITION BY diff_id, sec ORDER BY i) AS prv FROM sx),
nx AS (SELECT *, first(h.o) OVER w AS o0, first(h.n) OVER w AS n0, sum(CASE WHEN h.o = '' AND NOT starts_with(l, '+') AND NOT starts_with(l, chr(92)) THEN 1 ELSE 0 END) OVER w AS oc, sum(CASE WHEN h.o = '' AND NOT starts_with(l, '-') AND NOT starts_with(l, chr(92)) THEN 1 ELSE 0 END) OVER w AS nc,
  regexp_extract(first(l) OVER (PARTITION BY diff_id, sec ORDER BY i), '^diff --git a/(.*?) b/(.+?)\\s*$', ['a', 'b']) AS p FROM hx WINDOW w AS (PARTITION BY diff_id, sec, hunk ORDER BY i))"""


@_R.add(
    "d03_changes",
    f"""WITH {_NUMBERED}
SELECT diff_id, CASE WHEN sec > 0 THEN p.b END AS path, CASE WHEN sec > 0 THEN p.a END AS old_path, CAST(CAST(n0 AS INTEGER) + nc - CASE WHEN starts_with(l, '+') THEN 1 ELSE 0 END AS INTEGER) AS line, CAST(CAST(o0 AS INTEGER) + oc - CASE WHEN starts_with(l, '-') THEN 1 ELSE 0 END AS INTEGER) AS old_line,
  CASE WHEN starts_with(l, '-') THEN l[2:] ELSE '' END AS before, CASE WHEN starts_with(l, '+') THEN l[2:] WHEN starts_with(nxt, '+') THEN nxt[2:] ELSE '' END AS after,
  CASE WHEN starts_with(l, '+') THEN 'added' WHEN starts_with(nxt, '+') THEN 'modified' ELSE 'deleted' END AS change_type
FROM nx WHERE hunk > 0 AND h.o = '' AND (starts_with(l, '-') OR (starts_with(l, '+') AND NOT starts_with(coalesce(prv, ''), '-')))""",
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-numbered changes of every diff."""
    return _diffs(spark, sf_dir).select("diff_id", F.explode(op.parsed_changes(F.col("diff"))).alias("c")).select("diff_id", "c.*")


@_R.add(
    "d05_whitespace_only",
    f"""WITH {_SECTIONS}, b AS (SELECT diff_id, section_pos, path, string_split(regexp_extract(section, '(?s)\\n(@@ .*)$', 1), chr(10)) AS ls FROM se),
c AS (SELECT diff_id, path, list_transform(list_filter(ls, lambda x: starts_with(x, '-')), lambda x: regexp_replace(x[2:], '\\s+', '', 'g')) AS o, list_transform(list_filter(ls, lambda x: starts_with(x, '+')), lambda x: regexp_replace(x[2:], '\\s+', '', 'g')) AS n FROM b)
SELECT diff_id, path, len(o) + len(n) > 0 AND o = n AS whitespace_only FROM c""",
)
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _diffs(spark, sf_dir).select("diff_id", F.explode(op.sections(F.col("diff"))).alias("s"))
    return s.select("diff_id", op.section_path(F.col("s")).alias("path"), op.whitespace_only(F.col("s")).alias("whitespace_only"))


@_R.add("d06_applied", "SELECT doc_id, 'new' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section that puts a line before the first one, applied to every text."""
    first = F.split("text", "\n", 2)[0]
    section = F.concat(F.lit("@@ -1,1 +1,2 @@\n-"), first, F.lit("\n+new\n+"), first)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.applied(F.col("text"), section).alias("text"))


@_R.add(
    "d07_without_workflows",
    f"""WITH {_SECTIONS}, m AS (SELECT diff_id, max(section_pos) AS top FROM se GROUP BY 1),
k AS (SELECT se.diff_id, string_agg(section || CASE WHEN section_pos < top THEN chr(10) ELSE '' END, '' ORDER BY section_pos) FILTER (NOT starts_with(path, '.github/')) AS kept FROM se JOIN m ON se.diff_id = m.diff_id GROUP BY 1)
SELECT d.diff_id, coalesce(kept, '') AS kept, CAST(length(diff) - length(coalesce(kept, '')) AS INTEGER) AS dropped_chars FROM d LEFT JOIN k ON d.diff_id = k.diff_id""",
)
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs without their workflow sections."""
    kept = op.drop_sections(F.col("diff"), lambda p: ~p.startswith(".github/"))
    return _diffs(spark, sf_dir).select("diff_id", kept.alias("kept"), (F.length("diff") - F.length(kept)).alias("dropped_chars"))


@_R.add("d09_sections", f"WITH {_LINES.replace('unnest(string_split(diff, chr(10))) AS l FROM d', 'ls[i] AS l, i FROM (SELECT diff_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM d))')}, s AS (SELECT diff_id, l, sum(CASE WHEN starts_with(l, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS sec FROM ln) SELECT diff_id, CAST(sec - 1 AS INTEGER) AS section_pos, count(*) FILTER (starts_with(l, '@@ ')) AS hunks FROM s WHERE sec > 0 GROUP BY 1, 2")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _diffs(spark, sf_dir).select("diff_id", F.posexplode(op.sections(F.col("diff"))).alias("section_pos", "s"))
    return s.select("diff_id", "section_pos", F.regexp_count("s", F.lit("(?m)^@@ ")).cast("bigint").alias("hunks"))


@_R.add("d10_patches_per_file_name", f"WITH {_LINES}, p AS (SELECT DISTINCT diff_id, regexp_replace(regexp_extract(l, '^diff --git a/.*? b/(.+)$', 1), '\\s+$', '') AS path FROM ln WHERE starts_with(l, 'diff --git a/')) SELECT split_part(path, '/', -1) AS name, count(*) AS n FROM p WHERE path <> '' GROUP BY 1 HAVING count(*) > 1")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _diffs(spark, sf_dir).select("diff_id", F.explode(op.changed_paths(F.col("diff"))).alias("path"))
    return paths.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@_R.add(
    "d11_change_tags",
    f"""WITH {_SECTIONS}, t AS (SELECT diff_id, section_pos, path, [
  CASE WHEN contains(lower(section), 'assert') THEN 'assertions' END, CASE WHEN regexp_matches(path, '[.](toml|ini|cfg|yaml|yml|json)$') THEN 'config' END, CASE WHEN contains(section, 'def ') OR contains(section, 'class ') THEN 'definitions' END,
  CASE WHEN regexp_matches(path, '[.](txt|lock)$') OR contains(path, 'requirements') THEN 'dependencies' END, CASE WHEN ends_with(path, '.md') OR contains(lower(path), 'readme') THEN 'docs' END,
  CASE WHEN contains(lower(section), 'import') OR contains(lower(section), 'from ') THEN 'imports' END, CASE WHEN contains(lower(section), 'return') THEN 'returns' END, CASE WHEN contains(lower(path), 'test') THEN 'tests' END,
  CASE WHEN contains(section, '-> ') THEN 'type_hints' END] AS a FROM se)
SELECT diff_id, section_pos, path, CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) > 0 THEN list_filter(a, lambda x: x IS NOT NULL) ELSE ['code'] END AS tags FROM t""",
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("diff_id", "section_pos", "path", op.change_tags(F.col("section"), F.col("path")).alias("tags"))


@_R.add("d12_summary_lines", "SELECT diff_id, list_sort(list(file_type || ' ' || path || ' ' || coalesce(total_changes, 0)))[1:30] AS lines FROM parsed_file WHERE path IS NOT NULL AND file_type IS NOT NULL GROUP BY 1")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", "file_type", "path", F.coalesce("total_changes", F.lit(0)).cast("string"))
    return table(spark, sf_dir, "parsed_file").filter("path is not null and file_type is not null").groupBy("diff_id").agg(F.slice(F.array_sort(F.collect_list(line)), 1, 30).alias("lines"))


@_R.add("d13_added_imports", f"WITH {_LINES} SELECT diff_id, regexp_extract(l, '^\\+\\s*(?:import|from)\\s+([\\w.]+)', 1) AS module_name, count(*) AS n FROM ln WHERE regexp_matches(l, '^\\+\\s*(?:import|from)\\s+[\\w.]+') GROUP BY 1, 2 HAVING count(*) >= 1")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _diffs(spark, sf_dir).select("diff_id", F.explode(F.split("diff", "\n")).alias("l")).filter(F.col("l").rlike(r"^\+\s*(?:import|from)\s+[\w.]+"))
    return lines.groupBy("diff_id", F.regexp_extract("l", r"^\+\s*(?:import|from)\s+([\w.]+)", 1).alias("module_name")).agg(F.count("*").alias("n"))


@_R.add("d14_corrupt_messages", "SELECT call_id, coalesce(contains(lower(error_text), 'corrupt patch') OR contains(lower(error_text), 'no valid patches in input'), false) AS corrupt FROM llm_call_record")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "llm_call_record").select("call_id", op.looks_corrupt(F.col("error_text")).alias("corrupt"))


@_R.add(
    "d15_merged",
    """SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN '> ' || text || chr(10) || 'end' ELSE '<<<<<<<' || chr(10) || '> ' || text || chr(10) || '=======' || chr(10) || text || chr(10) || 'end' || chr(10) || '>>>>>>>' END AS text,
  CASE WHEN contains(text, chr(10)) THEN 0 ELSE 1 END AS conflicts FROM documents WHERE text IS NOT NULL""",
)
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of the first line and a line at the end, merged; a text of one line has both in one place."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.merged(t, F.concat(F.lit("> "), t), F.concat(t, F.lit("\nend"))).alias("m"))
    return rows.select("doc_id", "m.*")


@_R.add(
    "d16_valid_patches",
    """WITH r AS (SELECT id, min(repo_owner) AS repo_owner, min(repo_name) AS repo_name, min(sha_fail) AS sha_fail FROM all_instances_metadata GROUP BY 1), d AS (SELECT DISTINCT diff_id, instance_id, diff FROM diff_output)
SELECT d.instance_id AS id, r.repo_owner || '/' || r.repo_name AS repo, r.sha_fail, d.diff, contains(diff, 'diff --git') OR contains(diff, '@@') OR contains(diff, '---') OR contains(diff, '+++') OR contains(diff, 'index ') AS marked
FROM d JOIN r ON d.instance_id = r.id WHERE regexp_matches(d.diff, '\\S') AND r.repo_owner || '/' || r.repo_name IS NOT NULL""",
)
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of records whose repository comes in two parts and whose diff is under its other name for odd ids."""
    records = table(spark, sf_dir, "all_instances_metadata").groupBy("id").agg(*[F.min(c).alias(c) for c in ("repo_owner", "repo_name", "sha_fail")])
    diffs = table(spark, sf_dir, "diff_output").select("diff_id", F.col("instance_id").alias("id"), "diff").distinct()
    odd = F.col("diff_id") % 2 == 1
    named = diffs.select("id", F.when(~odd, F.col("diff")).alias("diff"), F.when(odd, F.col("diff")).alias("diff_fix"))
    return op.extracted_patches(named.join(records, "id"))


@_R.add("d17_change_kinds", "SELECT parsed_id, CAST(len(list_filter(changes, lambda c: c.change_type = 'added')) AS INTEGER) AS added, CAST(len(list_filter(changes, lambda c: c.change_type = 'deleted')) AS INTEGER) AS deleted, CAST(len(list_filter(changes, lambda c: c.change_type = 'modified')) AS INTEGER) AS modified FROM parsed_file WHERE changes IS NOT NULL")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_file").filter("changes is not null")
    return rows.select("parsed_id", op.change_kinds(F.col("changes")).alias("k")).select("parsed_id", "k.*")


@_R.add(
    "c01_token_chunks",
    """WITH RECURSIVE p AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) <= 800 THEN [l] ELSE list_transform(range(0, CAST(ceil(length(l) / 800) AS BIGINT)), lambda i: substr(l, i * 800 + 1, 800)) END)) AS p FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, p, list_transform(p, lambda x: (length(x) + 3) // 4) AS sz FROM p), s AS (SELECT doc_id, p, sz, list_transform(range(0, len(p) + 1), lambda i: CAST(coalesce(list_sum(sz[1:i]), 0) AS BIGINT)) AS sums FROM z),
r AS (
  SELECT doc_id, 0 AS chunk_no, CAST(1 AS BIGINT) AS first, greatest(len(list_filter(range(1, len(p) + 1), lambda j: sums[j + 1] <= 200)), 1) AS last FROM s
  UNION ALL SELECT doc_id, chunk_no, first, greatest(first - 1 + len(list_filter(range(first, len(p) + 1), lambda j: sums[j + 1] - sums[first] <= 200)), first) FROM (
    SELECT r.doc_id, r.chunk_no + 1 AS chunk_no, s.p, s.sums, r.last + 1 - len(list_filter(range(1, r.last - r.first + 1), lambda k: s.sums[r.last + 1] - s.sums[r.last + 1 - k] <= least(20, 200 - s.sz[r.last + 1]))) AS first
    FROM r JOIN s ON s.doc_id = r.doc_id WHERE r.last < len(s.p)))
SELECT r.doc_id, chunk_no, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(sums[last + 1] - sums[first] AS INTEGER) AS size, array_to_string(p[first:last], chr(10)) AS text FROM r JOIN s ON s.doc_id = r.doc_id""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 tokens that repeat up to 20."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.filled_chunks(F.col("text"), 200, 20)).alias("chunk_no", "c"))
    return chunks.select("doc_id", "chunk_no", "c.*")


@_R.add("c03_line_windows", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, ls, unnest(range(0, CAST(greatest(ceil((len(ls) - 2) / 8), 1) AS BIGINT))) AS i FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 8 + 1 AS INTEGER) AS first, CAST(least(i * 8 + 10, len(ls)) AS INTEGER) AS last, array_to_string(ls[i * 8 + 1 : i * 8 + 10], chr(10)) AS text FROM s""")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(chunking.line_windows(F.col("text"), 10, 2)).alias("chunk_no", "c"))
    return chunks.select("doc_id", "chunk_no", "c.*")


@_R.add(
    "c04_diff_chunks",
    f"""WITH RECURSIVE {_SECTIONS}, m AS (SELECT diff_id, max(section_pos) AS top FROM se GROUP BY 1), s AS (SELECT se.diff_id, section_pos AS pos, section || CASE WHEN section_pos < top THEN chr(10) ELSE '' END AS t FROM se JOIN m ON se.diff_id = m.diff_id),
r AS (SELECT diff_id, pos, 0 AS chunk_no, t AS text FROM s WHERE pos = 0
  UNION ALL SELECT s.diff_id, s.pos, CASE WHEN length(r.text) + length(s.t) <= 8000 THEN r.chunk_no ELSE r.chunk_no + 1 END, CASE WHEN length(r.text) + length(s.t) <= 8000 THEN r.text || s.t ELSE s.t END FROM r JOIN s ON s.diff_id = r.diff_id AND s.pos = r.pos + 1)
SELECT diff_id, chunk_no, CAST(length(arg_max(text, pos)) AS INTEGER) AS n_chars, arg_max(text, pos) AS text FROM r GROUP BY 1, 2""",
)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File sections packed in order to 8,000 characters."""
    packs = _diffs(spark, sf_dir).select("diff_id", F.posexplode(chunking.packed_sections(op.sections(F.col("diff")), 8000)).alias("chunk_no", "text"))
    return packs.select("diff_id", "chunk_no", F.length("text").alias("n_chars"), "text")


@_R.add("c06_size_strategy", "SELECT doc_id, CASE WHEN length(text) // 4 <= 100 THEN 'full' WHEN length(text) // 4 <= 400 THEN 'chunked' ELSE 'summarised' END AS strategy, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C06, C11."""
    t = chunking.tokens_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", chunking.size_strategy(t, 100, 400).alias("strategy"), t.alias("tokens"))


@_R.add("c07_file_groups", "SELECT diff_id, parsed_id, CAST((row_number() OVER (PARTITION BY diff_id ORDER BY file_pos, parsed_id) - 1) // 3 AS INTEGER) AS chunk FROM parsed_file")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_file").select("diff_id", "parsed_id", "file_pos")
    return chunking.numbered_groups(rows, ["diff_id"], ["file_pos", "parsed_id"], 3).drop("file_pos")


@_R.add(
    "c08_packed_files",
    """WITH RECURSIVE f AS (SELECT diff_id, parsed_id, coalesce(total_changes, 0) AS n FROM parsed_file), o AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY n DESC, parsed_id) AS rn FROM f),
r AS (SELECT diff_id, parsed_id, rn, 0 AS bin, n AS used FROM o WHERE rn = 1 UNION ALL SELECT o.diff_id, o.parsed_id, o.rn, CASE WHEN r.used + o.n > 40 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used + o.n > 40 THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.diff_id IS NOT DISTINCT FROM r.diff_id AND o.rn = r.rn + 1)
SELECT diff_id, parsed_id, bin FROM r""",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a diff packed by falling size to 40 changes a bin."""
    per = table(spark, sf_dir, "parsed_file").groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("parsed_id", F.coalesce("total_changes", F.lit(0)).alias("n")))).alias("f"))
    bins = chunking.packed(F.transform("f", lambda x: x["n"]), 40)
    return per.withColumn("b", bins).select("diff_id", F.explode(F.arrays_zip("f", "b")).alias("x")).select("diff_id", "x.f.parsed_id", F.col("x.b").alias("bin"))


@_R.add("c10_cut_middle", "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || '...' || chr(10) || right(text, 200) ELSE text END AS text FROM documents")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunking.cut_middle(F.col("text"), 400).alias("text"))


@_R.add(
    "g01_components",
    f"""WITH RECURSIVE {_EDGES_SQL}, bi AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed UNION SELECT src, src FROM ed UNION SELECT dst, dst FROM ed),
r AS (SELECT DISTINCT a AS node, a AS seen FROM bi UNION SELECT r.node, bi.b FROM r JOIN bi ON r.seen = bi.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""",
)
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files connected by following each other in some diff."""
    return graph.components(file_edges(spark, sf_dir).select("src", "dst"))


@_R.add("c09_component_chunks", f"""WITH RECURSIVE {_EDGES_SQL}, bi AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed UNION SELECT src, src FROM ed UNION SELECT dst, dst FROM ed),
r AS (SELECT DISTINCT a AS node, a AS seen FROM bi UNION SELECT r.node, bi.b FROM r JOIN bi ON r.seen = bi.a), c AS (SELECT node AS item, min(seen) AS component FROM r GROUP BY 1)
SELECT component, item, CAST((CAST(sum(length(item)) OVER (PARTITION BY component ORDER BY item) AS BIGINT) - 1) // 100 AS INTEGER) AS chunk FROM c""")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected files together, larger components cut by a budget."""
    c = graph.components(file_edges(spark, sf_dir).select("src", "dst")).select(F.col("node").alias("item"), "component", F.length("node").alias("size"))
    return chunking.cluster_chunks(c, [], 100).select("component", "item", "chunk")


@_R.add(
    "g02_import_edges",
    f"""WITH {_SECTIONS}, im AS (
  SELECT DISTINCT diff_id, path AS src, regexp_replace(split_part(regexp_replace(n, '^\\s+|\\s+$', '', 'g'), ' as ', 1), '^\\s+|\\s+$', '', 'g') AS name FROM (
    SELECT diff_id, path, unnest(string_split(regexp_extract(l, '(?:from\\s+[.\\w]+\\s+)?import\\s+([\\w.\\s,]+)', 1), ',')) AS n FROM (SELECT diff_id, path, unnest(string_split(section, chr(10))) AS l FROM se WHERE ends_with(path, '.py'))
    WHERE starts_with(l, '+') AND contains(l, 'import '))),
mo AS (SELECT diff_id, section_pos, path, trim(replace(replace(path, '/', '.'), '.py', ''), './') AS whole FROM se WHERE ends_with(path, '.py')),
ml AS (SELECT diff_id, module, arg_max(path, section_pos) AS dst FROM (SELECT diff_id, section_pos, path, whole AS module FROM mo UNION SELECT diff_id, section_pos, path, split_part(whole, '.', -1) FROM mo) GROUP BY 1, 2)
SELECT DISTINCT im.diff_id, im.name, im.src, ml.dst FROM im JOIN ml ON im.diff_id = ml.diff_id AND (im.name = ml.module OR ends_with(im.name, '.' || ml.module)) WHERE im.name <> '' AND NOT starts_with(im.name, '_') AND im.src <> ml.dst""",
)
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one diff that import each other."""
    return op.import_graph(_sections(spark, sf_dir))


@_R.add(
    "g03_pagerank",
    f"""WITH RECURSIVE {_EDGES_SQL}, e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM ed GROUP BY 1, 2), b AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
f AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM b), n AS (SELECT count(DISTINCT src) AS n FROM b),
r AS (SELECT 0 AS i, src AS node, 1.0 / (SELECT n FROM n) AS rank FROM (SELECT DISTINCT src FROM b)
  UNION ALL SELECT r.i + 1, f.dst, CAST(0.15 AS DOUBLE) / (SELECT n FROM n) + CAST(0.85 AS DOUBLE) * sum(r.rank * f.share) FROM r JOIN f ON r.node = f.src WHERE r.i < 20 GROUP BY 1, 2)
SELECT node, round(rank, 9) AS rank FROM r WHERE i = 20""",
)
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the files after 20 rounds; every edge runs both ways, so none dangles."""
    e = file_edges(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return graph.pagerank(both).select("node", F.round("rank", 9).alias("rank"))


@_R.add(
    "t11_term_graph",
    f"""WITH t AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z_][a-z0-9_]*$') AND length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc, t[i] AS x, t[i + k] AS y FROM (SELECT doc, t, unnest(range(1, len(t) + 1)) AS i FROM t), (SELECT unnest(range(1, 6)) AS k) WHERE i + k <= len(t))
SELECT doc, least(x, y) AS src, greatest(x, y) AS dst, count(*) AS w FROM p WHERE x <> y GROUP BY 1, 2, 3""",
)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms within five places of each other, per document (T11; ranks of them are T12, T13)."""
    from quarryline.operators.text import terms

    return graph.term_graph(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", terms(F.col("text")))


@_R.add("g04_neighbourhood", f"WITH {_EDGES_SQL}, sd AS (SELECT DISTINCT path AS node FROM parsed_file WHERE file_type = '.toml') SELECT node FROM sd WHERE node IS NOT NULL UNION SELECT dst FROM ed WHERE src IN (SELECT node FROM sd) UNION SELECT src FROM ed WHERE dst IN (SELECT node FROM sd)")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "parsed_file").filter("file_type = '.toml' and path is not null").select(F.col("path").alias("node"))
    return graph.neighbourhood(file_edges(spark, sf_dir).select("src", "dst"), seeds)


@_R.add("g05_callers", "SELECT module_name, function_name, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS callees, CAST(count(DISTINCT model) AS INTEGER) AS n FROM llm_call_record GROUP BY 1, 2")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(table(spark, sf_dir, "llm_call_record"), ["module_name", "function_name"], "model")


@_R.add("g06_filtered_clusters", "WITH k AS (SELECT list_distinct(list(path)) AS keep FROM parsed_file WHERE file_type = '.py'), c AS (SELECT diff_id, list_sort(list(DISTINCT path)) AS ps FROM parsed_file WHERE path IS NOT NULL GROUP BY 1) SELECT diff_id, ps FROM (SELECT diff_id, list_filter(ps, lambda p: ends_with(p, '.py')) AS ps FROM c) WHERE len(ps) > 0")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each diff as a cluster, without those of other kinds."""
    per = table(spark, sf_dir, "parsed_file").filter("path is not null").groupBy("diff_id").agg(F.array_sort(F.collect_set("path")).alias("ps"))
    kept = graph.filtered_clusters(F.array("ps"), F.filter("ps", lambda p: p.endswith(".py")))
    return per.select("diff_id", F.explode(kept).alias("ps"))


@_R.add("g07_bounded_summary", "SELECT diff_id, ps[1:2] AS shown, CAST(len(ps) AS INTEGER) AS total, len(ps) > 2 AS truncated FROM (SELECT diff_id, list_sort(list(DISTINCT path)) AS ps FROM parsed_file WHERE path IS NOT NULL GROUP BY 1)")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G06, G07."""
    per = table(spark, sf_dir, "parsed_file").filter("path is not null").groupBy("diff_id").agg(F.array_sort(F.collect_set("path")).alias("ps"))
    return per.select("diff_id", graph.bounded_summary(F.col("ps"), 2).alias("s")).select("diff_id", "s.*")
