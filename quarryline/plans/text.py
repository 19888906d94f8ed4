"""Queries of text retrieval and similarity (T of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import text as op
from quarryline.plans.registry import Registry
from quarryline.session import materialize, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

_STOP = "(" + ", ".join(f"'{w}'" for w in op.STOP_WORDS) + ")"
#: Postings over all documents in DuckDB; ASCII texts only differ in how \\b sees other letters, so letters are cut by class.
_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
_POST = f"""po AS (SELECT doc, term, count(*) AS tf, max(doc_len) AS doc_len FROM (
  SELECT doc_id AS doc, unnest(t) AS term, len(t) AS doc_len FROM (SELECT doc_id, list_filter({_WORDS}, lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS t FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2)"""
_ASKED = "qu AS (SELECT doc_id AS query, unnest(list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+'), lambda w: length(w) >= 3)) AS term FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL)"


def _words(c: str) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*op.STOP_WORDS))


def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.postings(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", _words("text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 is a query: the words of its first line."""
    first = F.regexp_extract_all(F.lower(F.split("text", "\n", 2)[0]), F.lit("[a-z]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0 and text is not null")
    return docs.select(F.col("doc_id").alias("query"), F.explode(F.filter(first, lambda w: F.length(w) >= 3)).alias("term"))


def _search(spark: SparkSession, sf_dir: str, text: str = "text", must: tuple[str, ...] = (), asked: DataFrame | None = None, **how: object) -> DataFrame:
    """Searches (``searches``) of all queries, or of ``asked``, over all documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("head", F.split("text", "\n", 2)[0])
    asked = _asked(spark, sf_dir) if asked is None else asked
    if must:
        asked = asked.join(docs.select(F.col("doc_id").alias("query"), *must), "query")
    return op.searches(op.tokenised(docs, "doc_id", _words(text), must), asked, must=must, **how)


#: k1 and b of the two searches that are compared.
_BOTH = ((1.5, 0.75), (1.5, 0.2))


_STATS = "st AS (SELECT count(*) AS n, avg(l) AS m FROM (SELECT max(doc_len) AS l FROM po GROUP BY doc)), df AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po GROUP BY 1), a AS (SELECT query, term, count(*) AS qtf FROM qu GROUP BY 1, 2)"


def _scores_sql(name: str, b: float = 0.75, post: str = "po", stats: str = "st", df: str = "df") -> str:
    """Scores and ranks of a search as two more relations: ``name`` and ``name``_r."""
    return f"""{name} AS (SELECT a.query, po.doc, round(sum(a.qtf * df.idf * po.tf * 2.5 / (po.tf + 1.5 * ({1 - b} + {b} * po.doc_len / (SELECT m FROM {stats})))), 9) AS score FROM a JOIN {post} po ON a.term = po.term JOIN {df} df ON df.term = a.term GROUP BY 1, 2),
{name}_r AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM {name} WHERE score > 0)"""


def _bm25_sql(k: int, extra: str = "") -> str:
    return f"WITH {_POST}, {_ASKED}, {_STATS}, {_scores_sql('s')} {extra or f'SELECT query, doc, score, rank FROM s_r WHERE rank <= {k}'}"


_RENUMBERED = "SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM"


@_R.add("t02_bm25", _bm25_sql(10))
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all documents, ten best a query (T01-T04). Scores are rounded before they are ranked, so that the order of sums decides no tie."""
    return op.best_of(_search(spark, sf_dir))


@_R.add("t02_bm25_best_scores", _bm25_sql(1, "SELECT query, round(max(score), 6) AS best FROM s GROUP BY 1"))
def t02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = op.best_of(_search(spark, sf_dir, k=1))
    return best.select("query", F.round("score", 6).alias("best"))


_HEAD_SQL = _POST.replace("po AS", "ph AS", 1).replace("lower(text)", "lower(split_part(text, chr(10), 1))")


@_R.add(
    "t05_boosted_fields",
    f"""WITH {_POST}, {_HEAD_SQL}, {_ASKED}, {_STATS}, sh AS (SELECT count(*) AS n, avg(l) AS m FROM (SELECT max(doc_len) AS l FROM ph GROUP BY doc)), dh AS (SELECT term, ln(1 + ((SELECT n FROM sh) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ph GROUP BY 1),
{_scores_sql("s")}, {_scores_sql("h", post="ph", stats="sh", df="dh")}, u AS (SELECT query, doc, round(sum(w), 9) AS score FROM (SELECT query, doc, score AS w FROM s_r WHERE rank <= 50 UNION ALL SELECT query, doc, score * 2 FROM h_r WHERE rank <= 50) GROUP BY 1, 2)
SELECT * FROM ({_RENUMBERED} u) WHERE rank <= 10""",
)
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text and, at double weight, first lines."""
    return op.combined_search([(op.best_of(_search(spark, sf_dir, k=50)), 1.0), (op.best_of(_search(spark, sf_dir, "head", k=50)), 2.0)], 10)


@_R.add(
    "t06_rescored",
    f"""WITH {_POST}, {_ASKED}, {_STATS}, {_scores_sql("s")}, {_scores_sql("z", 0.2)},
u AS (SELECT s.query, s.doc, s.score * CAST(0.7 AS DOUBLE) + coalesce(z.score, 0) * CAST(1.2 AS DOUBLE) AS score FROM s_r s LEFT JOIN z_r z ON s.query = z.query AND s.doc = z.doc AND z.rank <= 50 WHERE s.rank <= 50) {_RENUMBERED} u""",
)
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rescored(op.both_ways(_search(spark, sf_dir, ways=_BOTH, ranked=2, k=50)))


@_R.add(
    "t07_fused",
    f"""WITH {_POST}, {_ASKED}, {_STATS}, {_scores_sql("s")}, {_scores_sql("z", 0.2)}, x AS (SELECT * FROM s_r WHERE rank <= 20), y AS (SELECT * FROM z_r WHERE rank <= 20),
r AS (SELECT coalesce(x.query, y.query) AS query, coalesce(x.doc, y.doc) AS doc, CASE WHEN x.doc IS NOT NULL AND y.doc IS NOT NULL THEN 2.0 WHEN x.doc IS NOT NULL THEN 1.5 ELSE 0.5 END * CAST(greatest(coalesce(x.score, 0), coalesce(y.score, 0)) AS DOUBLE) AS raw FROM x FULL JOIN y ON x.query = y.query AND x.doc = y.doc),
u AS (SELECT query, doc, round(raw / max(raw) OVER (PARTITION BY query), 9) AS score FROM r) {_RENUMBERED} u""",
)
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches fused (T07); queries that ask the same are searched once."""
    same = op.alike(_asked(spark, sf_dir))
    return op.for_all(op.fused(op.both_ways(_search(spark, sf_dir, asked=op.once(same), ways=_BOTH, ranked=2, k=20))), same)


_EXTERNAL_SQL = "SELECT term, round(ln(1 + 220.0 / count(*)), 9) AS idf FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM eval_items) GROUP BY 1"


@_R.add("t03_external_idf", f"WITH {_POST}, {_ASKED}, st AS (SELECT avg(l) AS m FROM (SELECT max(doc_len) AS l FROM po GROUP BY doc)), df AS ({_EXTERNAL_SQL}), a AS (SELECT query, term, count(*) AS qtf FROM qu GROUP BY 1, 2), {_scores_sql('s')} SELECT query, doc, score, rank FROM s_r WHERE rank <= 10")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the idf of another collection; terms that it lacks do not count."""
    other = table(spark, sf_dir, "eval_items").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    idf = other.groupBy("term").agg(F.round(F.log(1 + F.lit(220.0) / F.count("*")), 9).alias("idf"))
    return op.best_of(_search(spark, sf_dir, idf=idf))


@_R.add(
    "t04_filtered_search",
    f"""WITH {_POST}, {_ASKED}, {_STATS}, {_scores_sql("s")}, h AS (SELECT query, doc FROM (SELECT DISTINCT query, term FROM qu) q JOIN po ON q.term = po.term GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT s.* FROM s JOIN h ON s.query = h.query AND s.doc = h.doc JOIN documents x ON x.doc_id = s.query JOIN documents y ON y.doc_id = s.doc WHERE x.repo = y.repo AND x.lang = y.lang AND s.score > 0)
SELECT * FROM ({_RENUMBERED} f) WHERE rank <= 10""",
)
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the query's repository and language that have two of its terms or more."""
    return op.best_of(_search(spark, sf_dir, must=("repo", "lang"), least_should=2))


@_R.add("t32_reranked", f"WITH {_POST}, {_ASKED}, {_STATS}, {_scores_sql('s')}, {_scores_sql('z', 0.2)}, u AS (SELECT z.* FROM z JOIN s_r ON z.query = s_r.query AND z.doc = s_r.doc WHERE s_r.rank <= 20) SELECT * FROM ({_RENUMBERED} u) WHERE rank <= 10")
def t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of one search in the order of another."""
    return op.reranked(_search(spark, sf_dir, ways=_BOTH, k=20), 10)


def _term_ranks(spark: SparkSession, sf_dir: str, window: int, biased: bool) -> DataFrame:
    """query, term, rank over the term graph of each query document; the graphs of the documents are parts of one that do not touch."""
    from quarryline.operators import graph

    docs = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0 and text is not null")
    words = op.terms(F.col("text"))
    edges = graph.term_graph(docs, "doc_id", words, window).select(F.struct("doc", F.col("src").alias("term")).alias("src"), F.struct("doc", F.col("dst").alias("term")).alias("dst"), F.col("w").cast("double").alias("w"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    bias = None
    if biased:
        post = op.postings(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", words)
        bias = op.tfidf(post).filter("doc % 100 = 0").select(F.struct("doc", "term").alias("node"), F.col("weight").alias("bias"))
    return graph.pagerank(both, bias=bias).select(F.col("node.doc").alias("query"), F.col("node.term").alias("term"), "rank")


_ALL_TERMS_SQL = f"tt AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z_][a-z0-9_]*$') AND length(w) >= 3 AND w NOT IN {_STOP}) AS t FROM documents WHERE text IS NOT NULL)"


def _ranks_sql(window: int, start: str) -> str:
    """Ranks after 20 rounds over the term graphs of the query documents, from nodes ``nb`` (doc, term, bias)."""
    return f"""{_ALL_TERMS_SQL}, pr AS (SELECT doc, t[i] AS x, t[i + k] AS y FROM (SELECT doc, t, unnest(range(1, len(t) + 1)) AS i FROM tt WHERE doc % 100 = 0), (SELECT unnest(range(1, {window + 1})) AS k) WHERE i + k <= len(t)),
tg AS (SELECT doc, least(x, y) AS src, greatest(x, y) AS dst, CAST(count(*) AS DOUBLE) AS w FROM pr WHERE x <> y GROUP BY 1, 2, 3), tb AS (SELECT doc, src, dst, w FROM tg UNION ALL SELECT doc, dst, src, w FROM tg),
tf AS (SELECT doc, src, dst, w / sum(w) OVER (PARTITION BY doc, src) AS share FROM tb), nd AS (SELECT DISTINCT doc, src AS term FROM tb), {start},
r AS (SELECT 0 AS i, doc, term, CAST(bias AS DOUBLE) AS rank FROM nb
  UNION ALL SELECT g.i + 1, g.doc, g.term, CAST(0.15 AS DOUBLE) * nb.bias + CAST(0.85 AS DOUBLE) * g.got FROM (SELECT r.i, tf.doc, tf.dst AS term, sum(r.rank * tf.share) AS got FROM r JOIN tf ON r.doc = tf.doc AND r.term = tf.src WHERE r.i < 20 GROUP BY 1, 2, 3) g JOIN nb ON nb.doc = g.doc AND nb.term = g.term),
rk AS (SELECT doc AS query, term, CAST(row_number() OVER (PARTITION BY doc ORDER BY round(rank, 9) DESC, term) AS INTEGER) AS rank FROM r WHERE i = 20)"""


@_R.add(
    "t12_expansion",
    f"""WITH RECURSIVE {_ASKED}, {_ranks_sql(5, "nb AS (SELECT doc, term, 1.0 / (SELECT count(*) FROM nd) AS bias FROM nd)")}
SELECT query, term, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS rank FROM rk WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM qu WHERE qu.query = rk.query AND qu.term = rk.term) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 5""",
)
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query document the five best terms among its ten highest ranks that the query lacks."""
    first = op.top_k(_term_ranks(spark, sf_dir, 5, False).withColumn("score", F.round("rank", 9)).drop("rank"), ["query"], [F.desc("score"), F.col("term")], 10)
    fresh = first.drop("rank").join(_asked(spark, sf_dir).distinct(), ["query", "term"], "left_anti")
    return op.top_k(fresh, ["query"], [F.desc("score"), F.col("term")], 5).select("query", "term", "rank")


_BIAS_SQL = """tp AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tt) GROUP BY 1, 2), td AS (SELECT term, ln((1 + (SELECT count(DISTINCT doc) FROM tp)) / (1 + count(*))) + 1 AS idf FROM tp GROUP BY 1),
tw AS (SELECT doc, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)) AS w FROM tp JOIN td USING (term)), nb AS (SELECT nd.doc, nd.term, coalesce(w, 0) / sum(coalesce(w, 0)) OVER () AS bias FROM nd LEFT JOIN tw ON tw.doc = nd.doc AND tw.term = nd.term)"""


@_R.add("t13_biased_keywords", f"WITH RECURSIVE {_ranks_sql(20, _BIAS_SQL)} SELECT query, term, rank FROM rk WHERE rank <= 10")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query document the ten terms of highest rank with a window of 20 and a bias of tf times idf."""
    return op.top_k(_term_ranks(spark, sf_dir, 20, True).withColumn("score", F.round("rank", 9)).drop("rank"), ["query"], [F.desc("score"), F.col("term")], 10).select("query", "term", "rank")


@_R.add("t08_terms", f"SELECT doc_id, list_filter({_WORDS}, lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS terms FROM documents WHERE text IS NOT NULL")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", _words("text").alias("terms"))


@_R.add("t08_postings", f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM po GROUP BY 1")
def t08p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term."""
    return _post(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_R.add("t09_dotted_tokens", f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '(?:[\\p{{L}}\\p{{N}}_]+\\.)*[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT regexp_matches(w, '^[0-9.]+$') AND length(w) > 1 AND w NOT IN {_STOP}) AS tokens FROM documents WHERE text IS NOT NULL")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.dotted_tokens(F.col("text")).alias("tokens"))


@_R.add("t10_camel_case", "SELECT record_id, regexp_replace(workflow_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS name FROM all_instances_metadata")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_instances_metadata").select("record_id", op.split_camel(F.col("workflow_name")).alias("name"))


@_R.add(
    "t14_tfidf_weights",
    f"""WITH {_POST}, n AS (SELECT count(DISTINCT doc) AS n FROM po), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.6 * (SELECT n FROM n)),
w AS (SELECT po.doc, po.term, tf * (ln((1 + (SELECT n FROM n)) / (1 + df.df)) + 1) AS w FROM po JOIN df ON po.term = df.term) SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w""",
)
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights, length one."""
    return op.tfidf(_post(spark, sf_dir), 0.6, 2).select("doc", "term", F.round("weight", 6).alias("weight"))


@_R.add(
    "t14_ngrams",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_concat(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i : i + 2], ' ')), list_transform(range(1, greatest(len(t) - 2, 1)), lambda i: array_to_string(t[i : i + 3], ' '))) AS grams FROM w""",
)
def t14n(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.ngrams(t, [3, 4]).alias("grams"))


_FILES_SQL = "fs AS (SELECT instance_id AS id, list(DISTINCT r.file) AS s FROM (SELECT instance_id, unnest(relevant_files) AS r FROM log_analysis) WHERE r.file IS NOT NULL AND instance_id IS NOT NULL GROUP BY 1)"


@_R.add("t17_jaccard_pairs", f"WITH {_FILES_SQL} SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM fs a JOIN fs b ON a.id < b.id WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.2")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of instances that name much the same files (J13, T17), by a prefix filter on rare files."""
    rows = table(spark, sf_dir, "log_analysis").filter("instance_id is not null").select("instance_id", F.explode("relevant_files.file").alias("f")).filter("f is not null")
    sets = rows.groupBy("instance_id").agg(F.collect_set("f").alias("s"))
    return op.jaccard_pairs(sets, [], "instance_id", "s", 0.2)


def _file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").filter("instance_id is not null").select(F.col("instance_id").alias("id"), F.explode("relevant_files.file").alias("f")).filter("f is not null")
    return rows.groupBy("id").agg(F.collect_set("f").alias("s"))


_LEX_SQL = f"""lx AS (SELECT instance_id AS id, list_filter(regexp_extract_all(lower(string_agg(t, ' ' ORDER BY t)), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS w FROM (SELECT DISTINCT instance_id, unnest(error_context) AS t FROM log_analysis WHERE instance_id IS NOT NULL) WHERE t IS NOT NULL GROUP BY 1),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM lx), gp AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2),
gt AS (SELECT term, count(*) AS df FROM gp GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 1000), gk AS (SELECT gp.*, df, count(DISTINCT id) OVER () AS n FROM gp JOIN gt ON gp.term = gt.term),
gw AS (SELECT id, term, tf * (ln((1 + (SELECT count(DISTINCT id) FROM gk)) / (1 + df)) + 1) AS w FROM (SELECT id, term, tf, df FROM gk)), gn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM gw GROUP BY 1), gv AS (SELECT gw.id, term, w / norm AS w FROM gw JOIN gn ON gw.id = gn.id)"""


@_R.add("t18_lexical_pairs", f"WITH {_LEX_SQL} SELECT a.id AS id_a, b.id AS id_b, round(round(sum(a.w * b.w), 9), 6) AS cosine FROM gv a JOIN gv b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.25")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose messages are alike: cosine of TF-IDF over the 1,000 most frequent one- and two-word terms."""
    rows = table(spark, sf_dir, "log_analysis").filter("instance_id is not null").select("instance_id", F.explode("error_context").alias("t")).filter("t is not null").distinct()
    texts = rows.groupBy(F.col("instance_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("text"))
    post = materialize(op.most_frequent(materialize(op.postings(texts, "id", op.ngrams(_words("text"), [1, 2]))), 1000, 2))
    pairs = op.cosine_pairs(materialize(op.tfidf(post)), 0.25)
    return pairs.select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


@_R.add(
    "t26_methods",
    """WITH l AS (SELECT doc_id, text, ls[i] AS x, i, len(ls) AS top FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
g AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^[ \\t]*(?:async[ \\t]+)?(?:def|class)\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM l),
f AS (SELECT doc_id, grp, first(x ORDER BY i) AS head, string_agg(x, chr(10) ORDER BY i) || CASE WHEN max(i) < max(top) THEN chr(10) ELSE '' END AS body FROM g WHERE grp > 0 GROUP BY 1, 2),
m AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS pos, regexp_extract(head, 'def\\s+(\\w+)', 1) AS name, CASE WHEN length(body) > 800 THEN left(body, 800) || '...' ELSE body END AS code FROM f WHERE regexp_matches(head, '^[ \\t]*(?:async[ \\t]+)?def\\s+\\w+\\s*[(]'))
SELECT * FROM m UNION ALL SELECT doc_id, 0, NULL, left(text, 1000) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM m)""",
)
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in the texts of the documents, or their heads."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(op.methods(F.col("text"))).alias("pos", "m"))
    return rows.select("doc_id", "pos", "m.*")


@_R.add("t27_outline")
def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline of the functions found in the documents, where they parse."""
    rows = t26(spark, sf_dir).filter("name is not null")
    return rows.select("doc_id", "pos", F.explode(op.python_outline(F.col("code"))).alias("o")).select("doc_id", "pos", "o.*")


_MARKERS_SQL = "text"
for _m in op.MARKERS:
    _MARKERS_SQL = f"replace({_MARKERS_SQL}, '{_m}', '')"


@_R.add(
    "t35_cleaned",
    f"""WITH a AS (SELECT doc_id, {_MARKERS_SQL} AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^' || chr(65279), ''), '^' || chr(239) || chr(187) || chr(191), '') AS t FROM a),
c AS (SELECT doc_id, nfc_normalize(replace(regexp_replace(t, '^[' || chr(65279) || chr(65534) || chr(65535) || ']+', ''), chr(0), '')) AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(t, '([^\\n])[ \\t]{{2,}}', '\\1 ', 'g') AS t FROM d) SELECT doc_id, regexp_replace(t, '\\n+$', chr(10)) AS text FROM e""",
)
def t35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning chain over every text."""
    return table(spark, sf_dir, "documents").select("doc_id", op.cleaned(F.col("text")).alias("text"))


@_R.add("t36_json_fields", "SELECT call_id, CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'OBJECT' THEN 'whole' END END AS how, CAST(CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'OBJECT' THEN len(json_keys(metadata)) END END AS INTEGER) AS n_fields FROM llm_call_record")
def t36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each record's metadata reads as a JSON object, and how many members it has."""
    rows = table(spark, sf_dir, "llm_call_record").select("call_id", op.json_fields(F.col("metadata")).alias("j"))
    return rows.select("call_id", "j.how", F.when(F.col("j.fields").isNotNull(), F.size("j.fields")).alias("n_fields"))


@_R.add("t19_recurrence", f"WITH {_FILES_SQL}, q AS (SELECT a.id, coalesce(max(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 0) AS b FROM fs a LEFT JOIN fs b ON a.id <> b.id GROUP BY 1) SELECT count(*) AS n_ids, round(avg(b), 9) AS mean_best FROM q")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 over every instance with files, however small its best similarity; one that shares no file counts as 0."""
    sets = _file_sets(spark, sf_dir)
    best = op.overlapping_pairs(sets, "id", "s").groupBy(F.col("id_a").alias("id")).agg(F.max("jaccard").alias("best"))
    rows = sets.select("id").join(best, "id", "left")
    return rows.agg(F.count("*").alias("n_ids"), F.round(F.avg(F.coalesce("best", F.lit(0.0))), 9).alias("mean_best"))


def _recurrence_within(same: bool) -> None:
    name, sign = ("t19_recurrence_within_repo", "=") if same else ("t19_recurrence_across_repos", "<>")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sets = _file_sets(spark, sf_dir).join(table(spark, sf_dir, "all_instances_metadata").filter("repo is not null").groupBy("id").agg(F.min("repo").alias("repo")), "id")
        repo = lambda side: sets.select(F.col("id").alias(f"id_{side}"), F.col("repo").alias(f"repo_{side}"))
        pairs = op.overlapping_pairs(sets, "id", "s").join(repo("a"), "id_a").join(repo("b"), "id_b").filter(F.col("repo_a") == F.col("repo_b") if same else F.col("repo_a") != F.col("repo_b"))
        rows = sets.select("id").join(pairs.groupBy(F.col("id_a").alias("id")).agg(F.max("jaccard").alias("best")), "id", "left")
        return rows.agg(F.count("*").alias("n_ids"), F.round(F.avg(F.coalesce("best", F.lit(0.0))), 9).alias("mean_best"))

    _R.add(name, f"WITH {_FILES_SQL}, rp AS (SELECT id, min(repo) AS repo FROM all_instances_metadata WHERE repo IS NOT NULL GROUP BY 1), x AS (SELECT fs.id, s, repo FROM fs JOIN rp ON fs.id = rp.id), q AS (SELECT a.id, coalesce(max(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 0) AS b FROM x a LEFT JOIN x b ON a.id <> b.id AND a.repo {sign} b.repo GROUP BY 1) SELECT count(*) AS n_ids, round(avg(b), 9) AS mean_best FROM q")(run)


_recurrence_within(True)
_recurrence_within(False)


@_R.add(
    "j14_historical_recurrence",
    f"""WITH {_FILES_SQL}, d AS (SELECT instance_id AS id, min(created_at) AS dt FROM log_analysis WHERE instance_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1), x AS (SELECT fs.id, s, dt FROM fs JOIN d ON d.id = fs.id)
SELECT a.id AS id_a, max(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) AS best FROM x a JOIN x b ON b.dt < a.dt GROUP BY 1""",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity to an earlier instance, however small; 0 where no earlier one shares a file."""
    from quarryline.operators.joins import earlier_best

    sets = _file_sets(spark, sf_dir)
    dates = table(spark, sf_dir, "log_analysis").filter("instance_id is not null and created_at is not null").groupBy(F.col("instance_id").alias("id")).agg(F.min("created_at").alias("dt"))
    dated = sets.join(dates, "id").select("id", "dt")
    best = earlier_best(dates, op.overlapping_pairs(sets, "id", "s"), "id", "dt", "jaccard")
    later = dated.join(dated.agg(F.min("dt").alias("first")), F.col("dt") > F.col("first")).select(F.col("id").alias("id_a"))
    return later.join(best, "id_a", "left").select("id_a", F.coalesce("best", F.lit(0.0)).alias("best"))


@_R.add("t20_text_slices", "SELECT doc_id, right(text, 100) AS tail, left(text, 50) AS head FROM documents")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.right("text", F.lit(100)).alias("tail"), F.left("text", F.lit(50)).alias("head"))


@_R.add("t21_tool_names", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '\\b(?:ruffle|wheelcast|testroost|pinlock)\\b'))) AS tools FROM documents WHERE text IS NOT NULL")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.tool_names(F.col("text"), ["ruffle", "wheelcast", "testroost", "pinlock"]).alias("tools"))


@_R.add(
    "t22_keyword_hits",
    f"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lower(ls[i]) AS low FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, line_no, list_filter([{", ".join(f"'{w}'" for w in op.ERROR_WORDS)}], lambda w: CASE WHEN contains(w, ' ') THEN contains(low, w) ELSE regexp_matches(regexp_replace(low, '\\bno ' || w || '\\b', '-', 'g'), '\\b' || w || '\\b') END) AS words FROM l)
SELECT doc_id, line_no, words FROM w WHERE len(words) > 0""",
)
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the keywords they hold."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", op.keyword_hits(F.col("line"), op.ERROR_WORDS).alias("words")).filter("size(words) > 0")


@_R.add(
    "t23_chunk_keywords",
    """WITH k AS (SELECT doc_id, source, regexp_extract_all(text, '[\\w./-]*/[\\w./-]+\\w|\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b|\\b\\w*(?:Error|Exception)\\b') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*File "|^\\s*(?:at|def|class|raise|return|import|from)\\s|\\b\\w+Error\\b')) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, source, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:12], ', ') AS kw, array_to_string(list_transform(t[1:5], lambda x: left(trim(x, ' '), 160)), ' | ') AS tr FROM k)
SELECT doc_id, concat_ws(chr(10), CASE WHEN kw <> '' THEN 'keywords: ' || kw END, CASE WHEN tr <> '' THEN 'trace: ' || tr END, CASE WHEN source <> '' THEN 'source: ' || source END) AS doc FROM p""",
)
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and trace lines of a text, and a document made of them."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", op.document_text([("keywords", F.array_join(op.chunk_keywords(t), ", ")), ("trace", F.array_join(op.trace_lines(t), " | ")), ("source", F.col("source"))]).alias("doc"))


@_R.add(
    "t29_snippet_range",
    """WITH l AS (SELECT doc_id, text, ls[i] AS x, i FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
p AS (SELECT doc_id, i, length(left(text, strpos(text, x) - 1)) - length(replace(left(text, strpos(text, x) - 1), chr(10), '')) + 1 AS f FROM l WHERE x <> '')
SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(f AS INTEGER) AS first_line FROM p""",
)
def t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a text is found in it first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line <> ''")
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), op.snippet_range(F.col("text"), F.col("line"))["first"].alias("first_line"))


@_R.add("t31_softmax", "WITH e AS (SELECT o_custkey, o_orderkey, exp(o_totalprice / 100000 - max(o_totalprice / 100000) OVER (PARTITION BY o_custkey)) AS x FROM orders) SELECT o_custkey, o_orderkey, round(x / sum(x) OVER (PARTITION BY o_custkey), 9) AS softmax FROM e")
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a query as shares."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000).alias("s"))
    return op.softmax_scores(rows, "o_custkey", "s").select("o_custkey", "o_orderkey", F.round("softmax", 9).alias("softmax"))


@_R.add("t33_without_tests", "SELECT diff_id, list_sort(list(DISTINCT path)) AS paths FROM parsed_file WHERE path IS NOT NULL AND NOT contains(split_part(path, '/', -1), 'test') GROUP BY 1")
def t33(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_file").filter("path is not null").filter(~F.substring_index("path", "/", -1).contains("test"))
    return rows.groupBy("diff_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


@_R.add("t34_squeezed", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' {2,}', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM documents")
def t34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", op.squeeze(F.col("text")).alias("text"))
