"""Tokens, postings, BM25, TF-IDF, similarity and keyword scans.

Retrieval scores cells of documents against all queries in Arrow batches, as its pairs grow with the square of the
collection. The statistics of the collection (documents, lengths) are scalar subqueries. Similarity pairs come from
shared terms or shared features, never from all pairs.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.arrays import let
from quarryline.operators.scoring import cell_search
from quarryline.operators.windows import renumbered, top_k

#: Words left out of term lists, and words that name a failure.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "be", "with", "by", "at", "from", "this", "that", "it", "as")
ERROR_WORDS = ("error", "failed", "failure", "exception", "traceback", "fatal", "cannot", "undefined", "timeout", "timed out", "missing", "refused")


#: Runs of letters, digits and underscores, those of them that are terms, and words joined by dots.
WORD, TERM, DOTTED = r"[\p{L}\p{N}_]+", r"^[a-z_][a-z0-9_]*$", r"(?:[\p{L}\p{N}_]+\.)*[\p{L}\p{N}_]+"
#: The edge of a word of ASCII letters, digits and underscores, whatever letters of other scripts stand beside it.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def terms(text: Column, stop: Sequence[str] = STOP_WORDS, least: int = 3) -> Column:
    """Identifier-like words in lower case of at least ``least`` letters, stop words left out."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: w.rlike(TERM))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def dotted_tokens(text: Column, stop: Sequence[str] = STOP_WORDS, lower: bool = True) -> Column:
    """Words joined by dots as one token; numbers, single characters and stop words left out."""
    t = F.lower(text) if lower else text
    found = F.regexp_extract_all(t, F.lit(DOTTED), F.lit(0))
    return F.filter(found, lambda w: ~w.rlike(r"^[0-9.]+$") & (F.length(w) > 1) & ~F.lower(w).isin(*stop))


def split_camel(text: Column) -> Column:
    """Words of camel case parted by blanks."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def postings(docs: DataFrame, doc: str, tokens: Column, scope: Sequence[str] = ()) -> DataFrame:
    """scope, doc, term, tf, doc_len: one combinable aggregate."""
    rows = docs.select(*scope, F.col(doc).alias("doc"), tokens.alias("_t"))
    return rows.select(*scope, "doc", F.size("_t").alias("doc_len"), F.explode("_t").alias("term")).groupBy(*scope, "doc", "term").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))


#: Documents that are searched in one task.
CELL = 16_384
#: Terms of any length are read back, or the job fails.
_AS_WRITTEN = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
#: Counted among a document's terms for the document itself.
ITSELF = "\0"


class Collection:
    """The searched documents, dealt into cells by hash, and what BM25 asks of them as a whole.

    ``rows`` holds doc and x (see ``_held``), the document's key (null if no filtered search may find it) and its terms with repeats;
    ``doc_len`` is its length. Rows of one document are one document; documents without a term are none.
    As x is one column, all that reads the cells reads the same columns, so that they are made once."""

    def __init__(self, rows: DataFrame, doc_len: Column | None = None) -> None:
        n = rows.agg(F.approx_count_distinct("doc").alias("n")).scalar()
        self.cells = F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
        dealt = rows.withColumn("cell", F.pmod(F.xxhash64("doc"), self.cells).cast("int")).repartition("cell")
        dealt = dealt.select("cell", "doc", *([] if doc_len is None else [doc_len.alias("doc_len")]), F.get("x", F.lit(0)).alias("key"), F.from_json(F.get("x", F.lit(1)), "array<string>", _AS_WRITTEN).alias("terms"))
        docs = dealt.groupBy("cell", "doc").agg(F.max(F.size("terms") if doc_len is None else F.col("doc_len")).alias("doc_len"), F.flatten(F.collect_list("terms")).alias("terms"), F.max("key").alias("key"))
        self.docs = docs.filter("doc_len > 0")
        each = self.docs.select("doc_len", F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(ITSELF)))).alias("term")).withColumn("term", F.coalesce("term", F.lit("")))
        self.terms = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("doc_len").alias("len"))
        own = lambda c: F.max(F.when(F.col("term") == ITSELF, F.col(c)))
        whole = self.terms.agg(F.struct(own("df").alias("n"), (own("len") / own("df")).alias("mean"))).scalar()
        self.n, self.mean = whole["n"], whole["mean"]

    def idf(self) -> DataFrame:
        """term, idf: log(1 + (n - df + 0.5) / (df + 0.5))."""
        return self.terms.filter("len > 0").select("term", F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def tokenised(docs: DataFrame, doc: str, tokens: Column, must: Sequence[str] = ()) -> Collection:
    """The collection of documents with the terms ``tokens``; ``must`` are the keys by which searches are filtered."""
    return Collection(docs.select(F.col(doc).alias("doc"), _held(_key(must), tokens)))


def posted(post: DataFrame) -> Collection:
    """The collection whose postings are ``post`` (doc, term, tf, doc_len)."""
    return Collection(post.select("doc", "doc_len", _held(_key(()), F.array_repeat("term", F.col("tf").cast("int")))), F.col("doc_len"))


def _held(key: Column, terms: Column) -> Column:
    """x: the key and the terms as JSON, which takes less than half of an array's place in a shuffle."""
    return F.array(key, F.to_json(terms)).alias("x")


def _key(must: Sequence[str]) -> Column:
    """The keys as one string, null where one of them is."""
    whole = F.lit(True)
    for c in must:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.to_json(F.struct(*[F.col(c) for c in must])) if must else F.lit(""))


def searches(docs: Collection, queries: DataFrame, ways: Sequence[tuple[float, float]] = ((1.5, 0.75),), ranked: int = 1, k: int = 10, idf: DataFrame | None = None, must: Sequence[str] = (), least_should: int = 1) -> DataFrame:
    """way, query, doc, rank, score_0, score_1 ...: the k best documents of each query with a positive BM25 score, by each of the first ``ranked`` ways.

    A way is (k1, b); a row has its scores by the way that ranks it and by those that rank nothing, others are null. ``queries`` holds (query, term) and the columns ``must``, in which the documents have to agree; a term asked
    twice counts twice. Documents have ``least_should`` terms of the query at least. ``idf`` (term, idf) replaces the collection's own; terms that it lacks add nothing.
    Every cell of documents meets all queries and hands on its best ones, which decide among each other; pairs are not shuffled.
    """
    asked = queries.groupBy("query", "term").agg(F.count("*").alias("qtf"))
    weighed = asked.join(docs.idf() if idf is None else idf, "term", "left").select("query", "term", F.coalesce(F.col("qtf") * F.col("idf"), F.lit(0.0)).alias("w"))
    if least_should <= 1:
        weighed = weighed.filter("w <> 0")
    lists = weighed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    lists = lists.join(queries.select("query", _key(must).alias("key")).filter("key is not null").distinct(), "query") if must else lists.withColumn("key", F.lit(""))
    everywhere = lists.select(F.explode(F.sequence(F.lit(0), docs.cells - 1)).alias("cell"), "query", "key", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), docs.mean.alias("mean"))
    kinds = dict(queries.dtypes)["query"], dict(docs.docs.dtypes)["doc"]
    schema = f"way int, query {kinds[0]}, doc {kinds[1]}, " + ", ".join(f"score_{i} double" for i in range(len(ways)))
    found = docs.docs.groupBy("cell").cogroup(everywhere.groupBy("cell")).applyInArrow(cell_search(ways, ranked, k, least_should), schema)
    # The ways that rank share a column in the shuffle.
    own, others = F.coalesce(*[F.col(f"score_{i}") for i in range(ranked)]), [f"score_{i}" for i in range(ranked, len(ways))]
    best = top_k(found.select("way", "query", "doc", own.alias("score"), *others), ["way", "query"], [F.desc("score"), F.col("doc")], k)
    return best.select("way", "query", "doc", "rank", *[F.when(F.col("way") == i, F.col("score")).alias(f"score_{i}") for i in range(ranked)], *others)


def alike(queries: DataFrame) -> DataFrame:
    """query, of, t: the terms of each query with repeats, and the least query that asks the same. A null query is none."""
    asks = queries.filter("query is not null").groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("t"))
    return asks.withColumn("of", F.min("query").over(Window.partitionBy("t")))


def once(same: DataFrame) -> DataFrame:
    """query, term: of queries that ask the same (see ``alike``) the least one."""
    return same.filter("query = of").select("query", F.explode("t").alias("term"))


def for_all(found: DataFrame, same: DataFrame) -> DataFrame:
    """What was found for the least of the queries that ask the same, for each of them."""
    rows = found.withColumnRenamed("query", "of").join(same.select("query", "of"), "of")
    return rows.select(*found.columns)


def bm25(post: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, k: int = 10, idf: DataFrame | None = None) -> DataFrame:
    """query, doc, score, rank: the k best documents of each query with a positive score. ``post`` holds (doc, term, tf, doc_len); see ``searches``."""
    return best_of(searches(posted(post), queries, [(k1, b)], k=k, idf=idf))


def best_of(found: DataFrame) -> DataFrame:
    """query, doc, score, rank of searches that went one way."""
    return found.select("query", "doc", F.col("score_0").alias("score"), "rank")


def both_ways(found: DataFrame) -> DataFrame:
    """query, doc, a, b: searches that were ranked two ways as a row per pair, with the score of each way whose best ones it is among, else null."""
    score = lambda i: F.max(F.when(F.col("way") == i, F.col(f"score_{i}")))
    return found.groupBy("query", "doc").agg(score(0).alias("a"), score(1).alias("b"))


def combined_search(results: Sequence[tuple[DataFrame, float]], k: int) -> DataFrame:
    """query, doc, score, rank: weighted sum of several searches (field boosts, a second query over a first window)."""
    out = None
    for r, w in results:
        one = r.select("query", "doc", (F.col("score") * w).alias("score"))
        out = one if out is None else out.unionByName(one)
    total = out.groupBy("query", "doc").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_k(total, ["query"], [F.desc("score"), F.col("doc")], k)


def reranked(found: DataFrame, k: int) -> DataFrame:
    """The order of the second way among what the first one found; ``found`` is ranked by the first alone."""
    kept = found.select("query", "doc", F.col("score_1").alias("score")).filter("score > 0")
    return top_k(kept, ["query"], [F.desc("score"), F.col("doc")], k)


def rescored(both: DataFrame, weights: tuple[float, float] = (0.7, 1.2)) -> DataFrame:
    """What the first way found, ordered anew by the scores of both (see ``both_ways``); others are left out."""
    scored = both.filter("a is not null").select("query", "doc", (F.col("a") * weights[0] + F.coalesce("b", F.lit(0.0)) * weights[1]).alias("score"))
    return renumbered(scored.withColumn("_n", -F.col("score")), ["query"], ["_n", "doc"], "rank").drop("_n")


def fused(pairs: DataFrame, both: float = 2.0, only_a: float = 1.5, only_b: float = 0.5) -> DataFrame:
    """query, doc, score, rank from the scores of two searches (see ``both_ways``): weights by agreement, then scaled by the query's best score."""
    w = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).when(F.col("a").isNotNull(), only_a).otherwise(only_b)
    raw = pairs.select("query", "doc", (w * F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).alias("raw"))
    best = F.max("raw").over(Window.partitionBy("query"))
    scaled = raw.select("query", "doc", F.round(F.col("raw") / best, 9).alias("score"))
    return renumbered(scaled.withColumn("_n", -F.col("score")), ["query"], ["_n", "doc"], "rank").drop("_n")


def softmax_scores(rows: DataFrame, query: str, score: str) -> DataFrame:
    """``softmax``: scores of a query as shares that add up to one, from two combinable aggregates."""
    best = rows.groupBy(query).agg(F.max(score).alias("_m"))
    shifted = rows.join(best, query).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = shifted.groupBy(query).agg(F.sum("_e").alias("_s"))
    return shifted.join(total, query).withColumn("softmax", F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def ngrams(tokens: Column, sizes: Sequence[int]) -> Column:
    """All n-grams of the sizes, shorter sizes first."""
    return F.concat(*[_grams_of(tokens, n) for n in sizes])


def _grams_of(tokens: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def tfidf(post: DataFrame, most_share: float = 1.0, least_df: int = 1) -> DataFrame:
    """doc, term, weight: tf times the smooth idf log((1 + n) / (1 + df)) + 1, each document of length one.

    Terms in more than ``most_share`` of the documents or in fewer than ``least_df`` are left out.
    """
    n = post.agg(F.count_distinct("doc")).scalar()
    df = post.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") <= F.lit(most_share) * n) & (F.col("df") >= least_df))
    raw = post.join(df, "term").select("doc", "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Rows of an item that are paired in one task.
HOT_ROWS = 2000


def prefix_pairs(prefix: DataFrame, key: Sequence[str], id_column: str, carried: Sequence[str], hot: int = HOT_ROWS) -> DataFrame:
    """Pairs id_a < id_b of rows with the same key, with the ``carried`` columns of both.

    ``f`` bounds the rows of a key. A key with more than ``hot`` is split: the rows of one side go to one of its parts by hash, those of the other to all
    of them, so that no part of a hot key is more than about ``hot`` rows against all."""
    parts = F.ceil(F.col("f") / hot).cast("int")
    side = lambda x, part: prefix.select(*key, F.col(id_column).alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in carried], part.alias("_part"))
    a = side("a", F.pmod(F.xxhash64(id_column), parts).cast("int"))
    b = side("b", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return a.join(b, [*key, "_part"]).filter("id_a < id_b").drop("_part")


def jaccard_pairs(sets: DataFrame, scope: Sequence[str], id_column: str, items: str, least: float) -> DataFrame:
    """id_a < id_b, jaccard of pairs within a scope whose Jaccard similarity is at least ``least``.

    Prefix filter: items are ordered by rarity; two sets that similar share one of each one's first
    size - ceil(least * size) + 1 items, so only those are joined, and exact sets decide.
    """
    flat = sets.select(*scope, F.col(id_column).alias("id"), F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("s")).filter(F.size("s") > 0)
    freq = flat.select(*scope, F.explode("s").alias("item")).groupBy(*scope, "item").agg(F.count("*").alias("f"))
    ordered = flat.select(*scope, "id", F.explode("s").alias("item")).join(freq, [*scope, "item"])
    ordered = ordered.groupBy(*scope, "id").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("s"))
    kept = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * least).cast("int") + 1)
    prefix = ordered.select(*scope, "id", F.size("s").alias("n"), F.posexplode(kept).alias("pos", "x")).select(*scope, "id", "n", "pos", F.col("x.item").alias("item"), F.col("x.f").alias("f"))
    # Sets of sizes so unlike can't be similar, nor can those whose items from the shared one on are too few.
    sizes = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    places = F.lit(1 + least) * (1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1) >= F.lit(least) * (F.col("n_a") + F.col("n_b")) - 1e-9
    near = prefix_pairs(prefix, [*scope, "item"], "id", ["n", "pos"]).filter(sizes & places).select(*scope, "id_a", "id_b").distinct()
    full = ordered.select(*scope, F.col("id").alias("id_a"), F.transform("s", lambda x: x["item"]).alias("s_a"))
    both = near.join(full, [*scope, "id_a"]).join(full.withColumnsRenamed({"id_a": "id_b", "s_a": "s_b"}), [*scope, "id_b"])
    j = F.size(F.array_intersect("s_a", "s_b")) / F.size(F.array_union("s_a", "s_b"))
    return both.select(*scope, "id_a", "id_b", j.alias("jaccard")).filter(F.col("jaccard") >= least)


def overlapping_pairs(sets: DataFrame, id_column: str, items: str) -> DataFrame:
    """id_a, id_b (both ways), jaccard of all pairs that share an item. Pairs are counted from the postings, sets are not sent again."""
    flat = sets.select(F.col(id_column).alias("id"), F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("s"))
    posts = flat.select("id", F.size("s").alias("n"), F.explode("s").alias("item"))
    a, b = posts.withColumnsRenamed({"id": "id_a", "n": "n_a"}), posts.withColumnsRenamed({"id": "id_b", "n": "n_b"})
    shared = a.join(b, "item").filter("id_a <> id_b").groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("n"))
    return shared.select("id_a", "id_b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"))


def mean_jaccard(features: Sequence[tuple[Column, Column]]) -> Column:
    """Mean Jaccard similarity over pairs of feature sets; a pair of empty sets is passed over; null without any."""
    parts = [F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))) for a, b in features]
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept))


def cosine_pairs(weights: DataFrame, least: float, block: Sequence[str] = ()) -> DataFrame:
    """id_a < id_b, cosine of documents (doc, term, weight; each of length one) that reach ``least``.

    Prefix filter: terms are ordered by rarity, and a document's prefix ends where the rest of it is shorter than ``least``. The rarest term of a pair
    that reaches it stands in both prefixes, so only prefixes are joined; common terms are in few of them. Whole vectors decide."""
    df = weights.groupBy(*block, "term").agg(F.count("*").alias("df"))
    vectors = weights.join(df, [*block, "term"]).groupBy(*block, "doc").agg(F.array_sort(F.collect_list(F.struct("df", "term", "weight"))).alias("v"))
    # How many terms at the end stay shorter than ``least`` together.
    def longer(a: Column, x: Column) -> Column:
        s = a["s"] + x["weight"] * x["weight"]
        return F.when(s < least * least - 1e-9, F.struct(s.alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(2.0).alias("s"), a["k"].alias("k")))

    tail = F.aggregate(F.reverse("v"), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), longer, lambda a: a["k"])
    size = F.size("v") - tail
    prefix = vectors.select(*block, F.col("doc").alias("id"), F.explode(F.slice("v", F.lit(1), size)).alias("x")).select(*block, "id", "x.term", F.col("x.df").alias("f"))
    near = prefix_pairs(prefix, [*block, "term"], "id", []).select(*block, "id_a", "id_b").distinct()
    full = vectors.select(*block, F.col("doc").alias("id_a"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["term"], x["weight"]))).alias("v_a"))
    both = near.join(full, [*block, "id_a"]).join(full.withColumnsRenamed({"id_a": "id_b", "v_a": "v_b"}), [*block, "id_b"])
    dot = F.aggregate(F.map_values(F.map_zip_with("v_a", "v_b", lambda _, x, y: x * y)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return both.select(*block, "id_a", "id_b", F.round(dot, 9).alias("cosine")).filter(F.col("cosine") >= least)


def most_frequent(post: DataFrame, n: int, least_df: int = 1) -> DataFrame:
    """Postings of the ``n`` terms with the most occurrences among those in ``least_df`` documents or more."""
    best = post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= least_df).orderBy(F.desc("cf"), "term").limit(n)
    return post.join(best.select("term"), "term", "left_semi")


def recurrence(pairs: DataFrame, score: str) -> DataFrame:
    """n_ids, mean_best: mean over ids of the best similarity to another id."""
    both = pairs.select(F.col("id_a").alias("id"), score).unionByName(pairs.select(F.col("id_b").alias("id"), score))
    return both.groupBy("id").agg(F.max(score).alias("best")).agg(F.count("*").alias("n_ids"), F.round(F.avg("best"), 9).alias("mean_best"))


def keyword_hits(line: Column, words: Sequence[str]) -> Column:
    """Keywords in a line: phrases anywhere, words as whole words; a word right after "no" does not count."""
    low = F.lower(line)
    found = [F.when(low.contains(w) if " " in w else low.rlike(rf"(?<!(?<![a-z0-9_])no )(?<![a-z0-9_]){w}(?![a-z0-9_])"), F.lit(w)) for w in words]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def chunk_keywords(text: Column, most: int = 12) -> Column:
    """Distinct path-like or camel-case words or error words, the first ``most``."""
    words = F.regexp_extract_all(text, F.lit(rf"[\w./-]*/[\w./-]+\w|{EDGE}[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+{EDGE}|{EDGE}\w*(?:Error|Exception){EDGE}"), F.lit(0))
    return F.slice(F.array_distinct(words), 1, most)


def trace_lines(text: Column, most: int = 5, width: int = 160) -> Column:
    """The first lines that look like code or a trace, cut to ``width``."""
    hit = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf'^\s*File "|^\s*(?:at|def|class|raise|return|import|from)\s|{EDGE}\w+Error{EDGE}'))
    return F.slice(F.transform(hit, lambda x: F.left(F.trim(x), F.lit(width))), 1, most)


def document_text(parts: Sequence[tuple[str, Column]]) -> Column:
    """Labelled parts on lines of their own; null and empty parts are left out."""
    return F.concat_ws("\n", *[F.when(x != "", F.concat(F.lit(f"{label}: "), x)) for label, x in parts])


def snippet_range(text: Column, block: Column) -> Column:
    """struct<first, last> line numbers (from 1) of the first place of a block, null where it is not."""
    at = F.position(block, text)
    before = F.substr(text, F.lit(1), at - 1)
    first = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(at > 0, F.struct(first.alias("first"), (first + F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))).alias("last")))


def line_range(text: Column, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def squeeze(text: Column) -> Column:
    """Tabs as blanks, runs of blanks as one, blanks at line ends gone, three or more line feeds as two, trimmed."""
    out = F.regexp_replace(text, "\t", " ")
    for a, b in ((" {2,}", " "), (" +\n", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, a, b)
    return F.trim(out)


#: Marker strings of language models, and byte order marks (the second as its bytes read in a one-byte code).
MARKERS = ("<|endoftext|>", "<|startoftext|>", "<|end|>", "<|start|>", "<|im_start|>", "<|im_end|>")
MARKS_AT_START = (r"\A\x{FEFF}", r"\A\u00EF\u00BB\u00BF", r"\A[\x{FEFF}\x{FFFE}\x{FFFF}]+")


def cleaned(text: Column) -> Column:
    """Text without marker strings, byte order marks, NUL and control characters, composed (NFC), with at most one empty line and one blank in a row
    (the first blanks of a line are one more), and one line feed at the end where there was any. Only texts beyond ASCII reach Python, for the composition."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    out = text
    for marker in MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    for mark in MARKS_AT_START:
        out = F.regexp_replace(out, mark, "")
    out = F.replace(out, F.lit("\x00"), F.lit(""))
    beyond = F.when(out.rlike(r"[^\x00-\x7F]"), out)
    out = F.coalesce(compose(beyond), out)
    for pattern, new in ((r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), (r"\n{3,}", "\n\n"), (r"(?<=[^\n])[ \t]{2,}", " "), (r"\n+\z", "\n")):
        out = F.regexp_replace(out, pattern, new)
    return out


def without_fence(text: Column) -> Column:
    """The text inside a code fence, trimmed; other text only trimmed."""
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*(?:\n|\z)", ""), r"(?:\A|\n)[ \t]*```[^\n]*\z", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"\A\s+|\s+\z", "")).otherwise(t)


def close_json(text: str) -> str:
    """A JSON text that stops early, with what is open closed: a string, a value or a key left out, brackets in their order."""
    stack, in_text, escaped = [], False, False
    for i, ch in enumerate(text):
        if in_text:
            escaped, in_text = ch == "\\" and not escaped, ch != '"' or escaped
            continue
        if ch == '"':
            in_text = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack and stack[-1] == ch:
            stack.pop()
            if not stack:
                return text[: i + 1]
    out = (text[:-1] if escaped else text) + ('"' if in_text else "")
    for _ in range(3):  # a key without a value, half a word, a comma
        tail = re.sub(r'(?:,\s*|(?<=[{\[])\s*)(?:"(?:[^"\\]|\\.)*"\s*:?\s*)?[\w.+-]*\s*\Z', "", out)
        for candidate in (out, tail):
            try:
                json.loads(candidate + "".join(reversed(stack)))
            except ValueError:
                continue
            return candidate + "".join(reversed(stack))
        out = tail
    return out + "".join(reversed(stack))


def json_fields(text: Column) -> Column:
    """struct<how, fields>: the members of the one JSON object in a text, as text, and how they were read.

    whole: the text (without a code fence) is one; inner: what stands between the first and the last brace is; lenient: it is one with single quotes, names without
    quotes or commas before an end; closed: it stops early. how is null where there is none."""
    lenient = {k: "true" for k in ("allowSingleQuotes", "allowUnquotedFieldNames", "allowUnquotedControlChars", "allowNumericLeadingZeros", "allowBackslashEscapingAnyCharacter")}

    @F.pandas_udf("string")
    def close(texts: pd.Series) -> pd.Series:
        return texts.map(close_json, na_action="ignore")

    def strict(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, "map<string,string>"))

    plain = without_fence(text)
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    tidy = F.regexp_replace(inner, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")
    whole = F.when(plain.startswith("{"), strict(plain))
    ways = [("whole", whole), ("inner", strict(inner)), ("lenient", F.from_json(F.when(inner != "", tidy), "map<string,string>", lenient))]
    rest = F.when(F.coalesce(*[w for _, w in ways]).isNull(), F.regexp_extract(plain, r"(?s)\{.*", 0))
    ways.append(("closed", strict(close(F.when(rest != "", rest)))))
    how = F.when(F.lit(False), "")
    for name, way in ways:
        how = how.when(way.isNotNull(), name)
    return F.struct(how.alias("how"), F.coalesce(*[w for _, w in ways]).alias("fields"))


#: Fixed value: a Python function up to the next one, the next class or the end.
METHOD = r"(?ms)^[ \t]*(?:async[ \t]+)?def\s+\w+\s*\(.*?(?=^[ \t]*(?:async[ \t]+)?(?:def|class)\s|\z)"


def methods(source: Column, most: int = 800, head: int = 1000) -> Column:
    """array<struct<name, code>> of the functions of a Python source, each cut to ``most`` characters; the head of a source without any, with a null name."""
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)
    found = F.regexp_extract_all(source, F.lit(METHOD), F.lit(0))
    named = F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"def\s+(\w+)", 1).alias("name"), cut(m).alias("code")))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.left(source, F.lit(head)).alias("code")))
    return F.when(F.size(found) > 0, named).when(source.isNotNull(), alone)


def tool_names(text: Column, tools: Sequence[str]) -> Column:
    """Distinct tool names, sorted. Only ASCII word characters bound a name, as scripts without blanks write on."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9_])(?:{'|'.join(tools)})(?![a-z0-9_])"), F.lit(0))))


def python_outline(source: Column) -> Column:
    """array<struct<kind, name, first, last>> of a Python source; null where it does not parse."""

    @F.pandas_udf("array<struct<kind:string, name:string, first:int, last:int>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict] | None:
            try:
                tree = ast.parse(t or "")
            except (SyntaxError, ValueError, RecursionError):
                return None
            kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
            return [{"kind": kinds[type(n)], "name": n.name, "first": n.lineno, "last": n.end_lineno} for n in ast.walk(tree) if type(n) in kinds]

        return texts.map(one)

    return run(source)


_JAVA_SKIP = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.DOTALL)
_JAVA_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_JAVA_METHOD = re.compile(r"(\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?\Z")
_JAVA_FIELD = re.compile(r"[\w>\],?]\s+(\w+)\s*(?:\[\s*\])*\s*(?:=.*)?\Z", re.DOTALL)


def outline_java(text: str) -> list[dict]:
    """Types, methods and fields of a Java source with the type that holds them and their lines, by heads and braces; comments and strings are passed over."""
    # What is passed over keeps its line feeds, so that lines stay right.
    code = _JAVA_SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out, stack, head, head_line, line, round_ = [], [], "", 1, 1, 0
    for ch in code:
        if ch == "\n":
            line += 1
        in_type = not stack or stack[-1] is not None and stack[-1]["kind"] not in ("method",)
        if ch == "(":
            round_ += 1
        elif ch == ")":
            round_ = max(0, round_ - 1)
        if ch in "{};" and not (ch == ";" and round_):
            owner = next((x["name"] for x in reversed(stack) if x is not None and x["kind"] != "method"), None)
            plain, item = head.strip(), None
            if in_type and ch == "{" and (m := _JAVA_TYPE.search(plain)) is not None:
                item = {"kind": m[1], "name": m[2]}
            elif in_type and stack and "=" not in plain and (m := _JAVA_METHOD.search(plain)) is not None:
                item = {"kind": "method", "name": m[1]}
            elif in_type and stack and ch == ";" and "(" not in plain.split("=")[0] and (m := _JAVA_FIELD.search(plain)) is not None:
                item = {"kind": "field", "name": m[1]}
            if item is not None:
                item |= {"owner": owner, "first": head_line, "last": line}
                out.append(item)
            if ch == "{":
                stack.append(item)
            elif ch == "}" and stack:
                done = stack.pop()
                if done is not None:
                    done["last"] = line
            head, round_ = "", 0
        else:
            if not head.strip():
                head_line = line
            head += ch
    return out


def java_outline(source: Column) -> Column:
    """array<struct<kind, name, owner, first, last>> of a Java source."""

    @F.pandas_udf("array<struct<kind:string, name:string, owner:string, first:int, last:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(outline_java, na_action="ignore")

    return run(source)
