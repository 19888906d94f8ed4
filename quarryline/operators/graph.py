"""Graphs as edge tables: components, PageRank, neighbourhoods.

Iterations are checkpointed, so that the plan does not grow and lost executors cost one iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarryline.session import ensure_checkpoint_dir


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (the least node) of undirected edges (src, dst), by alternating large and small stars.

    Each round maps every node's neighbours to the least of them; the number of rounds grows with the
    logarithm of the longest path. Aggregates combine before the shuffle and stars are emitted per edge, so
    a hot node is never gathered in one task. Isolated nodes come as edges to themselves. Raises where ``most_rounds`` do not suffice.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node is not null").distinct()
    e = edges.filter("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        # The edge set is stable when its count and hash are: two numbers reach the driver, seen while the round is written.
        seen = Observation()
        e = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).checkpoint()
        now = (seen.get["n"], seen.get["h"])
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, bias: DataFrame | None = None) -> DataFrame:
    """node, rank of weighted directed edges (src, dst, w); ranks add up to one.

    Dangling nodes give their rank to all nodes by the bias, which is even or given as (node, bias).
    A fixed number of rounds makes runs comparable. Ranks are checkpointed each round, as the next round reads
    them twice.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).checkpoint()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.agg(F.count("*")).scalar()
    if bias is None:
        start = nodes.withColumn("bias", F.lit(1.0) / n)
    else:
        known = nodes.join(bias, "node", "left").fillna(0.0, ["bias"])
        start = known.withColumn("bias", F.try_divide(F.col("bias"), known.agg(F.sum("bias")).scalar()))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    flow = e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")).checkpoint()
    start = start.join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left").fillna(False, ["gives"]).checkpoint()
    ranks = start.withColumn("rank", F.col("bias"))
    for _ in range(rounds):
        given = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        dangling = ranks.filter("not gives").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        ranks = start.join(given, "node", "left").withColumn("rank", (1 - damping) * F.col("bias") + damping * (F.coalesce("got", F.lit(0.0)) + dangling * F.col("bias"))).drop("got").checkpoint()
    return ranks.select("node", "rank")


def term_graph(docs: DataFrame, doc: str, tokens: Column, window: int = 5) -> DataFrame:
    """doc, src < dst, w: how often a term is one of the ``window`` that follow another.

    Documents are partitioned before their pairs are made, so that terms travel and pairs do not; rows of one ``doc`` meet in one task.
    """
    pairs = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice("_t", i + 2, window), lambda y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")))))
    rows = docs.select(F.col(doc).alias("doc"), tokens.alias("_t")).filter(F.size("_t") > 1).repartition(F.col("doc"))
    return rows.select("doc", F.explode(pairs).alias("p")).filter("p.src <> p.dst").groupBy("doc", "p.src", "p.dst").agg(F.count("*").alias("w"))


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and all ends of edges that touch one."""
    out = edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return seeds.select("node").union(out).union(into).distinct()


def callers(edges: DataFrame, keys: Sequence[str], callee: str) -> DataFrame:
    """Per key the distinct callees in order and their number."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set(callee)).alias("callees")).withColumn("n", F.size("callees"))


def filtered_clusters(clusters: Column, keep: Column) -> Column:
    """Clusters (arrays of nodes) with only the nodes of ``keep``; empty ones are left out."""
    return F.filter(F.transform(clusters, lambda c: F.array_intersect(c, keep)), lambda c: F.size(c) > 0)


def bounded_summary(items: Column, most: int) -> Column:
    """struct<shown, total, truncated>: a report of the first ``most`` items."""
    return F.struct(F.slice(items, 1, most).alias("shown"), F.size(items).alias("total"), (F.size(items) > most).alias("truncated"))
