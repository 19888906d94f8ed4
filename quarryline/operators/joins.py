"""Lookups, upserts, interval and fuzzy joins.

Keys that are null match nothing. Where a key repeats on the lookup side, an explicit order chooses one
row before the join, so no join multiplies rows by accident. No join here is a cross join: intervals are
joined through buckets, OR-keys through one equi-join per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Spark turns the rank filter into a group limit before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").select(*keys, *rest)


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join with defaults for what has no match."""
    out = rows.join(table, list(keys), "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(c, v if isinstance(v, Column) else F.lit(v)))
    return out


def suffixed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join in which columns of both sides get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select(*[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in right.columns])
    return a.join(b, list(keys), how)


def merge_records(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer merge of sources with one row per key each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out


def either_key(rows: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str]], id_column: str, order: Sequence[str]) -> DataFrame:
    """First match where any pair of keys is equal: one equi-join per pair, earlier pairs first, then ``order``."""
    hits = None
    for i, (a, b) in enumerate(keys):
        one = rows.select(id_column, F.col(a).alias("_k")).join(table.withColumn("_k", F.col(b)), "_k").drop("_k").withColumn("_pair", F.lit(i))
        hits = one if hits is None else hits.unionByName(one)
    return first_per_key(hits, [id_column], [F.col("_pair"), *[F.col(c) for c in order]]).drop("_pair")


def overlapping(left: DataFrame, right: DataFrame, scope: Sequence[str], width: int, a: tuple[str, str] = ("a_start", "a_end"), b: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs of one scope whose closed intervals overlap.

    An interval has the level whose buckets (``width`` times a power of two) are as long as it, so that it touches two of them at most. Of a pair the
    interval of the lower level looks the other one up at that one's level, so the joins have equal keys only and no interval gives more
    than two rows a level, however long it is. A pair is kept in the one bucket where the later of the two begins.
    """
    span = lambda s, e, at: F.sequence(F.floor(F.col(s) / at), F.floor(F.col(e) / at))
    at_level = lambda k: F.pow(F.lit(2.0), k) * width
    level = lambda s, e: F.greatest(F.ceil(F.log2((F.col(e) - F.col(s) + 1) / F.lit(float(width)))), F.lit(0)).cast("int")

    def side(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return rows.filter(F.col(ends[0]) <= F.col(ends[1])).withColumn("_own", level(*ends))

    def own(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return rows.withColumn("_level", F.col("_own")).withColumn("_bucket", F.explode(span(*ends, at_level(F.col("_own"))))).drop("_own")

    def above(rows: DataFrame, ends: tuple[str, str], other: DataFrame, least: int) -> DataFrame:
        top = other.agg(F.coalesce(F.max("_own"), F.lit(0))).scalar()
        levels = F.when(F.col("_own") + least <= top, F.sequence(F.col("_own") + least, top))
        return rows.withColumn("_level", F.explode(levels)).withColumn("_bucket", F.explode(span(*ends, at_level(F.col("_level"))))).drop("_own")

    x, y, key = side(left, a), side(right, b), [*scope, "_level", "_bucket"]
    low = above(x, a, y, 0).join(own(y, b), key)
    high = own(x, a).join(above(y, b, x, 1), key)
    both = low.unionByName(high).filter((F.col(a[0]) <= F.col(b[1])) & (F.col(a[1]) >= F.col(b[0])))
    return both.filter(F.col("_bucket") == F.floor(F.greatest(a[0], b[0]) / at_level(F.col("_level")))).drop("_level", "_bucket")


def tightest_enclosing(points: DataFrame, spans: DataFrame, scope: Sequence[str], point_id: str, width: int, p: tuple[str, str] = ("a_start", "a_end"), s: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Per point interval the narrowest span that holds it whole."""
    held = overlapping(points, spans, scope, width, p, s).filter((F.col(s[0]) <= F.col(p[0])) & (F.col(s[1]) >= F.col(p[1])))
    return first_per_key(held, [point_id], [F.col(s[1]) - F.col(s[0]), F.col(s[0])])


def import_match(imports: DataFrame, modules: DataFrame, scope: Sequence[str], name: str, module: str) -> DataFrame:
    """Pairs of one scope where the import equals the module or ends in a dot and the module: all dotted suffixes of the import, then one equi-join."""
    parts = F.split(F.col(name), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return imports.withColumn(module, F.explode(F.array_distinct(suffixes))).join(modules, [*scope, module])


def best_path_match(wanted: DataFrame, files: DataFrame, wanted_path: str, path: str) -> DataFrame:
    """Per wanted path the file with the longest common run of trailing parts; among those the path that sorts first.

    ``score`` is the number of parts in common. Of each suffix of the files only the first path is kept, so
    that a base name that many files share joins one row and not all of them. Null and repeated paths are
    taken out first; a path without a file of its base name has no row.
    """

    def suffixes(c: str) -> Column:
        parts = F.split(F.col(c), "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("score"), F.array_join(F.slice(parts, -n, n), "/").alias("suffix"))))

    clean = lambda d, c: d.select(c).filter(F.col(c).isNotNull()).distinct()
    first = clean(files, path).select(path, suffixes(path).alias("x")).groupBy("x.suffix").agg(F.min(path).alias(path))
    asked = clean(wanted, wanted_path).select(wanted_path, suffixes(wanted_path).alias("x")).select(wanted_path, "x.*")
    best = asked.join(first, "suffix").groupBy(wanted_path).agg(F.max_by(F.struct("score", path), "score").alias("b"))
    return best.select(wanted_path, f"b.{path}", "b.score")


def in_both_ends(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    out = edges
    for e in ends:
        out = out.join(nodes.select(F.col("node").alias(e)), e, "left_semi")
    return out


def earlier_best(rows: DataFrame, pairs: DataFrame, id_column: str, date: str, score: str) -> DataFrame:
    """Per row the best score against rows of an earlier date, from ``pairs`` (id_a, id_b, score)."""
    dates = rows.select(F.col(id_column).alias("id_a"), F.col(date).alias("date_a"))
    both = pairs.join(dates, "id_a").join(dates.select(F.col("id_a").alias("id_b"), F.col("date_a").alias("date_b")), "id_b")
    return both.filter("date_b < date_a").groupBy("id_a").agg(F.max(score).alias("best"))
