"""Curation of labels and nested columns, and updates by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrays import let
from quarryline.operators.joins import first_per_key


def canonical(label: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """The canonical name of a label, itself where no synonym fits; compared without case and outer spaces."""
    low = F.lower(F.trim(label))
    out = F.when(F.lit(False), "")
    for name, others in synonyms.items():
        out = out.when(low.isin(name.lower(), *[o.lower() for o in others]), name)
    return out.otherwise(F.trim(label))


def aligned_distinct(labels: Column, subs: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """array<struct<label, sub>>: canonical labels, first of each kept with its sub-label, blanks dropped, missing subs ''."""
    zipped = F.transform(labels, lambda x, i: F.struct(canonical(x, synonyms).alias("label"), F.coalesce(F.get(subs, i), F.lit("")).alias("sub")))
    kept = F.filter(zipped, lambda z: z["label"] != "")
    first = lambda k, names: F.filter(k, lambda z, i: F.array_position(names, z["label"]) == i + 1)
    return let(kept, lambda k: let(F.transform(k, lambda z: z["label"]), lambda names: first(k, names)))


def updated_labels(old: Column, new: Column, mode: Column) -> Column:
    """replace: the new ones; add: old then new ones; remove: old without new ones. Any other mode and null: the old ones."""
    o, n = F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    return F.when(mode == "replace", F.array_distinct(n)).when(mode == "add", F.array_union(o, n)).when(mode == "remove", F.array_except(o, n)).otherwise(old)


def apply_batch(rows: DataFrame, updates: DataFrame, key: str, labels: str) -> DataFrame:
    """Rows with updates (key, seq, mode, new) folded in order of ``seq``; an update array is bounded by the updates of one key."""
    steps = updates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "mode", "new"))).alias("_u"))
    start = F.coalesce(labels, F.array().cast("array<string>"))
    folded = F.aggregate("_u", start, lambda acc, u: updated_labels(acc, u["new"], u["mode"]))
    return rows.join(steps, key, "left").withColumn(labels, F.when(F.col("_u").isNull(), F.col(labels)).otherwise(folded)).drop("_u")


def violations(rows: DataFrame, key: str, labels: str, subs: str, known: Sequence[str], universe: DataFrame) -> DataFrame:
    """key, rule: repeated, missing and extra keys, rows without a label, arrays of unequal length, unknown labels."""
    rule = lambda d, name: d.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("rule"))
    repeated = rule(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    missing = rule(universe.select(key).distinct().join(rows.select(key), key, "left_anti"), "missing")
    extra = rule(rows.select(key).distinct().join(universe.select(key), key, "left_anti"), "extra")
    uneven = rule(rows.filter(F.coalesce(F.size(labels), F.lit(0)) != F.coalesce(F.size(subs), F.lit(0))), "length")
    unknown = rule(rows.filter(F.exists(labels, lambda x: ~x.isin(*known))), "unknown_label")
    empty = rule(rows.filter(F.coalesce(F.size(labels), F.lit(0)) == 0), "empty")
    return repeated.unionByName(missing).unionByName(extra).unionByName(empty).unionByName(uneven).unionByName(unknown)


def raise_on(found: DataFrame, most: int = 20) -> None:
    """Raises with the first few violations, if there are any."""
    some = found.limit(most).collect()
    if some:
        raise ValueError("; ".join(f"{r['key']}: {r['rule']}" for r in some))


def upsert(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with those of ``new`` in their place: keys of ``new`` replace all rows of that key. ``new`` has one row a key."""
    return rows.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_values(rows: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All rows of a key take the new values; null new values leave the old."""
    n = first_per_key(new, [key], [F.col(c) for c in columns]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(n, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop(*[f"_{c}" for c in columns])


def label_cell(text: Column) -> Column:
    """array of labels from a cell that is a JSON list, a list in single quotes, one label, or nothing."""
    t = F.trim(text)
    listed = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>"))
    many = F.filter(listed, lambda x: F.trim(x) != "")
    return F.when(t.isNull() | t.isin("", "nan", "None", "null"), F.array().cast("array<string>")).when(t.startswith("[") & listed.isNotNull(), many).otherwise(F.array(t))


def failed_steps_or_first(failed: Column, steps: Column) -> Column:
    """Steps of a job that failed, in order; the first step if none is named."""
    kept = F.filter(steps, lambda s: F.array_contains(failed, s))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.slice(steps, 1, 1))


def job_step_names(name: Column, steps: Column) -> Column:
    """"job: step" per step, or the job alone where it has no named step."""
    named = F.filter(steps, lambda s: F.trim(s) != "")
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, F.transform(named, lambda s: F.concat(name, F.lit(": "), s))).otherwise(F.array(name))


def merged_struct(old: Column, new: Column, fields: Sequence[str]) -> Column:
    """Field by field the later value, the earlier one where it is null."""
    return F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])
