"""Cutting texts and lists into chunks.

Line windows are plain SQL. Greedy fills depend on what came before, so they run per text in Arrow
batches; texts are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrays import let

CHUNK = "struct<first:int, last:int, size:int, text:string>"


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def line_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<first, last, text>> of ``size`` lines that step back ``overlap`` lines each time."""
    step = size - overlap

    def of(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(lines) - overlap) / step).cast("int") - 1, F.lit(0)))
        return F.transform(starts, lambda i: F.struct((i * step + 1).alias("first"), F.least(i * step + size, F.size(lines)).alias("last"), F.array_join(F.slice(lines, i * step + 1, size), "\n").alias("text")))

    return let(F.split(text, "\n"), of)


def fill_lines(text: str, budget: int, overlap: int, size_of: Callable[[str], int]) -> list[dict]:
    """Greedy chunks of whole lines within the budget; each repeats up to ``overlap`` units of whole lines. A longer line is cut."""
    lines = []
    for line in text.split("\n"):
        while size_of(line) > budget:
            low, high = 1, len(line)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size_of(line[:mid]) <= budget else (low, mid - 1)
            lines.append(line[:low])
            line = line[low:]
        lines.append(line)
    sizes = [size_of(x) for x in lines]
    out, first = [], 0
    while first < len(lines):
        last, total = first, sizes[first]
        while last + 1 < len(lines) and total + sizes[last + 1] <= budget:
            last += 1
            total += sizes[last]
        out.append({"first": first + 1, "last": last + 1, "size": total, "text": "\n".join(lines[first : last + 1])})
        if last + 1 >= len(lines):
            break
        back, kept = last + 1, 0
        while back - 1 > first and kept + sizes[back - 1] <= overlap and kept + sizes[back - 1] + sizes[last + 1] <= budget:
            back -= 1
            kept += sizes[back]
        first = back
    return out


def filled_chunks(text: Column, budget: int, overlap: int, per_token: int = 4) -> Column:
    """Chunks of a token budget, a token being ``per_token`` characters."""

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else fill_lines(t, budget, overlap, lambda x: -(-len(x) // per_token)))

    return run(text)


def pack_in_order(parts: list[str], budget: int) -> list[str]:
    """Parts joined in order while they fit the budget of characters; a larger one stands alone."""
    out, open_parts, size = [], [], 0
    for part in parts:
        if open_parts and size + len(part) > budget:
            out.append("".join(open_parts))
            open_parts, size = [], 0
        open_parts.append(part)
        size += len(part)
    return [*out, "".join(open_parts)] if open_parts else out


def packed_sections(parts: Column, budget: int) -> Column:
    """``pack_in_order`` of an array of texts; each is passed over once."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: None if x is None else pack_in_order(list(x), budget))

    return run(parts)


def size_strategy(tokens: Column, full: int, chunked: int) -> Column:
    return F.when(tokens <= full, "full").when(tokens <= chunked, "chunked").otherwise("summarised")


def numbered_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """chunk: rows of a key in groups of ``size`` by their order."""
    from quarryline.operators.windows import renumbered

    return renumbered(rows, keys, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def next_fit(sizes: list[int], budget: int) -> list[int]:
    """Bin of each item: items by falling size go to the open bin while they fit; an item over the budget has its own."""
    out, bin_no, used = [0] * len(sizes), -1, budget + 1
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if used + sizes[i] > budget:
            bin_no, used = bin_no + 1, 0
        out[i] = bin_no
        used += sizes[i]
    return out


def packed(items: Column, budget: int) -> Column:
    """Bin of each size of an array, by next fit on falling sizes."""

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else next_fit([int(v) for v in x], budget))

    return run(items)


def cut_middle(text: Column, most: int, note: str = "\n...\n") -> Column:
    """Both ends of a text longer than ``most``, with a note between."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(note), F.right(text, F.lit(most - half)))).otherwise(text)


def cluster_chunks(clusters: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """keys, component, chunk of items with (component, size): whole components while they fit, larger ones cut by running size."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys, "component").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return clusters.withColumn("chunk", F.floor((F.sum("size").over(w) - 1) / budget).cast("int"))
