"""Splitting oversized items at natural boundaries by agglomerative merging.

An item is first taken apart into atoms: the coarsest segments (file sections, then sections at
hunks, then lines, then slices of a line; for changes: changes, then slices of a change) that fit
the limit. Adjacent atoms are held as pairs in a heap ordered by the strength of the boundary
between them; the weakest boundary is merged first while the combined size plus the overlap fits.
Each piece then repeats whole lines (changes) from the end of the piece before, up to the overlap
and as far as the limit leaves room. Joining the pieces without their overlaps gives back the item.

An item's ``cut_level`` is the weakest boundary that is left between its pieces.

Items within the limit never reach Python: their length is checked in the JVM.

Defined cases: null and empty items have no pieces; an item at the limit is not cut; rows repeated
with the same id and content are one item; null elements of a list of changes have no characters
and are kept in their place; null before or after counts as no characters and stays null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 6000
OVERLAP = 200
FRAME_CHARS = 8_000_000

#: Strength of the boundary before an atom, weakest first.
DIFF_LEVELS = ("inside_line", "line", "hunk", "file")
CHANGE_LEVELS = ("inside_change", "change")

PIECE = "struct<piece_no:int, cut_before:string, n_chars:int, overlap_chars:int, text:string, changes:array<struct<pos:int, part:int, line:int, before:string, after:string, change_type:string, repeated:boolean>>>"
RESULT = f"struct<cut_level:string, pieces:array<{PIECE}>>"


def _sections(lines: list[tuple[int, int]], text: str, starts: tuple[str, ...]) -> list[tuple[int, int]]:
    """Runs (first, end) of line numbers, each beginning at a line with one of ``starts``."""
    cuts = [i for i, (a, _) in enumerate(lines) if i and text.startswith(starts, a)]
    edges = [0, *cuts, len(lines)]
    return list(zip(edges, edges[1:], strict=False))


def diff_atoms(text: str, limit: int) -> list[tuple[int, int, int]]:
    """The item's atoms (start, end, strength of the boundary before), end without the line feed after it."""
    lines, at = [], 0
    while True:
        stop = text.find("\n", at)
        lines.append((at, len(text) if stop < 0 else stop))
        if stop < 0:
            break
        at = stop + 1
    atoms: list[tuple[int, int, int]] = []

    def add(first: int, end: int, strength: int) -> None:
        a, b = lines[first][0], lines[end - 1][1]
        if b - a <= limit:
            atoms.append((a, b, strength))
            return
        inner = [(first + x, first + y) for x, y in _sections(lines[first:end], text, ("diff --git ", "@@ "))] if strength == 3 else []
        if strength == 3:
            for k, (x, y) in enumerate(inner):
                add_hunk(x, y, 3 if k == 0 else 2)
        else:
            add_hunk(first, end, strength)

    def add_hunk(first: int, end: int, strength: int) -> None:
        a, b = lines[first][0], lines[end - 1][1]
        if b - a <= limit:
            atoms.append((a, b, strength))
            return
        for k in range(first, end):
            a, b = lines[k]
            before = strength if k == first else 1
            for x in range(a, max(b, a + 1), limit):
                atoms.append((x, min(b, x + limit), before if x == a else 0))

    for first, end in _sections(lines, text, ("diff --git ",)):
        add(first, end, 3)
    return atoms


def merge_atoms(sizes: list[int], gaps: list[int], strengths: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs (first, end) of atoms after agglomerative merging.

    ``gaps[i]`` characters join atom i to the one before. The heap holds adjacent pairs by (strength,
    combined size, position); a pair that does not fit is dropped, as sizes only grow.
    """
    n = len(sizes)
    end = list(range(1, n + 1))
    size = list(sizes)
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[i], sizes[i - 1] + gaps[i] + sizes[i], i - 1, i, sizes[i - 1], sizes[i]) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, a, b, size_a, size_b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or size[a] != size_a or size[b] != size_b or end[a] != b:
            continue
        # The first piece repeats nothing, so it needs no room for the overlap.
        if total + (overlap if a > 0 else 0) > limit:
            continue
        alive[b], end[a], size[a] = False, end[b], total
        right = end[a]
        if right < n:
            left[right] = a
            heapq.heappush(heap, (strengths[right], total + gaps[right] + size[right], a, right, total, size[right]))
        before = left[a]
        if before >= 0:
            heapq.heappush(heap, (strengths[a], size[before] + gaps[a] + total, before, a, size[before], total))
    return [(i, end[i]) for i in range(n) if alive[i]]


def split_diff(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[dict]]:
    """The cut level and the pieces of one diff of more than ``limit`` characters."""
    atoms = diff_atoms(text, limit)
    # Gap: the line feed between atoms of different lines.
    gaps = [0] + [atoms[i][0] - atoms[i - 1][1] for i in range(1, len(atoms))]
    runs = merge_atoms([b - a for a, b, _ in atoms], gaps, [s for *_, s in atoms], limit, overlap)
    pieces, before, whole = [], "", True
    for no, (first, end) in enumerate(runs):
        # A piece ends after the line feed that parts it from the next, except where that would pass the limit.
        start = atoms[first][0]
        own = text[start : atoms[end - 1][1]]
        room = min(overlap, limit - len(own))
        repeat = _tail_lines(before, whole, room) if no and atoms[first][2] > 0 else ""
        pieces.append({"piece_no": no, "cut_before": DIFF_LEVELS[atoms[first][2]] if no else None, "n_chars": len(repeat) + len(own), "overlap_chars": len(repeat), "text": repeat + own, "changes": None})
        before, whole = own, no == 0 or atoms[first][2] > 0
    return _level(pieces, DIFF_LEVELS), pieces


def _level(pieces: list[dict], levels: tuple[str, ...]) -> str:
    """The weakest boundary at which the pieces were cut."""
    return levels[min((levels.index(p["cut_before"]) for p in pieces[1:]), default=len(levels) - 1)]


def _tail_lines(text: str, starts_line: bool, room: int) -> str:
    """Whole lines from the end of ``text``, each with its line feed, of at most ``room`` characters.

    ``starts_line``: whether the first line of ``text`` is whole.
    """
    start = len(text) + 1
    while start > 0:
        cut = text.rfind("\n", 0, start - 1) + 1
        if len(text) + 1 - cut > room or (cut == 0 and not starts_line):
            break
        start = cut
    return text[start:] + "\n" if start <= len(text) else ""


def split_changes(changes: list[dict | None], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[dict]]:
    """The cut level and the pieces of one list of changes of more than ``limit`` characters."""
    atoms: list[tuple[dict, int, int]] = []
    for pos, c in enumerate(changes):
        c = dict(c) if c is not None else {"line": None, "before": None, "after": None, "change_type": None}
        size = len(c["before"] or "") + len(c["after"] or "")
        if size <= limit:
            atoms.append((c | {"pos": pos, "part": 0, "repeated": False}, size, 1))
            continue
        part = 0
        for side in ("before", "after"):
            for x in range(0, len(c[side] or ""), limit):
                cut = {"line": c["line"], "change_type": c["change_type"], "before": None, "after": None, side: c[side][x : x + limit]}
                atoms.append((cut | {"pos": pos, "part": part, "repeated": False}, len(cut[side]), 1 if part == 0 else 0))
                part += 1
    runs = merge_atoms([s for _, s, _ in atoms], [0] * len(atoms), [s for *_, s in atoms], limit, overlap)
    pieces, before = [], []
    for no, (first, end) in enumerate(runs):
        own = atoms[first:end]
        size = sum(s for _, s, _ in own)
        repeat, room = [], min(overlap, limit - size)
        for c, s, _ in reversed(before) if no and atoms[first][2] > 0 else ():
            if s > room or c["part"]:
                break
            repeat.insert(0, c | {"repeated": True})
            room -= s
        over = sum(len(c["before"] or "") + len(c["after"] or "") for c in repeat)
        pieces.append({"piece_no": no, "cut_before": CHANGE_LEVELS[atoms[first][2]] if no else None, "n_chars": size + over, "overlap_chars": over, "text": None, "changes": repeat + [c for c, _, _ in own]})
        before = own
    return _level(pieces, CHANGE_LEVELS), pieces


def _frames(cuts: Iterator[tuple[str, list[dict]]]) -> Iterator[pd.DataFrame]:
    """Frames of items until their pieces pass ``FRAME_CHARS``, so that no batch of large items is held cut at once."""
    done, size = [], 0
    for cut in cuts:
        done.append(cut)
        size += sum(p["n_chars"] for p in cut[1])
        if size >= FRAME_CHARS:
            yield pd.DataFrame({"cut_level": [x for x, _ in done], "pieces": [p for _, p in done]})
            done, size = [], 0
    if done:
        yield pd.DataFrame({"cut_level": [x for x, _ in done], "pieces": [p for _, p in done]})


def changes_chars(changes: Column) -> Column:
    """Characters of before and after over all changes, null as 0."""
    return F.aggregate(changes, F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.length(c["before"]), F.lit(0)) + F.coalesce(F.length(c["after"]), F.lit(0)))


def split_oversized(items: DataFrame, item_table: str, id_column: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_table, item_id, cut_level, pieces: one row per row of ``items`` whose ``content`` passes the limit.

    ``content`` is a string column (a diff) or an array of changes.
    """
    is_text = dict(items.dtypes)[content] == "string"
    long = items.select(F.col(id_column).alias("item_id"), F.col(content).alias("content")).filter((F.length("content") if is_text else changes_chars(F.col("content"))) > limit)

    @F.pandas_udf(RESULT)
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield from _frames(split_diff(t, limit, overlap) for t in texts)

    @F.pandas_udf(RESULT)
    def of_changes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            yield from _frames(split_changes(list(x), limit, overlap) for x in lists)

    cut = (of_text if is_text else of_changes)(F.col("content"))
    return long.withColumn("cut", cut).select(F.lit(item_table).alias("item_table"), "item_id", "cut.cut_level", "cut.pieces")


def one_per_item(cuts: DataFrame) -> DataFrame:
    """item_table, item_id, cut_level, each item once. Only these small columns are shuffled."""
    return cuts.select("item_table", "item_id", "cut_level").distinct()


def pieces_of(cuts: DataFrame) -> DataFrame:
    """One row per piece; repeated rows of the same item give their pieces once."""
    rows = cuts.select("item_table", "item_id", "cut_level", F.explode("pieces").alias("p")).select("item_table", "item_id", "cut_level", "p.*")
    return rows.withColumn("_content", F.xxhash64("text", F.to_json("changes"))).dropDuplicates(["item_table", "item_id", "piece_no", "_content"]).drop("_content")
