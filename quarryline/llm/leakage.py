"""Passages of evaluation items in a corpus: seeds, SimHash of item-sized windows, exact verification.

The items are a stated query set; they are indexed in blocks of a bounded number of words and each
block is sent to every task. Documents are read in Arrow batches, without a shuffle; where there are several blocks,
the documents' normal form is written once and each block reads that.

1. Words: the look-alike normal form without line prefixes, case-folded, runs of letters and digits.
2. Seeds. A window of 20 words in which a quarter is replaced, dropped or added still shares at least
   three word triples with its item (each edit destroys at most three of the 18), so windows without
   three shared triples close together are dropped without loss.
3. SimHash. Around the seeds, windows of the document and of the item on the seeds' diagonals get
   weighted 128-bit fingerprints (words weighted by their rarity among items); pairs beyond the
   Hamming radius go, unless the stretch around their seeds has words enough for a run of step 4.
4. Verification. Some run of at least ``WINDOW`` blank-separated words of the item (or all of it) must
   stand in the document with at most ``CHANGED`` of its words replaced, dropped or added, wherever the
   changes are and however rare the words. Passages changed a little more still count where the best local
   alignment matches ``MATCHED_WORDS`` words and ``SIMILARITY`` of the weight of the aligned item words.

The method's multi-index over Hamming blocks gives way to the seeds of step 2 as the index. With a
quarter of the words changed, windows are up to 32 of 128 bits apart (measured), and the radius is 36; a
guarantee for it needs 37 blocks of three or four bits, in one of which a window meets 97 % of all item
windows by chance, so the blocks would select next to nothing, while the seeds are as lossless and
select 0.1 % (README has the figures).

Defined cases: null, empty and blank texts match nothing; an item of fewer than ``WINDOW`` words
must be there whole as one window; equal items each get their rows; repeated documents with
one id give one row per item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quarryline.llm.lookalike import normal_form
from quarryline.session import materialize

WINDOW = 20
SEED = 3
LEAST_SEEDS = 3
SEED_REACH = 25
BITS = 128
RADIUS = 36
DRIFT = 8
PLACE = 2 * DRIFT
#: Diagonals with the most seeds on which a run is looked for without the edit distance.
DIAGONALS = 3
STRETCH = 1000
LEAST_SCORE = 8
MATCHED_WORDS = 13
SIMILARITY = 0.7
CHANGED = 0.25
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
#: What loggers put before a line: time stamps, tags in brackets, line numbers. Quote marks and bullets are no words anyway.
_LINE_PREFIX = re.compile(r"(?m)^[^\w\n]*(?:\d{4}-\d\d-\d\d[T ][\d:.,]+Z?(?:[+-]\d\d:?\d\d)?[^\w\n]+|\[[^\]\n]{1,20}\][^\w\n]*|\d{1,6}[:|][^\w\n]+)+")


def _plain(text: str) -> str:
    return _LINE_PREFIX.sub("", normal_form(text)).casefold()


def words_of(text: str) -> list[str]:
    return _WORD.findall(_plain(text))


def item_words(text: str) -> tuple[list[str], list[int]]:
    """The words and, for each, the number of the blank-separated word that holds it."""
    return _parted(_plain(text))


def _parted(plain: str) -> tuple[list[str], list[int]]:
    words, owner = [], []
    for n, part in enumerate(plain.split()):
        found = _WORD.findall(part)
        words += found
        owner += [n] * len(found)
    return words, owner


def _signs(word: str) -> np.ndarray:
    digest = xxhash.xxh128_digest(word.encode("utf-8", "surrogatepass"))
    return np.unpackbits(np.frombuffer(digest, np.uint8)).astype(np.float32) * 2 - 1


def _fingerprints(weighted: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints (n, 2) of all windows of rows of ``weighted`` (words, BITS)."""
    total = np.zeros((len(weighted) + 1, BITS), np.float32)
    np.cumsum(weighted, axis=0, out=total[1:])
    width = min(window, len(weighted))
    return np.packbits((total[width:] - total[:-width]) > 0, axis=1).view(np.uint64)


@dataclass
class ItemIndex:
    """One block of items; its size is bounded by ``BLOCK_WORDS``."""

    items: list[tuple[int, list[str], list[int]]]
    radius: int = RADIUS
    beyond: bool = True
    number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        df = Counter(w for _, words, _ in self.items for w in set(words))
        n = len(self.items)
        self.number = {w: i for i, w in enumerate(df)}
        self.weight = np.array([math.log((n + 1) / c) for c in df.values()], np.float32)
        # A word no item has weighs half of what an item's word does on average: changed words count, but do not drown the rest.
        tokens = sum(len(words) for _, words, _ in self.items)
        self.foreign = 0.5 * sum(float(self.weight[self.number[w]]) for _, words, _ in self.items for w in words) / max(1, tokens)
        self.vectors = np.stack([_signs(w) for w in self.number]) * self.weight[:, None] if self.number else np.zeros((0, BITS), np.float32)
        self.codes = [np.array([self.number[w] for w in words], np.int64) for _, words, _ in self.items]
        self.parts = [np.array(owner, np.int64) for _, _, owner in self.items]
        self.part_weight = [1 / np.bincount(p)[p] for p in self.parts]
        # An item shorter than the window is one window of its own length.
        self.widths = [min(WINDOW, len(c)) for c in self.codes]
        self.prints = [_fingerprints(self.vectors[c], w) if len(c) else np.zeros((0, 2), np.uint64) for c, w in zip(self.codes, self.widths, strict=True)]
        base = len(self.number) + 1
        keys, owner, place = [], [], []
        for i, c in enumerate(self.codes):
            if len(c) >= SEED:
                keys.append((c[:-2] * base + c[1:-1]) * base + c[2:])
                owner.append(np.full(len(c) - 2, i))
                place.append(np.arange(len(c) - 2))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.base = base
        self.keys = flat[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        # The words of all items in a row.
        sizes = [len(c) for c in self.codes]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flat = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int64)
        self.flat_weight = np.concatenate(self.part_weight) if self.codes else np.zeros(0)
        self.flat_first = np.concatenate([np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool) for p in self.parts]) if self.codes else np.zeros(0, bool)
        self.n_parts = np.array([int(p[-1]) + 1 if len(p) else 0 for p in self.parts], np.int64)
        self._foreign_signs: dict[str, np.ndarray] = {}

    def _vectors(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), BITS), np.float32)
        known = codes >= 0
        out[known] = self.vectors[codes[known]]
        for k in np.flatnonzero(~known):
            sign = self._foreign_signs.get(words[k])
            if sign is None:
                if len(self._foreign_signs) > 100_000:
                    self._foreign_signs.clear()
                sign = self._foreign_signs[words[k]] = _signs(words[k]) * self.foreign
            out[k] = sign
        return out

    def seeds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document position, item position) of shared triples, by item and position, where enough are close together."""
        none = np.zeros(0, np.int64)
        if len(codes) < SEED or not len(self.keys):
            return none, none, none
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        at = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
        key = (a[at] * self.base + b[at]) * self.base + c[at]
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        if n.sum() < LEAST_SEEDS:
            return none, none, none
        p = np.repeat(at, n)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, q = self.owner[entry], self.place[entry]
        # Changes move a passage off its diagonal by a few places only; of two shifted bucketings
        # of diagonals one holds all three seeds together.
        keep = np.zeros(len(p), bool)
        for shift in (0, DRIFT):
            diagonal = (p - q + shift) // (2 * DRIFT)
            order = np.lexsort((p, diagonal, item))
            i, d, at = item[order], diagonal[order], p[order]
            close = (i[2:] == i[:-2]) & (d[2:] == d[:-2]) & (at[2:] - at[:-2] <= SEED_REACH)
            for k in range(LEAST_SEEDS):
                keep[order[k : len(p) - 2 + k][close]] = True
        kept = np.flatnonzero(keep)
        kept = kept[np.lexsort((p[kept], item[kept]))]
        return item[kept], p[kept], q[kept]

    def near(self, prints: np.ndarray, item: int, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether a pair of windows on the seeds' diagonals is within the radius."""
        own = self.prints[item]
        shift = np.arange(0, max(1, self.widths[item] - SEED + 1), 2)
        x = np.minimum(np.maximum(p[:, None] - shift, 0), len(prints) - 1)
        y = np.minimum(np.maximum(q[:, None] - shift, 0), len(own) - 1)
        return bool(np.bitwise_count(prints[x] ^ own[y]).sum(axis=-1).min() <= self.radius)

    def holds(self, codes: np.ndarray, item: int, p: np.ndarray) -> bool:
        """Exact verification, by runs of seeds that lie close together."""
        own = self.codes[item]
        for low, high in _stretches(p):
            a = codes[low:high]
            matched, first, last = align(a, own)
            if not len(matched):
                continue
            weight = self.weight[own]
            held = float(weight[matched].sum())
            span = float(weight[first:last].sum())
            owner = self.items[item][2]
            in_part, whole = Counter(owner), Counter(owner[k] for k in matched)
            full = sum(whole[o] == in_part[o] for o in whole)
            if full >= min(MATCHED_WORDS, len(in_part)) and held >= SIMILARITY * span:
                return True
        return False

    def holds_run(self, a: np.ndarray, owner: np.ndarray, item: int) -> bool:
        """Whether a run of the item's words stands in ``a`` with few enough changes."""
        own = self.codes[item]
        return run_within(*_units(a, owner, own), *_units(own, self.parts[item], a))

    def words_in_place(self, codes: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The items of the seeds, and for each share whether a run of the item has that share of its words near where the seeds would have them.

        All items at once: a word counts if the text has it within ``PLACE`` of the seeds' diagonal. Runs of ``WINDOW`` up to twice as many words
        are tried, longer ones part into these. An item of fewer words is one run."""
        group = np.unique(np.stack([item, (p - q) // DRIFT], axis=1), axis=0)
        items, centre = group[:, 0], group[:, 1] * DRIFT + DRIFT // 2
        size = self.first[items + 1] - self.first[items]
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        inside = np.arange(int(size.sum())) - np.repeat(start, size)
        at = np.repeat(self.first[items], size) + inside
        # The text's words in order of code and place: one search finds the first of a code from a place on.
        n = len(codes)
        known = np.flatnonzero(codes >= 0)
        there = np.sort(codes[known] * n + known)
        want, expected = self.flat[at] * n, inside + np.repeat(centre, size)
        low = want + np.clip(expected - PLACE - DRIFT // 2, 0, n - 1)
        k = np.searchsorted(there, low)
        hit = (k < len(there)) & (there[np.minimum(k, len(there) - 1)] <= want + np.clip(expected + PLACE + DRIFT // 2, 0, n - 1)) & (expected + PLACE + DRIFT // 2 >= 0) & (expected - PLACE - DRIFT // 2 < n)
        first = np.flatnonzero(self.flat_first[at])
        parts = self.n_parts[items]
        of = np.repeat(np.arange(len(items)), parts)
        held = np.add.reduceat(self.flat_weight[at] * hit, first)
        # A gap that no run can make up for stands after each item; of each start the best end is looked for at once.
        place = np.arange(len(of)) + of
        short = parts < WINDOW
        some, back = np.unique(items, return_inverse=True)
        out = np.zeros((len(some), len(shares)), bool)
        for j, share in enumerate(shares):
            gain = np.full(len(of) + len(items), -1e6)
            gain[place] = held - share
            over = np.concatenate([[0.0], np.cumsum(gain), np.full(2 * WINDOW, -np.inf)])
            best = over[WINDOW : WINDOW + len(gain)].copy()
            for length in range(WINDOW + 1, 2 * WINDOW):
                np.maximum(best, over[length : length + len(gain)], out=best)
            ok = np.bincount(of, best[place] - over[place] >= -1e-3, len(items)) > 0
            if short.any():
                ok[short] = (np.bincount(of, held, len(items)) >= share * parts - 1e-3)[short]
            out[:, j] = np.bincount(back, ok, len(some)) > 0
        return some, out

    def on_diagonal(self, codes: np.ndarray, item: int, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether a run of the item stands in the text with few enough words replaced and none dropped or added: the edit distance can't be more than that."""
        own = self.codes[item]
        shifts, n = np.unique(p - q, return_counts=True)
        for shift in shifts[np.argsort(-n, kind="stable")][:DIAGONALS].tolist():
            low, high = max(0, -shift), min(len(own), len(codes) - shift)
            same = np.zeros(len(own), bool)
            same[low:high] = own[low:high] == codes[low + shift : high + shift]
            if _starts(self.parts[item], self.part_weight[item] * same).any():
                return True
        return False

    def find(self, text: str | None) -> list[int]:
        """Numbers of the items that ``text`` holds."""
        return self.find_plain(_plain(text)) if text else []

    def find_plain(self, plain: str) -> list[int]:
        """The same for a text in normal form."""
        words = _WORD.findall(plain)
        number = self.number
        codes = np.array([number.get(w, -1) for w in words], np.int64)
        item, p, q = self.seeds(codes)
        if not len(item):
            return []
        some, enough = self.words_in_place(codes, item, p, q, (1 - CHANGED, MATCHED_WORDS / WINDOW))
        kept = enough.any(axis=1)[np.searchsorted(some, item)]
        if not kept.any():
            return []
        item, p, q = item[kept], p[kept], q[kept]
        vectors, prints = self._vectors(words, codes), {}
        edges = np.flatnonzero(np.diff(item)) + 1
        owner: np.ndarray | None = None
        found: set[int] = set()
        near: list[tuple[int, np.ndarray]] = []
        for one, ps, qs in zip(np.split(item, edges), np.split(p, edges), np.split(q, edges), strict=True):
            i = int(one[0])
            width = self.widths[i]
            if width not in prints:
                prints[width] = _fingerprints(vectors, width)
            places, close = np.unique(ps), self.near(prints[width], i, ps, qs)
            run = bool(enough[np.searchsorted(some, i), 0])
            # Changes of the heaviest words put a passage beyond the radius; few pairs there have the words for a run in place.
            if run and (close or self.beyond) and self.on_diagonal(codes, i, ps, qs):
                found.add(i)
            elif run and (close or self.beyond):
                owner = np.array(_parted(plain)[1], np.int64) if owner is None else owner
                if any(self.holds_run(codes[low:high], owner[low:high], i) for low, high in _stretches(places)):
                    found.add(i)
            if close and i not in found:
                near.append((i, places))
        good = self._aligned(codes, near) if near else set()
        found |= {i for i, ps in near if i in good and self.holds(codes, i, ps)}
        return sorted(found)

    def _aligned(self, codes: np.ndarray, near: list[tuple[int, np.ndarray]]) -> set[int]:
        """Items whose best local alignment around their seeds scores enough, all items of a stretch at once."""
        places = np.unique(np.concatenate([ps for _, ps in near]))
        out: set[int] = set()
        for low, high in _stretches(places):
            ask = [i for i, ps in near if i not in out and ((ps >= low) & (ps < high)).any()]
            if ask:
                best = best_scores(codes[low:high], [self.codes[i] for i in ask])
                out |= {i for i, b in zip(ask, best, strict=True) if b >= min(LEAST_SCORE, len(self.codes[i]) // 2)}
        return out


def _stretches(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a document around runs of seeds. A long run is cut in overlapping stretches, so that memory stays bounded."""
    for run in np.split(places, np.flatnonzero(np.diff(places) > 2 * SEED_REACH) + 1):
        for start in range(int(run[0]), int(run[-1]) + 1, STRETCH):
            low, high = max(int(run[0]), start - STRETCH // 2), min(int(run[-1]), start + STRETCH + STRETCH // 2)
            yield max(0, low - SEED_REACH), high + SEED_REACH + SEED


def best_scores(a: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Scores of the best local alignments (match 1, change -1) of ``a`` with each item; one row of state per item."""
    width = max(map(len, items))
    b = np.full((len(items), width), -2, np.int64)
    for k, x in enumerate(items):
        b[k, : len(x)] = x
    state = np.zeros((len(items), width + 1), np.int32)
    step = np.arange(width, dtype=np.int32)
    best = np.zeros(len(items), np.int32)
    for word in a:
        row = np.maximum(state[:, :-1] + np.where(b == word, 1, -1), state[:, 1:] - 1)
        np.maximum(row, 0, out=row)
        row += step
        np.maximum.accumulate(row, axis=1, out=row)
        row -= step
        state[:, 1:] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Best local alignment (match 1, change -1): matched positions of ``b``, and the span of ``b`` aligned."""
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), np.int32)
    step = np.arange(m, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1, :-1] + np.where(b == a[i - 1], 1, -1), score[i - 1, 1:] - 1)
        np.maximum(row, 0, out=row)
        score[i, 1:] = np.maximum.accumulate(row + step) - step
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    last, matched = int(j), []
    while i > 0 and j > 0 and score[i, j] > 0:
        same = b[j - 1] == a[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (1 if same else -1):
            if same:
                matched.append(j - 1)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return np.array(matched[::-1], np.int64), int(j), last


def _units(codes: np.ndarray, owner: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, weights and owners: the parts of a blank-separated word weigh one together; a word of which ``other`` has no part is one unit."""
    if not len(codes):
        return codes, np.zeros(0, np.float32), owner
    _, word, n = np.unique(owner, return_inverse=True, return_counts=True)
    first = np.concatenate([[True], word[1:] != word[:-1]])
    some = np.bincount(word, np.isin(codes, other) & (codes >= 0)) > 0
    keep = some[word] | first
    weight = np.where(some, 1 / n, 1).astype(np.float32)
    return np.where(some[word], codes, -1)[keep], weight[word][keep], word[keep]


def _starts(owner: np.ndarray, found: np.ndarray, share: float = 1 - CHANGED) -> np.ndarray:
    """For each word, whether a run from it has enough words by the weights ``found`` of those that occur at all."""
    n_words = int(owner[-1]) + 1
    least = min(WINDOW, n_words)
    length = np.arange(least, min(2 * least - 1, n_words) + 1)
    there = np.concatenate([[0], np.cumsum(np.bincount(owner, found, n_words))])
    end = np.arange(n_words)[:, None] + length
    inside = np.minimum(end, n_words)
    return ((end <= n_words) & (there[inside] - there[:n_words, None] >= share * length - 1e-3)).any(axis=1)


def run_within(a: np.ndarray, a_weight: np.ndarray, a_owner: np.ndarray, b: np.ndarray, b_weight: np.ndarray, b_owner: np.ndarray) -> bool:
    """Whether at least ``WINDOW`` words in sequence of ``b`` (or all) stand in ``a`` with at most ``CHANGED`` of them replaced, dropped or added.

    Edit distance of all runs of ``b`` at once, one state per run. A run of twice the least length parts into two
    of which one has no greater share of changes, so that longer ones need not be tried."""
    if not len(a) or not len(b):
        return False
    n_words = int(b_owner[-1]) + 1
    least = min(WINDOW, n_words)
    most = min(2 * least - 1, n_words)
    words = np.flatnonzero(_starts(b_owner, b_weight * np.isin(b, a[a >= 0])))
    if not len(words):
        return False
    edge = np.searchsorted(b_owner, np.arange(n_words + 1))
    added = np.cumsum(a_weight, dtype=np.float32)
    added = np.concatenate([[np.float32(0)], added])
    state = np.zeros((len(words), len(a) + 1), np.float32)
    for k in range(int((edge[np.minimum(words + most, n_words)] - edge[words]).max())):
        at = edge[words] + k
        inside = at < edge[np.minimum(words + most, n_words)]
        words, state, at = words[inside], state[inside], at[inside]
        # Only words of the other side are -1, and those match nothing.
        cost = np.where((b[at][:, None] == a) & (a >= 0), np.float32(0), b_weight[at][:, None])
        row = state + b_weight[at][:, None]
        np.minimum(row[:, 1:], state[:, :-1] + cost, out=row[:, 1:])
        row -= added
        np.minimum.accumulate(row, axis=1, out=row)
        row += added
        best, whole = row.min(axis=1), edge[b_owner[at] + 1] == at + 1
        done = b_owner[at] + 1 - words
        if (whole & (done >= least) & (best <= CHANGED * done + 1e-3)).any():
            return True
        open_ = best <= CHANGED * most + 1e-3
        if not open_.any():
            return False
        words, state = words[open_], row[open_]
    return False


def _blocks(items: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    block, size = [], 0
    for row in items.select(id_column, text_column).toLocalIterator():
        if row[0] is None or not row[1]:
            continue
        words, owner = item_words(row[1])
        if size and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words, owner))
        size += len(words)
    if block:
        yield block


#: The last block of items that this worker has indexed, the radius and the index; kept from task to task.
_BUILT: list = []


def _index(block: list[tuple[int, list[str], list[int]]], radius: int) -> ItemIndex:
    if not _BUILT or _BUILT[0] is not block or _BUILT[1] != radius:
        _BUILT[:] = [block, radius, ItemIndex(block, radius)]
    return _BUILT[2]


def _normal(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, plain: the texts in normal form, written once for several blocks of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array([_plain(t.as_py()) for t in batch.column(1)], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column(0), plain.cast(batch.schema.field(1).type)], ["doc_id", "plain"])

    return materialize(docs.select(doc_id, text).filter(f"{text} is not null").mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, plain string"))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id: one row per document and item whose passage it holds."""
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    item_type = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    sc = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], schema)
    blocks = _blocks(items, item_id, text, block_words)
    block, following = next(blocks, None), next(blocks, None)
    read = None if following is None else _normal(docs, doc_id, text)
    while block is not None:
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, normal=read is not None) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value, radius)
            for batch in batches:
                at, found = [], []
                for k, t in enumerate(batch.column(1)):
                    hits = index.find_plain(t.as_py()) if normal else index.find(t.as_py())
                    at += [k] * len(hits)
                    found += [index.items[i][0] for i in hits]
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "item_id": found}, schema=pa.schema([("doc_id", ids.type), ("item_id", item_type)]))

        source = docs.select(doc_id, text).filter(f"{text} is not null") if read is None else read
        out = out.unionByName(source.mapInArrow(run, schema))
        block, following = following, next(blocks, None)
    return out.distinct()
