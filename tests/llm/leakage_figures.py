"""Figures of problem 8 for the README: python tests/llm/leakage_figures.py [sf_dir].

Passages of the evaluation items with exactly a quarter of the words replaced by foreign ones (half of them in one run, half
scattered) are set among words of other documents. Printed: how many have a pair of windows within each radius, how many the operator finds with
and without the pairs beyond the radius, and how many each verification keeps, beside the pairs that it keeps of documents without the passage.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quarryline.llm import leakage as op


def shingle_similarity(index: op.ItemIndex, codes: np.ndarray, item: int, size: int) -> float:
    """Best weighted containment over item windows: the weight of the window's shingles that stand in the text."""
    own, weight = index.codes[item], index.weight
    there = {tuple(codes[k : k + size]) for k in range(len(codes) - size + 1)}
    width = min(op.WINDOW, len(own))
    if len(own) < size:
        return 0.0
    w = np.array([weight[own[k : k + size]].sum() for k in range(len(own) - size + 1)])
    hit = w * np.array([tuple(own[k : k + size]) in there for k in range(len(w))])
    n = width - size + 1
    total, held = (np.convolve(x, np.ones(n), "valid") for x in (w, hit))
    return float((held / total).max())


def main(sf_dir: str) -> None:
    rng = random.Random(1)
    items = [(r["item_id"], *op.item_words(r["text"])) for r in pq.read_table(f"{sf_dir}/eval_items.parquet").to_pylist() if r["text"]]
    index, only_near = op.ItemIndex(items), op.ItemIndex(items, beyond=False)
    docs = [t for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist() if t][:4000]
    other = [w for t in docs[:300] for w in op.words_of(t)]
    radii, passages = (16, 20, 24, 28, 32, 36), 0
    within, found, found_near, kept = dict.fromkeys(radii, 0), 0, 0, {}
    limits = [(1, 0.6), (1, 0.7), (1, 0.75), (2, 0.5), (5, 0.2), (5, 0.8)]
    for k in range(400):
        n = rng.choice((20, 22, 25, 30, 40))
        i = rng.randrange(len(items))
        parts = dict.fromkeys(items[i][2])
        if len(parts) < n:
            continue
        passages += 1
        start = rng.randrange(len(parts) - n + 1)
        text = [" ".join(w for w, o in zip(items[i][1], items[i][2], strict=True) if o == x) for x in list(parts)[start : start + n]]
        first = rng.randrange(n - n // 4 + 1)
        for x in range(first, first + n // 4) if k % 2 else rng.sample(range(n), n // 4):
            text[x] = f"zz{rng.randrange(10**6)}"
        at = rng.randrange(len(other) - 80)
        words = [*other[at : at + 40], *" ".join(text).split(), *other[at + 40 : at + 80]]
        codes = np.array([index.number.get(w, -1) for w in words], np.int64)
        width = index.widths[i]
        prints = op._fingerprints(index._vectors(words, codes), width)
        least = int(np.bitwise_count(prints[:, None, :] ^ index.prints[i][None]).sum(axis=-1).min())
        for r in radii:
            within[r] += least <= r
        plain = " ".join([*other[at : at + 40], *text, *other[at + 40 : at + 80]])
        found += i in index.find_plain(plain)
        found_near += i in only_near.find_plain(plain)
        for size, limit in limits:
            kept[size, limit] = kept.get((size, limit), 0) + (shingle_similarity(index, codes, i, size) >= limit)
    print(f"{passages} passages; within the radius: {within}; found {found}, without the pairs beyond the radius {found_near}")
    wrong, asked = dict.fromkeys(limits, 0), 0
    for t in docs:
        hits = set(index.find(t))
        codes = np.array([index.number.get(w, -1) for w in op.words_of(t)], np.int64)
        seeded = set(index.seeds(codes)[0].tolist()) - hits
        for i in seeded:
            asked += 1
            for size, limit in limits:
                wrong[size, limit] += shingle_similarity(index, codes, i, size) >= limit
    print(f"{len(docs)} documents have {asked} seeded pairs that are no finds")
    for size, limit in limits:
        print(f"shingles of {size} words, weighted similarity {limit}: keeps {kept[size, limit]} of {passages} passages and {wrong[size, limit]} of {asked} other pairs")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
