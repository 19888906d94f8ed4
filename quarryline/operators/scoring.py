"""BM25 of one cell: a slice of the documents against all queries.

The pairs of documents and queries grow with the square of the collection, so they are never rows: a cell scores
them query by query in one array over its documents, and hands on the best of each query alone. The arrays are of
single precision and tell only which documents can be among the best; their scores are then added up in full.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are told apart by nine digits; whatever may round to the same stands within this of each other.
DIGITS, NEAR = 9, 2e-9
#: Terms in more than a sixteenth of the documents have a row over all documents, in so many numbers together at most; others have lists.
COMMON, ROWS = 1 / 16, 8_000_000
#: Scores of which only the greatest is looked at to find a bound.
STRIDE = 64


def least_of_best(scores: np.ndarray, k: int) -> float:
    """A number that at least k of the scores reach, or -inf."""
    n = len(scores) // STRIDE
    if n >= 2 * k:
        scores = scores[: n * STRIDE].reshape(n, STRIDE).max(axis=1)
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else -np.inf


class Cell:
    """The postings of the asked terms in the documents of a cell. A query meets the documents of its own key alone."""

    def __init__(self, docs: pa.Table, asked: pa.Table, ways: Sequence[tuple[float, float]]) -> None:
        keys = pc.unique(asked["key"])
        docs = docs.append_column("at", pc.fill_null(pc.index_in(docs["key"], value_set=keys, skip_nulls=True), -1))
        docs = docs.filter(pc.greater_equal(docs["at"], 0))
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("at", "ascending"), ("doc", "ascending")], null_placement="at_start"))
        self.docs, at = docs["doc"], docs["at"].to_numpy()
        self.query_key = pc.index_in(asked["key"], value_set=keys).to_numpy()
        self.begin = np.searchsorted(at, np.arange(len(keys) + 1))
        words = pc.list_flatten(asked["terms"])
        vocabulary = pc.unique(words)
        self.n_terms = max(len(vocabulary), 1)
        self.query_terms = pc.index_in(words, value_set=vocabulary).to_numpy()
        self.query_weights = pc.list_flatten(asked["weights"]).to_numpy()
        self.query_begin = np.concatenate([[0], np.cumsum(pc.list_value_length(asked["terms"]).to_numpy())])
        terms = pc.fill_null(pc.index_in(pc.list_flatten(docs["terms"]), value_set=vocabulary), -1).to_numpy()
        rows = np.repeat(np.arange(len(docs)), pc.list_value_length(docs["terms"]).to_numpy())[terms >= 0]
        # By document.
        codes, tf = np.unique(rows * self.n_terms + terms[terms >= 0], return_counts=True)
        rows, self.terms = codes // self.n_terms, codes % self.n_terms
        self.first = np.searchsorted(rows, np.arange(len(docs) + 1))
        doc_len, mean = docs["doc_len"].to_numpy().astype(float)[rows], asked["mean"][0].as_py()
        self.parts = [tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / mean)) for k1, b in ways]
        self.most = [max(float(np.abs(p).max(initial=0)), 1.0) for p in self.parts]
        self.weights = np.zeros(self.n_terms)  # of one query at a time
        # By key and term: lists of places among the documents of the key.
        order = np.argsort(at[rows].astype(np.int64) * self.n_terms + self.terms, kind="stable")
        self.slots, first = np.unique(at[rows[order]].astype(np.int64) * self.n_terms + self.terms[order], return_index=True)
        self.slot_first = np.append(first, len(order))
        self.places = (rows - self.begin[at[rows]])[order]
        self.listed = [p[order].astype(np.float32) for p in self.parts]
        # By term: rows over all documents.
        held = np.bincount(self.terms, minlength=self.n_terms)
        common = np.argsort(-held, kind="stable")[: max(1, ROWS // max(len(docs), 1))]
        common = common[held[common] > COMMON * len(docs)]
        self.row_of = np.full(self.n_terms, -1)
        self.row_of[common] = np.arange(len(common))
        inside = self.row_of[self.terms] >= 0
        self.rows = []
        for p in self.parts:
            whole = np.zeros((len(common), len(docs)), np.float32)
            whole[self.row_of[self.terms[inside]], rows[inside]] = p[inside]
            self.rows.append(whole)

    def lists(self, key: int, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
        """Begin and end of the places of each term, and its weight."""
        slots = key * self.n_terms + terms
        at = np.searchsorted(self.slots, slots)
        there = at < len(self.slots)
        there[there] = self.slots[at[there]] == slots[there]
        at = at[there]
        return list(zip(self.slot_first[at].tolist(), self.slot_first[at + 1].tolist(), weights[there].tolist(), strict=True))

    def best(self, query: int, ranked: int, k: int, least: int) -> list[tuple[np.ndarray, dict[int, np.ndarray]]]:
        """Of each of the first ``ranked`` ways the positions of the k documents with the greatest rounded scores above zero,
        greatest first and equal ones in order of document, and their scores by this way and by those that rank nothing."""
        key, span = int(self.query_key[query]), slice(self.query_begin[query], self.query_begin[query + 1])
        terms, weights = self.query_terms[span], self.query_weights[span]
        a, b = int(self.begin[key]), int(self.begin[key + 1])
        if a == b or not len(terms):
            return []
        common = self.row_of[terms]
        rare = self.lists(key, terms[common < 0], weights[common < 0])
        common, heavy = common[common >= 0], weights[common >= 0].astype(np.float32)
        few = None
        if least > 1:
            held = self.lists(key, terms, weights)
            few = np.bincount(np.concatenate([self.places[x:y] for x, y, _ in held]), minlength=b - a) < least if held else np.full(b - a, True)
        self.weights[terms] = weights
        slack = NEAR + 2.0**-22 * (len(terms) + 8) * float(np.abs(weights).sum())  # what single precision may miss where no part is above one
        out = []
        for i in range(ranked):
            scores = heavy @ self.rows[i][:, a:b][common]
            for x, y, w in rare:
                scores[self.places[x:y]] += self.listed[i][x:y] * np.float32(w)
            if few is not None:
                scores[few] = -np.inf
            at = np.flatnonzero(scores > max(least_of_best(scores, k), 0.0) - slack * self.most[i])
            if few is None:
                at = at[scores[at] != 0]
            out.append(self._ordered(at + a, i, k, (i, *range(ranked, len(self.parts)))))
        self.weights[terms] = 0
        return out

    def _ordered(self, docs: np.ndarray, way: int, k: int, by: Sequence[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The k best of the documents and their full scores by some ways."""
        n = self.first[docs + 1] - self.first[docs]
        docs, n = docs[n > 0], n[n > 0]
        if not len(docs):
            return docs, {i: np.empty(0) for i in by}
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.first[docs] - begin, n)
        weights = self.weights[self.terms[at]]
        scores = {i: np.round(np.add.reduceat(weights * self.parts[i][at], begin), DIGITS) for i in by}
        order = np.lexsort((docs, -scores[way]))
        order = order[scores[way][order] > 0][:k]
        return docs[order], {i: s[order] for i, s in scores.items()}


def cell_search(ways: Sequence[tuple[float, float]], ranked: int, k: int, least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """way, query, doc and the score of each of ``ways`` (k1, b): the k best of each query by each of the first ``ranked`` ways.
    Scores by another way that ranks are null: only what it finds itself counts there.

    Of documents (doc, doc_len, terms, key) and queries (query, terms, weights, key, mean)."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        way, queries, places, scores = [], [], [], [[] for _ in ways]
        taken = docs["doc"]
        if len(docs) and len(asked):
            cell = Cell(docs, asked, ways)
            taken = cell.docs
            for q in range(len(asked)):
                for i, (at, found) in enumerate(cell.best(q, ranked, k, least)):
                    way.append(np.full(len(at), i, np.int32))
                    queries.append(np.full(len(at), q))
                    places.append(at)
                    for j, all_ in enumerate(scores):
                        all_.append(found[j] if j in found else np.full(len(at), np.nan))
        flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        columns = [pa.array(flat(way, np.int32)), asked["query"].take(pa.array(flat(queries, np.int64))), taken.take(pa.array(flat(places, np.int64))), *[pa.array(flat(s, float), from_pandas=True) for s in scores]]
        return pa.table(columns, ["way", "query", "doc", *[f"score_{i}" for i in range(len(ways))]])

    return run
