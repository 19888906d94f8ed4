"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are compatible,
that is if the merges leave them apart when applied to the two alone; and every prefix of a word
has one such sequence. So the merges are compiled to a nondeterministic transducer: a path keeps
the last token, the place in the vocabulary's trie that the bytes since have reached, and the
tokens not written yet. A state of the deterministic transducer is the set of live paths; it is
made when the input first reaches it and kept in a table of (state, byte). What all live paths
agree on is written at once, so the lookahead is bounded by the longest token and a text of any
length is read once, in linear time, without a queue of merges.

Decoding streams ids through an incremental UTF-8 state machine that keeps an unfinished character
between tokens.

Tables of words and states are bounded by parameters; when full they are emptied and built again,
which changes no result.

Defined cases: an empty and a null text have an empty list; strings of special tokens are ordinary
text; invalid surrogates become U+FFFD; null ids are skipped in decoding.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that parts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_WORDS = 300_000
MOST_STATES = 200_000
#: Longer words skip the table of words and stream through the transducer.
WORD_CHARS = 64
#: The words of longer texts are not listed before they are encoded.
LONG_TEXT = 1_000_000


def read_ranks(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges applied one by one, lowest rank first. Used to compile the transducer, on two tokens at a time."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of a word in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._child: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._inner: list[bool] = [False]
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self._child:
                    self._child[key] = len(self._token)
                    self._inner[node] = True
                    self._token.append(-1)
                    self._inner.append(False)
                node = self._child[key]
            self._token[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._paths: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._next: dict[int, int] = {}
        self._write: dict[int, tuple[int, ...]] = {}
        self._last: list[tuple[int, ...]] = []
        self.start = self._state(((-1, 0, ()),))

    def _state(self, paths: tuple) -> int:
        n = self._number.get(paths)
        if n is None:
            n = self._number[paths] = len(self._paths)
            self._paths.append(paths)
            # The path that ends a token here holds the encoding of all bytes so far.
            self._last.append(next((out for _, node, out in paths if node == 0), ()))
        return n

    def _compatible(self, a: int, b: int) -> bool:
        pair = (a, b)
        known = self._fits.get(pair)
        if known is None:
            left = self.bytes_of[a] if a >= 0 else b""
            known = self._fits[pair] = merge_bytes(left + self.bytes_of[b], self.ranks) == ([a, b] if a >= 0 else [b])
        return known

    def _step(self, state: int, byte: int) -> int:
        """Makes the transition of ``state`` on ``byte``."""
        live: list[tuple] = []
        ended = None
        for last, node, out in self._paths[state]:
            child = self._child.get(node << 8 | byte)
            if child is None:
                continue
            token = self._token[child]
            if token >= 0 and ended is None and self._compatible(last, token):
                ended = (token, 0, (*out, token))
            if self._inner[child]:
                live.append((last, child, out))
        if ended is None:
            raise ValueError("a byte without a token: the vocabulary is not byte-complete")
        live.append(ended)
        shared = min(len(out) for *_, out in live)
        first = live[0][2]
        same = 0
        while same < shared and all(out[same] == first[same] for *_, out in live):
            same += 1
        target = self._state(tuple((last, node, out[same:]) for last, node, out in live))
        key = state << 8 | byte
        self._next[key] = target
        if same:
            self._write[key] = first[:same]
        return target

    def encode(self, data: bytes) -> list[int]:
        """The ids of one word."""
        if len(self._paths) > MOST_STATES:
            self._reset()
        if len(self._fits) > 4 * MOST_STATES:
            self._fits.clear()
        state, out = self.start, []
        step, write = self._next, self._write
        for b in data:
            key = state << 8 | b
            target = step.get(key)
            if target is None:
                target = self._step(state, b)
            written = write.get(key)
            if written is not None:
                out.extend(written)
            state = target
        out.extend(self._last[state])
        return out


class _Words(dict):
    """Ids of words seen before; a word not there goes through the transducer."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.transducer = Transducer(ranks)

    def __missing__(self, word: str) -> list[int]:
        ids = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= WORD_CHARS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids: words by the public pattern, each from the table of words or through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self._pattern = regex.compile(pattern)
        self._words = _Words(ranks)
        self._transducer = self._words.transducer

    def _parts(self, text: str) -> Iterable[str]:
        if len(text) <= LONG_TEXT:
            return self._pattern.findall(text)
        return (m[0] for m in self._pattern.finditer(text))

    def encode(self, text: str | None, into: array | None = None) -> array:
        out = array("i") if into is None else into
        if text:
            out.extend(chain.from_iterable(map(self._words.__getitem__, self._parts(text))))
        return out


class Decoder:
    """Ids to text, a token at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._bytes_of = {i: t for t, i in ranks.items()}

    def stream(self, ids: Iterable[int | None]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if i is not None:
                yield machine.decode(self._bytes_of[i])
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int | None]) -> str:
        return "".join(self.stream(ids))


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids for every row. One scan, no shuffle; the vocabulary (fixed, under 1 MB) goes out as a broadcast variable."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            values, offsets = array("i"), array("i", [0])
            for text in batch.column(1):
                encoder.encode(text.as_py(), values)
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text of the ids of ``encoded`` (doc_id, ids); a null list has a null text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
