"""Entries of JSON objects too large for one value, and an index of where they lie.

A file is read in blocks by one task, whose memory holds one block and one entry; many files are read side by side. (An
object with one entry per line needs none of this: ``readers.top_level_entries`` splits it.) The index keeps the position of every
entry with the size and time of its file, so that one entry is read without the rest, and a file that has changed is indexed anew.

Defined cases: text that is no JSON object has no entries; what is cut off ends with its last whole entry; a repeated key
has one entry each time; an empty object has none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
_MARK = re.compile(rb'["{}\[\],:]')
_TEXT_END = re.compile(rb'["\\]')


def open_file(path: str):  # noqa: ANN201
    """A file of any file system that pyarrow knows, opened for reading at any place."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inside)


def scan_entries(blocks: Iterator[bytes]) -> Iterator[tuple[str, int, int, bytes]]:
    """(key, start, length, value) of the members of the outermost object, as the bytes come."""
    buffer, base, at = b"", 0, 0
    depth, in_text, key, key_start, value_start = 0, False, None, -1, -1
    for block in blocks:
        buffer += block
        while True:
            m = (_TEXT_END if in_text else _MARK).search(buffer, at)
            if m is None:
                at = len(buffer)
                break
            ch = m[0]
            if in_text and ch == b"\\":
                if m.end() >= len(buffer):
                    at = m.start()
                    break
                at = m.end() + 1
                continue
            at = m.end()
            if in_text:
                in_text = False
                if depth == 1 and key is None:
                    key = json.loads(buffer[key_start - base : at])
            elif ch == b'"':
                in_text = True
                if depth == 1 and key is None:
                    key_start = base + m.start()
            elif ch in b"{[":
                depth += 1
                if depth == 1 and ch == b"[":
                    return
            elif ch == b":" and depth == 1 and value_start < 0:
                value_start = base + at
            elif ch in b"}]," and (depth == 1 or ch != b","):
                if depth == 1 and key is not None and value_start >= 0:
                    raw = buffer[value_start - base : m.start()]
                    value = raw.strip()
                    yield key, value_start + len(raw) - len(raw.lstrip()), len(value), value
                    key, value_start = None, -1
                if ch != b",":
                    depth -= 1
                    if depth == 0:
                        return
        # Only an entry that is not whole yet is kept.
        first = min(x for x in (key_start if key is None and in_text and depth == 1 else None, value_start if value_start >= 0 else None, base + at) if x is not None)
        buffer, at, base = buffer[first - base :], at - (first - base), first


def _blocks(path: str) -> Iterator[bytes]:
    with open_file(path) as f:
        while block := f.read(BLOCK):
            yield block


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime; the content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def large_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value (text) of every entry of the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                for key, _, _, value in scan_entries(_blocks(p)):
                    yield pd.DataFrame({"path": [p], "key": [key], "value": [value.decode("utf-8", "replace")]})

    files = _files(spark, path).select("path")
    return files.repartition("path").mapInPandas(run, "path string, key string, value string")


def _indexed(files: DataFrame) -> DataFrame:
    schema = "path string, length bigint, modificationTime timestamp, key string, start bigint, size bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                part = []
                for key, start, size, _ in scan_entries(_blocks(row.path)):
                    part.append((row.path, row.length, row.modificationTime, key, start, size))
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=["path", "length", "modificationTime", "key", "start", "size"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["path", "length", "modificationTime", "key", "start", "size"])

    return files.repartition("path").mapInPandas(run, schema)


def refresh_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The index of the files: entries of files with another size or time, and of new ones, are read anew; those of vanished files go."""
    from quarryline.sources.readers import path_exists
    from quarryline.sources.sinks import finish_swap, replace_parquet

    files = _files(spark, path)
    finish_swap(spark, index_path)
    if not path_exists(spark, index_path):
        replace_parquet(_indexed(files), index_path, backup=False)
        return spark.read.parquet(index_path)
    same = ["path", "length", "modificationTime"]
    old = spark.read.parquet(index_path)
    stale = files.join(old.select(*same).distinct(), same, "left_anti")
    gone = old.select(*same).distinct().join(files, same, "left_anti")
    if not stale.isEmpty() or not gone.isEmpty():
        replace_parquet(old.join(files, same, "left_semi").unionByName(_indexed(stale)), index_path, backup=False)
    return spark.read.parquet(index_path)


def lookup_entries(index: DataFrame, keys: DataFrame) -> DataFrame:
    """path, key, value of the asked keys (column key): only their bytes are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rows in frame.groupby("path"):
                with open_file(path) as f:
                    values = []
                    for start, size in zip(rows["start"], rows["size"], strict=True):
                        f.seek(int(start))
                        values.append(f.read(int(size)).decode("utf-8", "replace"))
                yield pd.DataFrame({"path": path, "key": rows["key"], "value": values})

    hits = index.join(keys.select("key").distinct(), "key", "left_semi").select("path", "key", "start", "size")
    return hits.mapInPandas(run, "path string, key string, value string")


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, n_bytes, modified, fingerprint (SHA-256) of files found recursively, read in blocks whatever their size."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for p in frame["path"]:
                digest = hashlib.sha256()
                for block in _blocks(p):
                    digest.update(block)
                digests.append(digest.hexdigest())
            yield frame.assign(fingerprint=digests)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    listed = files.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    return listed.repartition("path").mapInPandas(run, "path string, n_bytes bigint, modified timestamp, fingerprint string")
