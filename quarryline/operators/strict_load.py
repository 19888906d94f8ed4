"""Strict load of raw lines; what does not load is found by anti-join and diagnosed.

1. The strict loader is JVM-only: one anchored pattern per file kind (RFC 8259 objects of scalar
   members, RFC 4180 records). It loads conforming rows with their values typed.
2. The offsets of the loaded rows are subtracted from the raw offsets by a left anti join.
3. Only the remainder goes to Python (Arrow batches), where an exact reader names the first reason.
   A valid line that the pattern leaves out (nested values, numbers that are no plain integers, line
   breaks inside a line, lines of more than ``PATTERN_CHARS`` characters, which would recurse too deep
   in the JVM's matcher) comes back from there as a row, so the two loaders together are exact.

Both loaders give the same values. A JSON string is its decoded text, in which half of a surrogate pair
is "?"; any other JSON value is its source text, so no digit and no inner object changes; null and an
empty CSV field are null.

Defined cases: lines of nothing but spaces and tabs are neither rows nor rejects; a null line is
such a line; repeated lines are rows of their own; a file that is neither ``*.jsonl`` nor ``*.csv``
has only broken records; a repeated key in an object is a field_count; a trailing carriage return
counts as part of the line end; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields in the order of the CSV files, and what status and conclusion may be.
FIELDS = ("id", "repo_name", "url", "workflow", "status", "conclusion", "patch_applied", "sha_original", "commit")
STATUSES = ("queued", "in_progress", "completed", "waiting")
CONCLUSIONS = ("success", "failure", "cancelled", "timed_out", "waiting", "error")
PATTERN_CHARS = 4000

_WS = r"[ \t\n\r]*+"
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
#: Integers that a JSON reader gives back as they were written; other numbers are for the exact reader.
_NUMBER = r"(?:0|-?[1-9][0-9]{0,17})"
_MEMBER = rf'(?:"(?:status|conclusion)"{_WS}:{_WS}(?:{_STRING}|null)|"(?:id|repo_name|url|workflow|patch_applied|sha_original|commit)"{_WS}:{_WS}(?:{_STRING}|{_NUMBER}|true|false|null))'
JSON_LINE = rf"\A{_WS}\{{{_WS}{_MEMBER}(?:{_WS},{_WS}{_MEMBER}){{{len(FIELDS) - 1}}}{_WS}\}}{_WS}\z"
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
CSV_LINE = rf"\A(?![^\r\n\x00]*+(?:\n|\r(?!\z)|\x00)){_FIELD}(?:,{_FIELD}){{{len(FIELDS) - 1}}}\r?\z"

ROW_TYPE = "struct<" + ", ".join(f"{f}:string" for f in FIELDS) + ">"
DIAGNOSIS = f"struct<reason:string, row:{ROW_TYPE}>"


def _kind(file_name: Column) -> Column:
    return F.when(F.lower(file_name).endswith(".jsonl"), "jsonl").when(F.lower(file_name).endswith(".csv"), "csv")


def _clean(x: Column) -> Column:
    return F.lower(F.trim(x))


def _allowed(x: Column, values: tuple[str, ...]) -> Column:
    blank = F.regexp_replace(x, r"\s+", "") == ""
    return x.isNull() | blank | _clean(x).isin(*values)


def split_csv(line: str) -> list[str] | None:
    """The fields of an RFC 4180 record, or None where its quoting is broken."""
    line = line[:-1] if line.endswith("\r") else line
    out, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            parts, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                parts.append(line[at:close])
                if line[close + 1 : close + 2] != '"':
                    at = close + 1
                    break
                parts.append('"')
                at = close + 2
            if at < end and line[at] != ",":
                return None
            out.append("".join(parts))
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            if line.find('"', at, stop) >= 0:
                return None
            out.append(line[at:stop])
            at = stop
        if at >= end:
            return out
        at += 1


def _reject_constant(_: str) -> None:
    raise ValueError("not JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=list, parse_constant=_reject_constant, parse_int=str, parse_float=str)
_BLANKS = re.compile(r"[ \t\n\r]*")


def split_object(line: str) -> list[tuple[str, bool, str | None]] | None:
    """(key, whether the value is a string or null, value) of the members of one JSON object, or None where the line is none.

    The value of a string is its text, of anything else its source, so that nothing is read and written again."""
    at = _BLANKS.match(line).end()
    if not line.startswith("{", at):
        return None
    out, at = [], _BLANKS.match(line, at + 1).end()
    done = line.startswith("}", at)
    while not done:
        if not line.startswith('"', at):
            return None
        key, at = _DECODER.raw_decode(line, at)
        at = _BLANKS.match(line, at).end()
        if not line.startswith(":", at):
            return None
        start = _BLANKS.match(line, at + 1).end()
        value, at = _DECODER.raw_decode(line, start)
        is_text = value is None or line.startswith('"', start)
        out.append((key, is_text, _valid_text(value) if is_text else line[start:at]))
        at = _BLANKS.match(line, at).end()
        done = line.startswith("}", at)
        if not done:
            if not line.startswith(",", at):
                return None
            at = _BLANKS.match(line, at + 1).end()
    return out if _BLANKS.match(line, at + 1).end() == len(line) else None


def _valid_text(value: str | None) -> str | None:
    return None if value is None else value.encode("utf-8", "replace").decode("utf-8")


def _bad(value: str | None, is_text: bool, allowed: tuple[str, ...]) -> bool:
    if value is None:
        return False
    return not is_text or bool(value.strip()) and value.strip(" ").lower() not in allowed


def diagnose(kind: str | None, line: str) -> tuple[str | None, dict[str, str | None] | None]:
    """(first reason that holds, None), or (None, the row) for a valid line."""
    if kind == "jsonl":
        try:
            members = split_object(line)
        except (ValueError, RecursionError):
            members = None
        if members is None:
            return "broken_record", None
        if sorted(k for k, *_ in members) != sorted(FIELDS):
            return "field_count", None
        row = {k: v for k, _, v in members}
        texts = {k for k, is_text, _ in members if is_text}
    elif kind == "csv":
        values = split_csv(line)
        if values is None:
            return "broken_record", None
        if len(values) != len(FIELDS):
            return "field_count", None
        row = {f: v or None for f, v in zip(FIELDS, values, strict=True)}
        texts = set(FIELDS)
    else:
        return "broken_record", None
    if _bad(row["status"], "status" in texts, STATUSES):
        return "bad_status", None
    if _bad(row["conclusion"], "conclusion" in texts, CONCLUSIONS):
        return "bad_conclusion", None
    return None, row


@dataclass(frozen=True)
class Loaded:
    """``rows``: typed rows; ``rejects``: line_id, file_name, line_no, raw_line, reason."""

    rows: DataFrame
    rejects: DataFrame


def _typed(rows: DataFrame) -> DataFrame:
    none = lambda x: F.when(_clean(x) != "", _clean(x))
    r = lambda n: F.col(f"row.{n}")
    flag = _clean(r("patch_applied"))
    return rows.select(
        "line_id", "file_name", "line_no", F.trim(r("id")).alias("id"), *[F.trim(r(n)).alias(n) for n in ("repo_name", "url", "workflow")],
        none(r("status")).alias("status"), none(r("conclusion")).alias("conclusion"),
        F.when(flag.isin("true", "false"), flag == "true").alias("patch_applied"), *[F.trim(r(n)).alias(n) for n in ("sha_original", "commit")],
    )


def strict_load(lines: DataFrame) -> Loaded:
    """Typed rows and rejects of ``lines`` (line_id, file_name, line_no, raw_line)."""
    raw = (
        lines.select("line_id", "file_name", "line_no", "raw_line", _kind(F.col("file_name")).alias("kind"))
        .filter(F.col("raw_line").rlike(r"[^ \t]"))
        .withColumn("line_key", F.xxhash64("file_name", "raw_line"))
    )
    line, kind = F.col("raw_line"), F.col("kind")
    small = (F.length(line) <= PATTERN_CHARS) & F.col("line_id").isNotNull()
    is_json, is_csv = small & (kind == "jsonl") & line.rlike(JSON_LINE), small & (kind == "csv") & line.rlike(CSV_LINE)
    csv_row = F.from_csv(F.regexp_replace(line, r"\r\z", ""), F.lit(ROW_TYPE[7:-1].replace(":", " ")), {"escape": '"', "emptyValue": "", "nullValue": "", "maxCharsPerColumn": "-1"})
    is_csv_row = kind == "csv"
    row = F.when(is_csv_row, csv_row).otherwise(F.from_json(line, ROW_TYPE))
    names = F.map_keys(F.from_json(F.when(~is_csv_row, line), "map<string,string>"))
    # One-element arrays, so that a line is parsed once and not once for each use of a field.
    parsed = F.filter(F.array(row), lambda r: _allowed(r["status"], STATUSES) & _allowed(r["conclusion"], CONCLUSIONS))
    whole = is_csv_row | F.exists(F.array(names), lambda k: F.size(F.array_distinct(k)) == len(FIELDS))
    strict = raw.filter(is_json | is_csv).filter(whole).select("line_id", "line_key", "file_name", "line_no", F.explode(parsed).alias("row"))
    remainder = raw.join(strict.select("line_id", "line_key"), ["line_id", "line_key"], "left_anti")

    @F.pandas_udf(DIAGNOSIS)
    def why(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [diagnose(k, t) for k, t in zip(kinds, texts, strict=True)]
        return pd.DataFrame({"reason": [r for r, _ in found], "row": [v or dict.fromkeys(FIELDS) for _, v in found]})

    why = why.asNondeterministic()  # else its filter moves below the anti join and every line goes to Python

    diagnosed = remainder.withColumn("found", why("kind", "raw_line"))
    rescued = diagnosed.filter(F.col("found.reason").isNull()).withColumn("row", F.col("found.row"))
    columns = ["line_id", "file_name", "line_no", "row"]
    rows = _typed(strict.select(*columns).unionByName(rescued.select(*columns)))
    rejects = diagnosed.filter(F.col("found.reason").isNotNull()).select("line_id", "file_name", "line_no", "raw_line", F.col("found.reason").alias("reason"))
    return Loaded(rows, rejects)
