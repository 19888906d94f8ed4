from __future__ import annotations

import random

import numpy as np
import pytest

from quarryline.llm import truncation as op

SCHEMA = "analysis_id bigint, analyzer string, error_context array<string>, relevant_files array<struct<file:string, line_number:int, reason:string>>, text string, elem_pos int"
SUBJECTS = ["The linter", "A cached wheel", "The release candidate", "Our nightly job", "This branch", "The docs build"]
VERBS = ["rejects", "reorders", "compares against", "waits for", "duplicates"]
OBJECTS = ["the header row", "a null packet", "three warnings", "the default locale", "its own lock", "an optional dependency"]
ENDS = ["during teardown", "at random", "before any test starts", "under load", "every other day", "since the last bump"]


def sentence(rng, stop="."):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}{stop}"


def corpus(rng, n=1500, limit=150):
    rows, cut = [], set()
    for i in range(n):
        style = rng.choice(["stops", "open"])
        sep = " " if style == "stops" else "; "
        texts = []
        for pos in range(2):
            t = sep.join(sentence(rng, "." if style == "stops" else "") for _ in range(rng.choice([1, 1, 2, 3, 4])))
            if rng.random() < 0.05:
                t = f"Process exited with code {rng.randint(1, 9)}"
            elif len(t) > limit:
                t = t[:limit]
                cut.add((i, "error_context", pos))
            elif rng.random() < 0.04:
                t = t[: rng.randint(5, len(t) - 3)]
                cut.add((i, "error_context", pos))
            texts.append(t)
        file = rng.choice(["src/", "lib/"]) + rng.choice(["walker", "cursor", "beacon"]) + rng.choice(["_load", "_trim", ""]) + rng.choice([".py", ".md"])
        if rng.random() < 0.04:
            file = file[: rng.randint(6, len(file) - 3)]
            cut.add((i, "relevant_files", 0))
        rows.append((i, style, texts, [(file, 1, None)], "clash", 9))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus(random.Random(1))
    df = spark.createDataFrame(rows + rows[:100], SCHEMA)
    found = {tuple(r) for r in op.cut_elements(op.scored(df)).collect()}
    hit = len(found & cut)
    assert hit / len(cut) > 0.85 and hit / len(found) > 0.9


def test_censored_fit_finds_the_limit():
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(5, 0.5, 4000)).astype(int)
    top = int(np.quantile(x, 0.85))
    lengths, counts = np.unique(np.minimum(x, top), return_counts=True)
    mu, sigma, limit, posterior = op.fit_limit(lengths, counts)
    assert limit == top and posterior > 0.95 and mu == pytest.approx(5, abs=0.05) and sigma == pytest.approx(0.5, abs=0.05)
    lengths, counts = np.unique(x, return_counts=True)
    assert op.fit_limit(lengths, counts)[2] is None
    assert op.fit_limit(np.array([5]), np.array([1]))[2] is None


def test_copies_of_a_cut_text_are_cut_and_repeated_notes_are_not(spark):
    rows, cut = corpus(random.Random(5))
    off_limit = " ".join(sentence(random.Random(i)) for i in range(2))[:71]
    at_limit = " ".join(sentence(random.Random(9 + i)) for i in range(4))[:150]
    for i in range(2000, 2700):
        rows.append((i, "stops", [off_limit, at_limit, "No files matched"], [("Dockerfile", 1, None)], "", 0))
        cut |= {(i, "error_context", 0), (i, "error_context", 1)}
    found = {tuple(r) for r in op.cut_elements(op.scored(spark.createDataFrame(rows, SCHEMA))).collect()}
    copies = {c for c in cut if c[0] >= 2000}
    assert len(copies & found) == len(copies) == 1400
    assert not {c for c in found - copies if c[0] >= 2000} and len(found & cut) / len(found) > 0.9


def test_limits_below_the_longest_text_are_found():
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(5, 0.5, 8000)).astype(int)
    low, high = int(np.quantile(x, 0.8)), int(np.quantile(x, 0.95))
    stray = np.append(np.minimum(x[:4000], low), 9000)
    assert [k for k, p in op.lower_limits(*np.unique(stray, return_counts=True)) if p > 0.9] == [low]
    changed = np.concatenate([np.minimum(x[:4000], low), np.minimum(x[4000:], high)])
    assert [k for k, p in op.lower_limits(*np.unique(changed, return_counts=True)) if p > 0.9] == [low]
    assert op.fit_limit(*np.unique(changed, return_counts=True))[2] == high
    # Notes of one length are no limit, and neither is there one in whole texts.
    assert op.lower_limits(*np.unique(np.append(x, [int(np.exp(5))] * 400), return_counts=True)) == []
    assert op.lower_limits(*np.unique(x, return_counts=True)) == [] == op.lower_limits(np.array([5]), np.array([1]))


def test_signs_nulls_and_empty(spark):
    rows = [(1, None, ["cut here...", None, "", "x [truncated]", "bad �", "so (+531 chars)"], [None, ("", 1, None)], "", 0), (1, None, ["cut here...", None, "", "x [truncated]", "bad �", "so (+531 chars)"], [None, ("", 1, None)], "", 0), (2, "a", None, None, "", 0), (3, "a", [], [], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in op.cut_elements(op.scored(df)).collect()} == {(1, "error_context", p) for p in (0, 3, 4, 5)}
    share = op.cut_share(op.scored(df)).collect()
    assert [(r["analyzer"], r["n_elements"], r["n_cut"]) for r in share] == [(None, 4, 4)]
    assert op.cut_elements(op.scored(df.limit(0))).count() == 0


def test_very_long_text(spark):
    rows, _ = corpus(random.Random(2), 60)
    rows.append((999, "stops", [" ".join(sentence(random.Random(i)) for i in range(3000))], None, "", 0))
    assert (999, "error_context", 0) not in {tuple(r) for r in op.cut_elements(op.scored(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_at_one_ending_the_length_decides(spark):
    """Some cuts at the limit fall where a sentence may end: only the censored fit tells them from whole texts."""
    rows, _ = corpus(random.Random(11), 4000)
    df = spark.createDataFrame([(*r[:2], [t for t in r[2] if len(t) > 150 or not t.startswith("Process")], *r[3:]) for r in rows], SCHEMA)
    scores = op.scored(df).filter("part = 'error_context' and not signed").select("analyzer", "limit", "category", "score").distinct().collect()
    at = {(r["analyzer"], r["category"]): r["score"] for r in scores if r["limit"]}
    off = {(r["analyzer"], r["category"]): r["score"] for r in scores if not r["limit"]}
    assert {r["limit"] for r in scores} == {0, 150}
    for style in ("open", "stops"):
        gaps = {round(at[k] - off[k], 6) for k in set(at) & set(off) if k[0] == style}
        assert len(gaps) == 1 and gaps.pop() > 3
    assert any(at[k] > 0 > off[k] for k in set(at) & set(off)), sorted((k, at[k], off[k]) for k in set(at) & set(off))


def test_shares_and_endings_of_a_known_mixture():
    rng = np.random.default_rng(5)
    q, p = np.array([0.6, 0.25, 0.1, 0.05]), np.array([0.0, 0.0, 0.3, 0.7])
    found = rng.multinomial(20000, 0.04 * q + 0.96 * p)
    share, q_fit, whole = op.fit_endings(found, rng.multinomial(3000, q))
    assert share == pytest.approx(0.04, abs=0.005) and q_fit == pytest.approx(q, abs=0.05) and whole == pytest.approx(p, abs=0.02)
    assert op.group_share(rng.multinomial(4000, 0.5 * q + 0.5 * p), q_fit, whole, share) == pytest.approx(0.5, abs=0.05)
    assert op.fit_endings(np.array([3]), np.array([0]))[0] == 0.01
