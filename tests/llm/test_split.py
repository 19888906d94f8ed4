from __future__ import annotations

import random

import pytest

from quarryline.llm import split


def level(text, limit):
    def most(starts):
        out, cur = [], []
        for line in text.split("\n"):
            if line.startswith(starts) and cur:
                out.append(len("\n".join(cur)))
                cur = []
            cur.append(line)
        return max([*out, len("\n".join(cur))])

    if most(("diff --git ",)) <= limit:
        return "file"
    if most(("diff --git ", "@@ ")) <= limit:
        return "hunk"
    return "line" if max(map(len, text.split("\n"))) <= limit else "inside_line"


def rebuilt(pieces):
    out = ""
    for p in pieces:
        out += ("\n" if p["cut_before"] not in (None, "inside_line") else "") + p["text"][p["overlap_chars"] :]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_and_levels(seed):
    random.seed(seed)
    parts = ["a", "bb", "\n", "\n", "diff --git x\n", "\n@@ 1\n", "c" * 11, "\r", "é", "🚧"]
    for _ in range(800):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 80)))
        limit, overlap = random.choice([5, 13, 30]), random.choice([0, 3, 6])
        if len(text) <= limit:
            continue
        got, pieces = split.split_diff(text, limit, overlap)
        assert got == level(text, limit) and rebuilt(pieces) == text
        assert all(p["n_chars"] == len(p["text"]) <= limit and p["overlap_chars"] <= overlap for p in pieces)
        for before, p in zip(pieces, pieces[1:], strict=False):
            repeat = p["text"][: p["overlap_chars"]]
            assert not repeat or (repeat.endswith("\n") and before["text"].endswith(repeat[:-1]))


def test_changes_round_trip():
    random.seed(8)
    for _ in range(500):
        changes = [random.choice([None, {"line": i, "before": "x" * random.randint(0, 9), "after": random.choice([None, "", "y" * random.randint(0, 40)]), "change_type": "modified"}]) for i in range(random.randint(1, 12))]
        total = sum(len((c or {}).get(k) or "") for c in changes for k in ("before", "after"))
        if total <= 20:
            continue
        got, pieces = split.split_changes(changes, 20, 6)
        sizes = [len((c or {}).get("before") or "") + len((c or {}).get("after") or "") for c in changes]
        assert got == ("change" if max(sizes) <= 20 else "inside_change")
        assert all(p["n_chars"] <= 20 and p["overlap_chars"] <= 6 for p in pieces)
        own = [c for p in pieces for c in p["changes"] if not c["repeated"]]
        for pos, c in enumerate(changes):
            for k in ("before", "after"):
                assert "".join(x[k] or "" for x in own if x["pos"] == pos) == ((c or {}).get(k) or "")


def test_weak_boundaries_merge_first():
    text = "diff --git a\n" + "x\n" * 8 + "diff --git b\n" + "y\n" * 8
    _, pieces = split.split_diff(text, 30, 0)
    assert [p["cut_before"] for p in pieces] == [None, "file"]


def test_frames(spark):
    big = "\n".join(f"line {i}" for i in range(2000))
    df = spark.createDataFrame([(1, big, "c"), (1, big, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "x" * 6000, "c"), (6, "x" * 6001, "c")], "diff_id int, diff string, item_id string")
    cuts = split.split_oversized(df, "diff_output", "diff_id", "diff")
    assert {(r["item_id"], r["cut_level"]) for r in split.one_per_item(cuts).collect()} == {(1, "line"), (6, "inside_line")}
    pieces = split.pieces_of(cuts).filter("item_id = 1").orderBy("piece_no").collect()
    assert rebuilt([p.asDict() for p in pieces]) == big and [p["piece_no"] for p in pieces] == list(range(len(pieces)))
    assert split.one_per_item(split.split_oversized(df.limit(0), "d", "diff_id", "diff")).count() == 0
    changes = spark.createDataFrame([(1, [(1, "b" * 5000, None, "deleted"), None, (2, None, "a" * 5000, "added")]), (2, None), (3, [])], "parsed_id int, changes array<struct<line:int, before:string, after:string, change_type:string>>")
    assert [(r["item_id"], r["cut_level"]) for r in split.one_per_item(split.split_oversized(changes, "parsed_file", "parsed_id", "changes")).collect()] == [(1, "change")]


def test_very_long_item():
    text = "z" * 1_000_000 + "\n" + "q\n" * 100_000
    _, pieces = split.split_diff(text)
    assert rebuilt(pieces) == text
