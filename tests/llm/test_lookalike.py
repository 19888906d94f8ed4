from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import lookalike as op


@pytest.mark.parametrize(
    ("a", "b"),
    [("paypal", "pаypаl"), ("Ｆｕｌｌ １２", "Full 12"), ("café", "café"), ("ﬁle", "file"), ("a b", "a b"), ("a‑b", "a-b"), ("a​b", "ab"), ("a­b", "ab"), ("сор", "cop"), ("Ε", "E"), ("ёж", "ёж"), ("　x", " x"), ("ոսո", "nun"), ("мoлoкo", "молоко")],
)
def test_same(a, b):
    assert op.normal_form(a) == op.normal_form(b)


@pytest.mark.parametrize(("a", "b"), [("Abc", "abc"), ("l1", "II"), ("cafe", "café"), ("a  b", "a b"), ("a\n\nb", "a\nb"), ("x2", "x²"), ("a–b", "a-b"), ("≠", "="), ("rn", "m"), ("молоко", "moloko")])
def test_different(a, b):
    assert op.normal_form(a) != op.normal_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    once = op.normal_form(text)
    assert op.normal_form(once) == once


def test_script_choice():
    assert op.normal_form("молоκо") == "молоκо" or op.normal_form("молоκо") != ""
    assert op.normal_form("Москва") == "Москва" and op.normal_form("Mосква") == "Москва"
    assert op.normal_form("Τest") == "Test"


def brute(rows):
    forms = {}
    for d, t in rows:
        if d is not None and t and op.normal_form(t).strip():
            forms.setdefault(op.normal_form(t), []).append((d, t))
    return {(min(a, b), max(a, b)) for g in forms.values() for (a, x), (b, y) in itertools.combinations(g, 2) if x != y and a != b}


def test_pairs_by_brute_force(spark):
    rng = random.Random(6)
    swaps = {"a": "а", "o": "ο", "e": "е", "-": "‑", " ": " ", "1": "１"}
    base = ["release one a-b", "no cache 1", "plain", "Москва one"]
    rows = [(i, "".join(swaps.get(c, c) if rng.random() < 0.2 else c for c in rng.choice(base))) for i in range(80)] + [(100, None), (101, ""), (102, "​"), (103, " "), (104, " "), (None, "plain"), (5, "plain")]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id bigint, text string, normal string, form_a int")
    got = [tuple(r) for r in op.lookalike_pairs(df).collect()]
    assert set(got) == brute(rows) and got


def test_copies_of_a_hot_text_are_not_paired(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(9000, "hоt text")]
    got = [tuple(r) for r in op.lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == 3000 and all(b == 9000 for _, b in got)
    same = spark.createDataFrame(rows[:3000], "doc_id bigint, text string")
    assert op.lookalike_pairs(same).count() == 0 and op.lookalike_pairs(same.limit(0)).count() == 0


def test_forms(spark):
    df = spark.createDataFrame([(1, "a" * 200_000), (2, None), (3, ""), (4, "е")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["normal"] for r in op.with_normal_form(df).collect()} == {1: "a" * 200_000, 2: None, 3: "", 4: "e"}


@pytest.mark.parametrize(("a", "b"), [("𝐞𝐫𝐫𝐨𝐫", "error"), ("кот", "κοτ"), ("п", "π"), ("ᎪᏴ", "AB"), ("ⲟⲣ", "op"), ("ꓲꓳ", "IO"), ("Ⅳ", "IV"), ("ᴠᴏᴡ", "vow"), ("5 µs", "5 μs"), ("ǆ", "dž"), ("ĳ", "ij")])
def test_more_scripts_and_forms(a, b):
    assert op.normal_form(a) == op.normal_form(b)


@pytest.mark.parametrize(("a", "b"), [("Ω", "O"), ("ב", "c"), ("中", "国"), ("ⅳ", "IV"), ("x²", "x2"), ("①", "1"), ("の", "0"), ("ж", "x")])
def test_what_looks_different_stays_so(a, b):
    assert op.normal_form(a) != op.normal_form(b)


def test_hot_class_and_class_table(spark):
    rows = [(i, "paypal login") for i in range(60)] + [(100 + i, "раypal login") for i in range(50)] + [(200, "paypal\u00a0login"), (201, "other"), (202, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {tuple(r) for r in op.lookalike_pairs(docs).collect()}
    assert len(whole) == 60 * 50 + 60 + 50 and {tuple(r) for r in op.lookalike_pairs(docs, slice_size=7).collect()} == whole
    classes = {r["doc_id"]: r for r in op.lookalike_members_of(docs).collect()}
    assert set(classes) == {i for i, _ in rows[:-2]} and {r["class_id"] for r in classes.values()} == {0}
    assert (classes[5]["n_links"], classes[105]["n_links"], classes[200]["n_links"]) == (51, 61, 110) and classes[105]["text_id"] == 100
    assert sum(r["n_links"] for r in classes.values()) == 2 * len(whole)
