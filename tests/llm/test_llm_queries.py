from __future__ import annotations

import glob
import os
import pkgutil
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import quarryline
from quarryline.llm import queries

COLUMNS = {"p1_found": ["field_name", "term", "mark"], "p2_found": ["item_table", "item_id", "cut_level"], "p6_found": ["analysis_id", "field_name", "elem_pos"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = Counter(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in queries.SQL:
        duck = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
        cur = duck.execute(queries.SQL[name])
        names = [d[0] for d in cur.description]
        order = [names.index(c) for c in sorted(names)]
        assert rows == Counter(tuple(str(r[i]) for i in order) for r in cur.fetchall())


def test_nothing_else_imports_the_subpackage():
    root = Path(quarryline.__file__).parent
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if re.search(r"quarryline\.llm|from quarryline import llm", p.read_text())]
    assert "llm" in {m.name for m in pkgutil.iter_modules([str(root)])}
