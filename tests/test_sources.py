from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarryline.sources import large_json, readers, sinks


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1"}\n\nbroken\n{"id": "2"}\n')
    assert [r["id"] for r in readers.read_jsonl(spark, str(p), "id string").collect()] == ["1", "2"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        readers.read_jsonl(spark, str(p), "id string", strict=True).collect()
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0


def test_keyed_and_enveloped(spark, tmp_path):
    for name, doc in (("m.json", {"1": {"x": 1}, "2": "diff"}), ("l.json", [{"issue_id": 3, "x": 2}, {"x": 9}])):
        (tmp_path / name).write_text(json.dumps(doc))
    assert sorted(r["key"] for r in readers.read_keyed_json(spark, str(tmp_path / "m.json")).collect()) == ["1", "2"]
    assert [r["key"] for r in readers.read_keyed_json(spark, str(tmp_path / "l.json")).collect()] == ["3"]
    (tmp_path / "e.json").write_text(json.dumps({"provenance": 1, "instances": [{"id": 1}, {"id": 2}]}))
    assert readers.read_enveloped(spark, str(tmp_path / "e.json")).count() == 2


def test_instances_and_entries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('[{"id": "1"}, {"id": "2"}]\n{"id": "3"}\nbad\n')
    assert sorted(r["id"] for r in readers.read_instances(spark, str(tmp_path / "a.jsonl"), "id string").collect()) == ["1", "2", "3"]
    (tmp_path / "a.json").write_text('[{"id": "1"}]')
    assert readers.read_instances(spark, str(tmp_path / "a.json"), "id string").count() == 1
    (tmp_path / "big.json").write_text('{\n"k1": {"a": 1},\n"k2": "x"\n}\n')
    assert {r["key"]: r["line"] for r in readers.top_level_entries(spark, str(tmp_path / "big.json")).collect()} == {"k1": '{"a": 1}', "k2": '"x"'}


def test_replace_with_backup(spark, tmp_path):
    p = str(tmp_path / "t")
    assert sinks.replace_parquet(spark.range(3), p) == 3
    assert sinks.replace_parquet(spark.range(5), p) == 5
    assert spark.read.parquet(p).count() == 5 and len([x for x in tmp_path.iterdir() if x.name.startswith("t.2")]) == 1


def test_a_swap_cut_short_is_finished(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "t")
    sinks.replace_parquet(spark.range(3), p)
    real = sinks._swap

    def half(spark, path, backup):
        (tmp_path / "t").rename(tmp_path / "t.old")
        raise OSError("killed")

    monkeypatch.setattr(sinks, "_swap", half)
    with pytest.raises(OSError, match="killed"):
        sinks.replace_parquet(spark.range(5), p)
    monkeypatch.setattr(sinks, "_swap", real)
    assert sinks.finish_swap(spark, p) and spark.read.parquet(p).count() == 5 and not sinks.finish_swap(spark, p)


def test_one_json_file_replaces_another(spark, tmp_path):
    for n in (3, 5):
        sinks.write_json_file(spark.range(n), str(tmp_path / "one.json"))
        assert len((tmp_path / "one.json").read_text().splitlines()) == n


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from quarryline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x,"y"', None), ("b", "z", 1)], "k string, v string, n int")
    sinks.write_csv(df, str(tmp_path / "c"), ["k", "v", "n", "missing"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("k").collect()
    assert back[0]["v"] == 'x,"y"' and back[0]["n"] is None
    sinks.write_by_key(df, str(tmp_path / "p"), "k")
    sinks.write_by_key(df.filter("k = 'a'").withColumn("v", F.lit("new")), str(tmp_path / "p"), "k")
    assert {r["k"]: r["v"] for r in spark.read.json(str(tmp_path / "p")).collect()} == {"a": "new", "b": "z"}
    sinks.write_json_file(df, str(tmp_path / "one.json"))
    assert len((tmp_path / "one.json").read_text().splitlines()) == 2
    assert df.select(sinks.latex_text(F.lit("a_b & 5%"))).first()[0] == "a\\_b \\& 5\\%"
    assert sinks.markdown_lines(df).first()["line"].startswith("| a | x,")


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    assert [r["content"] for r in readers.source_files(spark, str(tmp_path)).collect()] == ["x = 1\n"]
    assert large_json.fingerprints(spark, str(tmp_path)).count() == 2


def test_large_objects_in_blocks(spark, tmp_path, monkeypatch):
    doc = {f"k{i} \\ \"é": {"patch": 'a "quoted" {brace] \\', "n": [i, {"deep": [None, True]}]} for i in range(50)} | {"text": "x,y: {", "num": -1.5e3, "null": None, "empty": {}, "list": [1, [2]]}
    for name, text in (("one.json", json.dumps(doc)), ("wide.json", json.dumps(doc, indent=3, ensure_ascii=False)), ("list.json", "[1, 2]"), ("none.json", ""), ("cut.json", '{"a": 1, "b": [1, 2'), ("no.json", "{}")):
        (tmp_path / name).write_text(text)
        for block in (1, 2, 7, 1 << 20):
            raw = text.encode()
            got = list(large_json.scan_entries(raw[i : i + block] for i in range(0, len(raw), block)))
            if name in ("one.json", "wide.json"):
                assert {k: json.loads(v) for k, _, _, v in got} == doc and all(raw[s : s + n] == v for _, s, n, v in got)
            else:
                assert [k for k, *_ in got] == (["a"] if name == "cut.json" else [])
    rows = large_json.large_entries(spark, str(tmp_path / "*.json")).collect()
    assert len(rows) == 2 * len(doc) + 1


def test_index_is_renewed_where_files_change(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, doc in (("a.json", {"x": 1, "y": [2]}), ("b.json", {"x": {"z": 3}})):
        (tmp_path / "in" / name).write_text(json.dumps(doc))
    src, at = str(tmp_path / "in"), str(tmp_path / "index")
    keys = spark.createDataFrame([("x",), ("w",), (None,)], "key string")
    ask = lambda: sorted((r["path"][-6:], r["key"], r["value"]) for r in large_json.lookup_entries(large_json.refresh_index(spark, src, at), keys).collect())
    assert ask() == [("a.json", "x", "1"), ("b.json", "x", '{"z": 3}')] == ask()
    (tmp_path / "in" / "a.json").write_text('{"w": "longer", "x": 77}')
    (tmp_path / "in" / "b.json").unlink()
    assert ask() == [("a.json", "w", '"longer"'), ("a.json", "x", "77")]
