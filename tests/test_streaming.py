from __future__ import annotations

import datetime as dt

import pytest

from quarryline.sources import versions
from quarryline.streaming import status

T0 = dt.datetime(2031, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id string, status string, conclusion string, observed_at timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_completion_and_timeout(spark, tmp_path):
    src = feed(
        spark, str(tmp_path / "in"),
        [("a", "queued", None, at(0)), ("b", "in_progress", None, at(1))],
        [("a", "completed", "success", at(15)), ("a", "completed", "failure", at(20))],
        [("c", "queued", None, at(2000))], [("c", "queued", None, at(2100))],
    )
    q = status.track(src).writeStream.format("memory").queryName("finals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: (r["outcome"], r["polls"]) for r in spark.sql("select * from finals").collect()}
    assert got["a"] == ("success", 2) and got["b"] == ("timed_out", 1) and "c" not in got


def test_upsert_is_idempotent(spark, tmp_path):
    src = feed(spark, str(tmp_path / "in"), [("a", "queued", None, at(0)), ("b", "queued", None, at(0))], [("a", "completed", "success", at(5))])
    out = str(tmp_path / "out")
    for _ in range(2):
        status.upsert_batches(src, out, ["id"], "observed_at", str(tmp_path / "cp")).awaitTermination(120)
    assert {r["id"]: r["status"] for r in versions.read_table(spark, out).collect()} == {"a": "completed", "b": "queued"}


@pytest.mark.parametrize("step", ["write_text", "replace_file"])
def test_upsert_survives_a_crash_between_its_steps(spark, tmp_path, monkeypatch, step):
    first = [(f"k{i}", "queued", None, at(0)) for i in range(200)]
    src = feed(spark, str(tmp_path / "in"), first, [("k1", "completed", "success", at(5))], [("k2", "completed", "failure", at(6))])
    out, real, calls = str(tmp_path / "out"), getattr(versions, step), []

    def crash(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed")
        return real(*args)

    monkeypatch.setattr(versions, step, crash)
    with pytest.raises(Exception, match="killed"):
        status.upsert_batches(src, out, ["id"], "observed_at", str(tmp_path / "cp"), 8).awaitTermination(120)
    kept = {r["id"]: r["status"] for r in versions.read_table(spark, out).collect()}
    assert len(kept) == 200 and set(kept.values()) == {"queued"}
    status.upsert_batches(src, out, ["id"], "observed_at", str(tmp_path / "cp"), 8).awaitTermination(120)
    now = {r["id"]: r["status"] for r in versions.read_table(spark, out).collect()}
    assert len(now) == 200 and {k for k, v in now.items() if v == "completed"} == {"k1", "k2"}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    out = str(tmp_path / "out")
    versions.merge_batch(spark.createDataFrame([(f"k{i}", "queued", None, at(0)) for i in range(500)], SCHEMA), 0, out, ["id"], "observed_at", 16)
    versions.merge_batch(spark.createDataFrame([("k1", "done", None, at(1))], SCHEMA), 1, out, ["id"], "observed_at")
    by = versions.read_manifest(spark, out)
    assert sorted(by["buckets"].values()) == ["v0"] * 15 + ["v1"] and by["batch"] == 1
    versions.merge_batch(spark.createDataFrame([("k1", "again", None, at(9))], SCHEMA), 1, out, ["id"], "observed_at")
    assert versions.read_table(spark, out).filter("id = 'k1'").first()["status"] == "done" and versions.read_table(spark, out).count() == 500
    assert versions.read_table(spark, str(tmp_path / "none")) is None


def test_batch_twin(spark):
    df = spark.createDataFrame([("a", "queued", None, at(0)), ("a", "completed", "failure", at(9)), ("b", "queued", None, at(1))], SCHEMA)
    assert {r["id"]: r["outcome"] for r in status.final_status(df).collect()} == {"a": "failure", "b": "waiting"}


def test_windows_in_stream_and_batch(spark, tmp_path):
    rows = [("a", "queued", None, at(m)) for m in (0, 5, 70)]
    batch = status.windowed_counts(spark.createDataFrame(rows, SCHEMA), "observed_at", "1 hour", None, ["id"])
    assert sorted(r["n"] for r in batch.collect()) == [1, 2]
    stream = status.windowed_counts(feed(spark, str(tmp_path / "in"), rows), "observed_at", "1 hour", None, ["id"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.sql("select * from wins").collect()) == [1, 2]
