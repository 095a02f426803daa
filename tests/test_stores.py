"""Stores rewrite only the buckets they must, and only when the counts add up."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanforge.sources import stores


@pytest.fixture
def store(spark, tmp_path):
    rows = [("d", f"v{i}", i, None if i % 3 else "x") for i in range(60)]
    path = str(tmp_path / "store")
    made = stores.create_store(spark.createDataFrame(rows, "dataset string, video_id string, n long, label string"), path, buckets=8)
    assert (made.version, made.rows) == (0, 60)
    return path


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def ids(spark, names):
    return spark.createDataFrame([("d", n) for n in names], "dataset string, video_id string")


def test_delete_leaves_other_buckets_alone(spark, store):
    before = files(store)
    done = stores.delete_stored(spark, store, ids(spark, ["v3", "v3", "v41", "other", None]))
    assert (done.version, done.changed, done.rows) == (1, 2, 58) and 1 <= len(done.rewritten) <= 2
    after = files(store)
    assert before.items() <= after.items()
    assert {p.split("bucket=")[1][0] for p in after.keys() - before.keys()} == set(map(str, done.rewritten))
    left = {r["video_id"] for r in stores.read_store(spark, store).collect()}
    assert left == {f"v{i}" for i in range(60)} - {"v3", "v41"}
    assert stores.read_store(spark, store, version=0).count() == 60  # the backup
    assert stores.delete_stored(spark, store, ids(spark, ["v3"])) == stores.Change(1, 0, 58, ())
    gone = stores.delete_stored(spark, store, ids(spark, [f"v{i}" for i in range(60)]))
    assert (gone.changed, gone.rows) == (58, 0) and stores.read_store(spark, store).count() == 0


def test_counts_that_do_not_add_up_change_nothing(spark, store, monkeypatch):
    real = stores._write
    monkeypatch.setattr(stores, "_write", lambda df, *a: real(df.filter("n <> 7"), *a))
    with pytest.raises(ValueError, match="had"):
        stores.delete_stored(spark, store, ids(spark, [f"v{i}" for i in range(0, 60, 2)]))
    monkeypatch.setattr(stores, "_write", real)
    assert stores.read_store(spark, store).count() == 60
    assert stores.delete_stored(spark, store, ids(spark, ["v0"])).rows == 59


def test_upsert_fills_and_replaces(spark, store):
    fresh = ids(spark, ["v0", "v1", "v2", "new"]).withColumns({"label": F.lit("y"), "score": F.lit(0.5)})
    done = stores.upsert_stored(spark, store, fresh, ["label", "score"])
    assert (done.changed, done.rows) == (3, 60) and len(done.rewritten) <= 3
    got = {r["video_id"]: (r["label"], r["score"]) for r in stores.read_store(spark, store).collect()}
    assert got["v0"] == ("x", 0.5) and got["v1"] == got["v2"] == ("y", 0.5) and got["v3"] == ("x", None) and len(got) == 60
    assert stores.upsert_stored(spark, store, fresh, ["label", "score"]).rewritten == ()
    forced = stores.upsert_stored(spark, store, fresh, ["label"], force=True)
    assert forced.changed == 1 and {r["label"] for r in stores.read_store(spark, store).filter("video_id = 'v0'").collect()} == {"y"}
