"""Flushes of N results over batches, restarts and repeated batches."""

import pytest
from pyspark.sql import functions as F

from spanforge.streaming import arrivals


@pytest.fixture
def folder(spark, tmp_path):
    def arrive(first, rows):
        spark.range(first, first + rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(n=10, close=True):
        stream = arrivals.arriving_files(spark, str(tmp_path / "in"), spark.range(1).schema, glob="*.parquet", files_per_batch=1)
        derive = lambda b: b.groupBy("flush").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
        arrivals.flush_every_n(stream, n, derive, str(tmp_path / "out"), str(tmp_path / "state"), close=close)
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("flush").collect()
        return [r["n"] for r in rows], sorted(i for r in rows for i in r["ids"])

    return arrive, run, tmp_path


def test_sizes_over_batches_and_restarts(folder):
    arrive, run, _ = folder
    arrive(0, 7)
    arrive(7, 18)
    assert run(close=False) == ([10, 10], list(range(20)))
    arrive(25, 3)
    assert run(close=False)[0] == [10, 10]  # eight are carried on
    arrive(28, 14)
    assert run() == ([10, 10, 10, 10, 2], list(range(42)))
    assert run()[0] == [10, 10, 10, 10, 2]  # nothing new
    arrive(42, 25)
    assert run() == ([10, 10, 10, 10, 2, 10, 10, 5], list(range(67)))


def test_a_failed_batch_is_repeated(spark, folder, monkeypatch):
    arrive, run, path = folder
    arrive(0, 25)
    run(close=False)
    arrive(25, 12)
    real = arrivals.with_position
    monkeypatch.setattr(arrivals, "with_position", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception):
        run(close=False)
    monkeypatch.setattr(arrivals, "with_position", real)
    assert run() == ([10, 10, 10, 7], list(range(37)))


def test_folders_of_flushes_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("id", "id % 3 AS kind")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving_files(spark, str(tmp_path / "in"), rows.schema, glob="*.parquet")
    derive = lambda b: b.groupBy("flush", "kind").agg(F.count(F.lit(1)).alias("n"))
    arrivals.flush_every_n(stream, 50, derive, str(tmp_path / "out"), str(tmp_path / "state"), ["id"])
    files = list((tmp_path / "out").glob("flush=*/part-*.parquet"))
    assert len(files) == 80 and len({f.name.split("-")[1] for f in files}) > 1
    sizes = spark.read.parquet(str(tmp_path / "out")).groupBy("flush").agg(F.sum("n").alias("n"))
    assert {r.flush: r.n for r in sizes.collect()} == dict.fromkeys(range(80), 50)
