"""Arriving files."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.plans.registry import R6, query, r6
from spanforge.sources import views
from spanforge.streaming import arrivals


def event_files(spark, sf, **options):
    schema = views.table(spark, sf, "events").schema
    return arrivals.arriving_files(spark, sf, schema, glob="events*.parquet", **options)


@query(
    "watch_arrivals",
    "SELECT DISTINCT user_id, c_name AS name, c_mktsegment AS label FROM events JOIN customer ON user_id = c_custkey",
)
def watch_arrivals(spark, sf):
    known = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label")
    )
    stream = event_files(spark, sf).select("user_id")
    return arrivals.run_to_table(
        arrivals.watch_arrivals(stream, known, ["user_id"]), *arrivals.scratch(spark, "arrivals")
    )


@query("seen_once", "SELECT DISTINCT user_id, event_type FROM events")
def seen_once(spark, sf):
    stream = event_files(spark, sf).select("user_id", "event_type")
    return arrivals.run_to_table(
        arrivals.seen_once(stream, ["user_id", "event_type"]), *arrivals.scratch(spark, "seen")
    )


@query(
    "flush_every_n",
    f"""SELECT i AS flush, CAST(least(700, n - 700 * i) AS BIGINT) AS n, total FROM (SELECT count(*) AS n, {R6("sum(value)")} AS total FROM events),
    LATERAL (SELECT unnest(range(0, CAST(ceil(n / 700.0) AS BIGINT))) AS i)""",
)
def flush_every_n(spark, sf):
    """Events in files of a day each; half of them arrive, the query stops, and goes on where it was when the others are there."""
    out, state = arrivals.scratch(spark, "flush")
    folder = arrivals.scratch(spark, "days")[0]
    events = views.table(spark, sf, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    middle = F.lit(events.agg(F.percentile_approx(F.unix_date("day"), 0.5)).first()[0])
    derive = lambda b: b.groupBy("flush", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    for part, close in ((F.unix_date("day") <= middle, False), (F.unix_date("day") > middle, True)):
        events.filter(part).repartition(4, "day").write.mode("append").parquet(folder)
        stream = arrivals.arriving_files(spark, folder, events.schema, glob="*.parquet", files_per_batch=3)
        arrivals.flush_every_n(stream, 700, derive, out, state, ["event_id"], close)
    written = spark.read.parquet(out)
    sizes = written.groupBy("flush").agg(F.sum("n").alias("n"))
    return sizes.join(written.agg(r6(F.sum("total")).alias("total"))).select(F.col("flush").cast("long").alias("flush"), "n", "total")
