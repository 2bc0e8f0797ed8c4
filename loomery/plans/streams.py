"""Streaming queries over the event table, run to the end of what is available, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.sources.scratch import new_path
from loomery.sources.tables import load_table, stream_table
from loomery.streaming import events as ops


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events")


def plain(df: DataFrame) -> DataFrame:
    """Times without zone and sums rounded, to be compared."""
    times = [c for c, kind in df.dtypes if kind == "timestamp"]
    out = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})
    return out.withColumn("total", F.round("total", 4)) if "total" in out.columns else out


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("copy")
    return ops.run(ops.distinct_events(twice, ["event_id"], "1 hour"), "append").select("event_id", "user_id")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ops.run(ops.enrich(stream(spark, sf_dir), customers, "user_id", "c_custkey"), "append").select("event_id", "c_mktsegment")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = stream(spark, sf_dir).where("event_type = 'click'")
    bought = stream(spark, sf_dir).where("event_type = 'purchase'")
    return ops.run(ops.interval_join(clicks, bought, "2 HOURS"), "append")


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a replay whose second file holds every tenth event, most of them long past the watermark."""
    path = new_path(spark, "late-events")
    events = load_table(spark, sf_dir, "events")
    for remainder in ("<> 0", "= 0"):  # a file each, read in the order they were written
        events.where(f"event_id % 10 {remainder}").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    source = stream_table(spark, path, "events", files_per_trigger=1)
    return plain(ops.run(ops.tumbling(source, "1 day"), "append"))


def custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ops.ROCKSDB)
    try:
        return ops.run(ops.count_per_user(stream(spark, sf_dir)), "update", ["user_id"])
    finally:
        spark.conf.set(key, before)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_upsert(stream(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


QUERIES = {
    "s1_file_stream": lambda s, d: ops.run(stream(s, d), "append").select("event_id", "user_id", "event_type", "value"),
    "s2_tumbling": lambda s, d: plain(ops.run(ops.tumbling(stream(s, d), "1 day"), "complete")),
    "s3_sliding": lambda s, d: plain(ops.run(ops.sliding(stream(s, d), "2 days", "1 day"), "complete")),
    "s4_sessions": lambda s, d: plain(ops.run(ops.sessions(stream(s, d), "2 hours"), "append")),
    "s5_dedup": deduplicated,
    "s6_enrich": enriched,
    "s7_interval_join": joined,
    "s8_late_data": late,
    "s9_custom_state": custom_state,
    "s10_upsert_sink": upserted,
}

ORACLE_SQL = {
    "s1_file_stream": "SELECT event_id, user_id, event_type, value FROM events",
    "s2_tumbling": "SELECT date_trunc('day', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "s3_sliding": """SELECT starts, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS starts, event_type, value FROM events) GROUP BY 1, 2""",
    "s5_dedup": "SELECT event_id, user_id FROM events",
    "s6_enrich": "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey",
    "s7_interval_join": """SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b USING (user_id)
        WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""",
    "s9_custom_state": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "s10_upsert_sink": """SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
}
