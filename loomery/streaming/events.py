"""Structured Streaming over an event table with ``ts``, ``user_id``, ``event_type``, ``value``.

Each function takes a streaming (or, where it says so, batch) DataFrame and
returns one; ``run`` drives a query over what is available and ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomery.sources.scratch import new_path
from loomery.streaming.upserts import UpsertTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a zoned timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run an available-now query to its end and return what it wrote.

    In append mode the sink is Parquet in the shared folder. Of a complete
    query the last batch's rows stay. An update query's batches hold the keys
    that changed: each is a folder of its own, ``batch=<number>``, and the rows
    of the last batch that a key (of ``keys``) is in are returned.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that later batches replace")
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "update" else out)
        done.append(number)

    query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    last = F.max("batch").over(Window.partitionBy(*keys))
    return rows.withColumn("__last", last).where("batch = __last").drop("batch", "__last")


def tumbling(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of each window and event type; batch or stream."""
    return sliding(events, length, length, late)


def sliding(events: DataFrame, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    rows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "event_type")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    rows = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "user_id", "n", "total")


def distinct_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def enrich(events: DataFrame, static: DataFrame, event_key: str, static_key: str) -> DataFrame:
    """A stream joined with a static table; events without a match keep nulls."""
    return timed(events).join(static, F.col(event_key) == F.col(static_key), "left")


def interval_join(left: DataFrame, right: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of one user's events where the right one follows within ``within``; both sides keep bounded state."""
    a = timed(left).withWatermark("ts", late).select(F.col("user_id").alias("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = timed(right).withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    near = F.expr(f"user_id = u AND then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within}")
    return a.join(b, near).select("user_id", "first_id", "then_id")


def count_per_user(events: DataFrame) -> DataFrame:
    """Running counts by custom state: a row per user and batch with events. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.n = handle.getValueState("n", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
            before = self.n.get()[0] if self.n.exists() else 0
            total = before + sum(len(r) for r in rows)
            self.n.update((total,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [total]})

        def close(self) -> None:
            pass

    return (
        events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Counter(), outputStructType="user_id long, n long", outputMode="update", timeMode="None")
    )


def run_upsert(stream: DataFrame, key: str, version: str, every: int = 8) -> DataFrame:
    """Run an available-now query into an ``UpsertTable`` and return its state."""
    spark = stream.sparkSession
    path, state = new_path(spark, "upsert"), new_path(spark, "stream-checkpoint")
    table = UpsertTable(spark, path, stream.schema, key, version, every=every)
    query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(table.write).queryName(f"u{uuid.uuid4().hex}").start()
    query.awaitTermination()
    return table.state()
