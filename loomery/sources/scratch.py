"""Tables written to the folder that driver and executors share.

Cutting lineage here survives lost executors: the files belong to no executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Only where the setting is unset and Spark runs on this machine alone (local
    runs, tests) a temporary folder takes its place, once for a session. On a
    cluster executors wouldn't share that folder, so there the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("loomery.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="loomery-")
            spark.conf.set("loomery.scratch.dir", root)
    return f"{root.rstrip('/')}/loomery-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of what was written.

    What follows reads the table, so the shuffle files of the write can go.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
