"""Tables: Parquet in, Parquet out, and a table as a stream of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "error") -> None:
    """Write Parquet, in folders by ``partition``.

    Rows are dealt out by the partition columns first, so that a folder gets
    few files; AQE splits what is too large for one task.
    """
    if partition:
        df.hint("rebalance", *partition).write.mode(mode).partitionBy(*partition).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def stream_table(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The same table as a stream of its files."""
    path = f"{directory}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
