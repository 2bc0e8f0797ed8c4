"""A corpus in five stages: classify, drop near copies, decontaminate, mix, shard.

Each stage takes what the one before kept. All but the last return the columns
of ``documents``; the last adds ``shard`` and ``slot``. Rows with null or repeated
ids, null texts and equal rows go through every stage as its operator says, an
empty table gives an empty one, and further columns may have any names; those
named ``shard`` or ``slot`` come back with an underscore behind their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.crf import held_out, score_quality, train
from loomery.llm.mixing import mix_sources, word_count
from loomery.llm.names import renamed
from loomery.llm.registry import document_key
from loomery.sources.scratch import save
from loomery.sources.tables import load_table as table
from loomery.llm.sharding import shard_rows
from loomery.llm.simhash import one_of_each_group
from loomery.llm.winnowing import find_contamination, is_contaminated


#: The columns that stages read.
USED = ("doc_id", "text", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.3 or more; a null text is an empty one, and repeated rows score alike."""
    docs, names = renamed(docs, USED)
    field = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_quality(docs, field, docs.columns, score_col="score")
    return scored.where("score >= 0.3").drop("score").toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at three bits or fewer; texts without words are a group, of equal rows one stays."""
    return one_of_each_group(docs, budget=3, shingle=3, seed=42)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows, or with them in under a twentieth of their words; a text without words stays."""
    docs, names = renamed(docs, USED)
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, window=13)
    return found.where(~is_contaminated()).select(*docs.columns).toDF(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not, once or twice. A null source is one; documents of equal id in it go together."""
    docs, names = renamed(docs, USED)
    mixed = mix_sources(docs, (5, 2, 1), (3, 2), 2, "source", word_count("text"), document_key(), docs.columns)
    copies = F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int")))
    return mixed.where("__repeats > 0").select(*docs.columns, copies).select(*docs.columns).toDF(*names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows dealt into sixteen shards whose sizes differ by at most one, with ``shard`` and ``slot``."""
    return shard_rows(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The first stage is a trained field, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"stage-{k}")
    return docs
