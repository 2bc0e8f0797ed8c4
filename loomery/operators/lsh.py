"""Approximate similarity join of texts by MinHash: a stored ML pipeline, bands, exact counts.

``HashingTF`` and ``MinHashLSH`` make signatures in compiled code. Spark's own
``approxSimilarityJoin`` meets two texts if they share any one minimum, which
texts of little in common often do; here minima are taken in bands, and a pair
meets if it shares a whole band. What meets is counted as in the exact join.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.blocks import pairs_within
from loomery.operators.similarity import BLOCK, Similar, _classes, _counted, _first_texts, _limit, _texts
from loomery.sources.scratch import save


def shingles(text: Column, words: int) -> Column:
    """The distinct shingles of a text of UTF-8 bytes; of fewer words the whole, of none nothing."""
    own = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x09-\\x0d ]+"), lambda w: w != "")

    def made(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, words), " "))

    once = F.get(F.transform(F.array(own), made), F.lit(0))  # as an element, the words are parted once, not for each shingle
    return F.array_distinct(F.filter(once, lambda s: s != ""))


def minhash_model(spark: SparkSession, tables: int = 40, features: int = 1 << 20, seed: int = 11) -> PipelineModel:
    """The pipeline from ``shingles`` to ``hashes``. It depends on no data, and ``save`` and ``PipelineModel.load`` keep it."""
    one = spark.createDataFrame([(["any"],)], "shingles array<string>")
    stages = [HashingTF(inputCol="shingles", outputCol="tf", numFeatures=features, binary=True), MinHashLSH(inputCol="tf", outputCol="hashes", numHashTables=tables, seed=seed)]
    return Pipeline(stages=stages).fit(one)


def similar_texts_lsh(df: DataFrame, model: PipelineModel, words: int = 5, threshold: float = 0.8, band: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Similar:
    """As ``similar_texts``, but only pairs that share a band of ``band`` minima are counted, so some are missed.

    Two texts of similarity s share one of the model's t / ``band`` bands with a
    probability of 1 - (1 - s ** band) ** (t / band): 0.995 at 0.8 with forty
    minima in bands of four. Every pair found is exact; classes, members and odd
    rows are as there.
    """
    limit, texts = _limit(threshold), _texts(df, id_col, text_col)
    classes, members = _classes(texts, words, limit, [])
    first = _first_texts(texts, classes).join(classes.select("c", F.col("class_id").alias("id"), "n").where("n > 0"), "id")
    rows = first.select("c", "n", shingles(F.col("text"), words).alias("shingles")).where(F.size("shingles") > 0)
    hashed = save(model.transform(rows).select("c", "n", "hashes"), "minhashes")  # else each minimum would hash the text again
    tables = model.stages[-1].getNumHashTables()
    minimum = lambda k: vector_to_array(F.get("hashes", F.lit(k)))[0]
    bands = [F.struct(F.lit(at).alias("band"), F.xxhash64(*map(minimum, range(at, at + band))).alias("key")) for at in range(0, tables - band + 1, band)]
    rows = save(hashed.select("c", "n", F.array(*bands).alias("bands")), "minhash-bands")
    met = pairs_within(rows.select("c", "n", F.explode("bands").alias("band")), "band", "c", BLOCK)
    near_sizes = F.least("a_n", "b_n") * limit.denominator >= F.greatest("a_n", "b_n") * limit.numerator
    met = save(met.where(near_sizes).select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).distinct(), "candidate-pairs")
    return Similar(members.withColumnRenamed("id", id_col), _counted(texts, classes, met, words, limit), met)
