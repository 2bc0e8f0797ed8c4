"""Queries over embeddings and their SQL. Searches ask with every id divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import vector as fn
from loomery.operators import documents, vectors as ops
from loomery.operators.ivf import IvfIndex
from loomery.plans.documents import BM25, QUERY
from loomery.sources.scratch import new_path
from loomery.sources.tables import load_table


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "embeddings")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where("vec_id % 100 = 0")


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base(spark, sf_dir).select("vec_id", F.col("embedding").alias("a"))
    b = base(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", *[F.round(f("a", "b"), 6).alias(f.__name__) for f in (fn.dot, fn.cosine, fn.l2, fn.l1)])


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.knn(asked(spark, sf_dir), base(spark, sf_dir).where("label < 3"), 5))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.assign(base(spark, sf_dir), ops.centroid_vectors(base(spark, sf_dir)))
    return found.select("vec_id", "list_id", F.round("distance", 6).alias("distance"))


def ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the table, reopened. Two thirds of its lists are probed: these vectors lie alike in all directions, so lists part them badly."""
    path = new_path(spark, "ivf")
    IvfIndex.build(base(spark, sf_dir), path)
    return rounded(IvfIndex(spark, path).search(asked(spark, sf_dir), k=10, probes=0.67))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recall_at_k(ivf(spark, sf_dir), ops.knn(asked(spark, sf_dir), base(spark, sf_dir), 10))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = base(spark, sf_dir).select("vec_id", fn.l2_norm("embedding").alias("norm"), fn.normalize("embedding").alias("u"))
    return unit.select("vec_id", F.round("norm", 6).alias("norm"), F.posexplode("u").alias("pos", "v")).withColumn("v", F.round("v", 6))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by BM25 with the vectors nearest to vector 0, as if vec_id were the document's id."""
    words = documents.top(documents.bm25(load_table(spark, sf_dir, "documents"), QUERY), "score", "doc_id", 50)
    near = ops.knn(base(spark, sf_dir).where("vec_id = 0"), base(spark, sf_dir), 50)
    found = ops.hybrid(words.select(F.col("doc_id").alias("id"), "place"), near.select(F.col("vec_id").alias("id"), "place"), 20)
    return found.select("id", F.round("score", 9).alias("score"))


def diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ops.knn(asked(spark, sf_dir), base(spark, sf_dir), 50)
    return ops.mmr(near.join(base(spark, sf_dir).select("vec_id", "embedding"), "vec_id"), 0.5, 10)


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("vec_id", F.posexplode(fn.quantize("embedding")).alias("pos", "q"))
    return rows.select("vec_id", "pos", F.col("q").cast("int").alias("q"))


QUERIES = {
    "v1_dot": lambda s, d: pairs(s, d).select("vec_id", F.round(fn.dot("a", "b"), 6).alias("dot")),
    "v2_normalize": normalized,
    "v3_metrics": metrics,
    "v4_knn": lambda s, d: rounded(ops.knn(asked(s, d), base(s, d), 10)),
    "v4_knn_l2": lambda s, d: rounded(ops.knn(asked(s, d), base(s, d), 10, "l2")),
    "v5_range_search": lambda s, d: rounded(ops.range_search(asked(s, d), base(s, d), 0.3)),
    "v6_filtered_knn": filtered,
    "v7_knn_lsh": lambda s, d: rounded(ops.knn_lsh(asked(s, d), base(s, d), 10)),
    "v8_centroids": lambda s, d: ops.centroids(base(s, d)).withColumn("value", F.round("value", 6)),
    "v9_assign": assigned,
    "v10_ivf_search": ivf,
    "v11_quantize": quantized,
    "v12_hybrid": fused,
    "v13_recall_at_k": ivf_recall,
    "v14_mmr": diverse,
}

D = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
NEXT = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
ASKED = "embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


def _knn(score: str, k: int, where: str = "TRUE") -> str:
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, place::INT AS place FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
        SELECT a.vec_id AS query_id, b.vec_id, {score} AS score FROM {ASKED} WHERE {where})) WHERE place <= {k}"""


MEANS = "SELECT label, pos, avg(v) AS value FROM (SELECT label, unnest(range(64))::INT AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, pos"

ORACLE_SQL = {
    "v1_dot": f"SELECT a.vec_id, round({D}, 6) AS dot FROM {NEXT}",
    "v2_normalize": """SELECT vec_id, round(n, 6) AS norm, unnest(range(64))::INT AS pos, unnest(list_transform(e, lambda x: round(x / n, 6))) AS v
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "v3_metrics": f"""SELECT a.vec_id, round({D}, 6) AS dot, round({COSINE}, 6) AS cosine, round({L2}, 6) AS l2,
        round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS l1 FROM {NEXT}""",
    "v4_knn": _knn(COSINE, 10),
    "v4_knn_l2": _knn(f"-{L2}", 10),
    "v5_range_search": f"""SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 6) AS score FROM {ASKED} WHERE {COSINE} >= 0.3""",
    "v6_filtered_knn": _knn(COSINE, 5, "b.label < 3"),
    "v8_centroids": f"SELECT label, pos, round(value, 6) AS value FROM ({MEANS})",
    "v9_assign": f"""SELECT vec_id, label::BIGINT AS list_id, round(distance, 6) AS distance FROM (
        SELECT vec_id, c.label, list_distance(embedding::DOUBLE[], c.v) AS distance,
               row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], c.v), c.label) AS place
        FROM embeddings, (SELECT label, list(value ORDER BY pos) AS v FROM ({MEANS}) GROUP BY label) c) WHERE place = 1""",
    "v11_quantize": """SELECT vec_id, unnest(range(64))::INT AS pos,
        unnest(list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127)))::INT)) AS q FROM embeddings""",
    "v12_hybrid": f"""WITH words AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM ({BM25}) QUALIFY p <= 50),
        near AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY {COSINE} DESC, b.vec_id) AS q
                 FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0 QUALIFY q <= 50)
        SELECT id, round(score, 9) AS score FROM (
          SELECT id, coalesce(1.0::DOUBLE / (60 + p), 0) + coalesce(1.0::DOUBLE / (60 + q), 0) AS score FROM words FULL JOIN near USING (id))
        ORDER BY score DESC, id LIMIT 20""",
}
