"""Queries over the star schema as triples and over the graph of nearest vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import terms
from loomery.operators import graph as ops
from loomery.operators import entities, similarity, vectors
from loomery.plans.documents import SIMILAR
from loomery.plans.vectors import COSINE
from loomery.sources.scratch import save
from loomery.sources.tables import load_table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "customer", "supplier", "orders", "lineitem")
    return ops.triples({n: load_table(spark, sf_dir, n) for n in names})


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest others of every vector."""
    return save(vectors.knn_graph(load_table(spark, sf_dir, "embeddings"), 3), "near")


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = ops.match(e, [("?nation", "in_region", "region:1"), ("?customer", "in_nation", "?nation"), ("?order", "placed_by", "?customer")])
    return found.groupBy("nation").agg(F.countDistinct("customer").alias("n_customers"), F.count(F.lit(1)).alias("n_orders"))


def optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    customers = ops.match(e, [("?customer", "in_nation", "?nation")]).where("customer LIKE 'customer:%'")
    found = ops.optional_match(customers, e, ("?order", "placed_by", "?customer"))
    return found.groupBy("customer", "nation").agg(F.count("order").alias("n_orders"))


def without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that supplier 1 does not supply."""
    e = edges(spark, sf_dir)
    parts = ops.match(e, [("?supplier", "supplies", "?part")]).select("part").distinct()
    return ops.not_exists(parts, e, ("supplier:1", "supplies", "?part"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reachable(edges(spark, sf_dir).where("pred <> 'supplies'"), edges(spark, sf_dir).where("pred = 'placed_by'").select(F.col("src").alias("id")), 4)


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.shortest_path(edges(spark, sf_dir), "customer:1", "supplier:1")
    return found.agg(F.max("step").alias("hops"))


def same_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand, type and size are one entity; each is linked with the least of them."""
    part = load_table(spark, sf_dir, "part")
    key = ["p_brand", "p_type", "p_size"]
    least = part.groupBy(*key).agg(F.min("p_partkey").alias("dst"))
    links = part.join(least, key).where("p_partkey <> dst").select(F.col("p_partkey").alias("src"), "dst")
    return ops.resolve_entities(links)


def like_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that cost about the same and agree in brand, size (3 points each), noun (2), adjective and type (1 each) for 7 points are one entity."""
    word = lambda k: F.get(F.split("p_name", " "), F.lit(k))
    keys = [F.col("p_brand"), F.col("p_size"), word(1), word(0), F.col("p_type")]
    return entities.resolve_close(load_table(spark, sf_dir, "part"), "p_partkey", keys, [3, 3, 2, 1, 1], 7, F.col("p_retailprice"), 10)


def cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "documents").select("doc_id", terms("text").alias("t"))
    return ops.cooccurrence(rows, 2)


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten richest customers (ties by key) and what is two steps away."""
    best = load_table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    hits = best.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return ops.expand(hits, edges(spark, sf_dir), 2)


QUERIES = {
    "g1_triples": edges,
    "g2_match": matched,
    "g3_optional_match": optional,
    "g3_not_exists": without,
    "g4_neighbors": lambda s, d: ops.neighbors(edges(s, d), seed(s, "customer:1"), 2),
    "g5_reachable": hops,
    "g6_shortest_path": path,
    "g7_degrees": lambda s, d: ops.degrees(edges(s, d)),
    "g8_connected_components": lambda s, d: ops.components(near(s, d)),
    "g9_pagerank": lambda s, d: ops.pagerank(edges(s, d)),
    "g10_triangles": lambda s, d: ops.triangles(near(s, d)),
    "g11_common_neighbors": lambda s, d: ops.common_neighbors(near(s, d)).withColumn("jaccard", F.round("jaccard", 6)),
    "g12_cooccurrence": cooccurring,
    "g13_resolve_entities": same_parts,
    "g13_resolve_parts": like_parts,
    "g13_resolve_documents": lambda s, d: entities.resolve_texts(similarity.similar_texts(load_table(s, d, "documents"))),
    "g14_knn_graph": lambda s, d: near(s, d).withColumn("score", F.round("score", 6)),
    "g15_expand": expanded,
}

EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'in_region' AS pred, 'region:' || n_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, 1.0 FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, o_totalprice FROM orders
  UNION ALL SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, sum(l_quantity) FROM lineitem GROUP BY l_suppkey, l_partkey)"""
BOTH = "both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
NEAR = f"""near AS (SELECT src, dst, score FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, {COSINE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS place
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE place <= 3),
  und AS (SELECT src AS a, dst AS b FROM near UNION SELECT dst, src FROM near),
  tri AS (SELECT x.a, x.b, y.b AS c FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b)"""


def _walk(start: str, depth: int) -> str:
    return f"""walk AS ({start} UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < {depth})"""


ORACLE_SQL = {
    "g1_triples": f"WITH {EDGES} SELECT * FROM edges",
    "g2_match": f"""WITH {EDGES} SELECT n.src AS nation, count(DISTINCT c.src) AS n_customers, count(*) AS n_orders
        FROM edges n JOIN edges c ON c.pred = 'in_nation' AND c.dst = n.src JOIN edges o ON o.pred = 'placed_by' AND o.dst = c.src
        WHERE n.pred = 'in_region' AND n.dst = 'region:1' GROUP BY n.src""",
    "g3_optional_match": f"""WITH {EDGES} SELECT c.src AS customer, c.dst AS nation, count(o.src) AS n_orders
        FROM edges c LEFT JOIN edges o ON o.pred = 'placed_by' AND o.dst = c.src
        WHERE c.pred = 'in_nation' AND c.src LIKE 'customer:%' GROUP BY c.src, c.dst""",
    "g3_not_exists": f"""WITH {EDGES} SELECT DISTINCT dst AS part FROM edges e WHERE pred = 'supplies'
        AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.pred = 'supplies' AND o.src = 'supplier:1' AND o.dst = e.dst)""",
    "g4_neighbors": f"""WITH RECURSIVE {EDGES}, {BOTH}, {_walk("SELECT 'customer:1' AS id, 0 AS depth", 2)}
        SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id HAVING min(depth) > 0""",
    "g5_reachable": f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE pred <> 'supplies'),
        {_walk("SELECT DISTINCT src AS id, 0 AS depth FROM edges WHERE pred = 'placed_by'", 4)}
        SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""",
    "g6_shortest_path": f"""WITH RECURSIVE {EDGES}, {BOTH}, {_walk("SELECT 'customer:1' AS id, 0 AS depth", 4)}
        SELECT min(depth)::INT AS hops FROM walk WHERE id = 'supplier:1'""",
    "g7_degrees": f"""WITH {EDGES} SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out
        FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id""",
    "g8_connected_components": f"""WITH RECURSIVE {NEAR}, walk AS (SELECT a AS id, a AS seen FROM und UNION SELECT id, b FROM walk JOIN und ON a = seen)
        SELECT id, min(seen) AS component FROM walk GROUP BY id""",
    "g10_triangles": f"WITH {NEAR} SELECT * FROM tri",
    "g11_common_neighbors": f"""WITH {NEAR}, deg AS (SELECT a, count(*) AS d FROM und GROUP BY a),
        com AS (SELECT x.a, y.a AS b, count(*) AS n FROM und x JOIN und y ON x.b = y.b WHERE x.a < y.a GROUP BY x.a, y.a)
        SELECT u.a, u.b, coalesce(n, 0)::BIGINT AS common, round(coalesce(n, 0) / (p.d + q.d - coalesce(n, 0))::DOUBLE, 6) AS jaccard
        FROM und u LEFT JOIN com ON com.a = u.a AND com.b = u.b JOIN deg p ON p.a = u.a JOIN deg q ON q.a = u.b WHERE u.a < u.b""",
    "g12_cooccurrence": r"""WITH t AS (SELECT doc_id, pos, term FROM (
          SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term
          FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents)))
        SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n
        FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.pos IN (x.pos + 1, x.pos + 2) AND x.term <> y.term GROUP BY 1, 2""",
    "g13_resolve_entities": """SELECT p_partkey AS id, canonical FROM (
          SELECT p_partkey, min(p_partkey) OVER w AS canonical, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_size)) WHERE n > 1""",
    "g13_resolve_parts": """WITH RECURSIVE p AS (SELECT *, string_split(p_name, ' ') AS w FROM part),
        links AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 10
          AND 3 * (a.p_brand = b.p_brand)::INT + 3 * (a.p_size = b.p_size)::INT + 2 * (a.w[2] = b.w[2])::INT + (a.w[1] = b.w[1])::INT + (a.p_type = b.p_type)::INT >= 7),
        walk AS (SELECT p_partkey AS id, p_partkey AS seen FROM part UNION SELECT id, b FROM walk JOIN links ON a = seen)
        SELECT id, min(seen) AS canonical FROM walk GROUP BY id""",
    "g13_resolve_documents": SIMILAR.replace("WITH", "WITH RECURSIVE", 1) + """, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        walk AS (SELECT c AS id, c AS seen FROM (SELECT DISTINCT class_id AS c FROM members) UNION SELECT id, b FROM walk JOIN links ON a = seen)
        SELECT doc_id AS id, canonical FROM members JOIN (SELECT id AS class_id, min(seen) AS canonical FROM walk GROUP BY id) USING (class_id)""",
    "g14_knn_graph": f"WITH {NEAR} SELECT src, dst, round(score, 6) AS score FROM near",
    "g15_expand": f"""WITH RECURSIVE {EDGES}, {BOTH},
        hits AS (SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10), {_walk("SELECT id, 0 AS depth FROM hits", 2)}
        SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""",
}
