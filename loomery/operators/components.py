"""Connected components of an edge table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.scratch import save


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a, b: of one orderable type); one root for a component.

    Each round every node moves to the neighbour (or itself) that a hash of the
    round puts first, and the edges are those between the nodes moved to. A
    fresh order each round removes a constant share of the nodes, so the rounds
    grow with the logarithm of the longest path. A hub is an ordinary key: its
    edges meet in a partial minimum, and joins bring it one row.

    Each round's tables are written to the shared folder, so lineage stays
    short and a lost executor costs the tasks it ran. Nothing is collected but
    whether edges are left.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = save(both.distinct(), "edges")
    steps = []
    for step in range(max_rounds):
        if both.isEmpty():
            break
        first = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("n"))
        moves = both.groupBy("a").agg(F.min(first("b")).alias("m"))
        moves = save(moves.select(F.col("a").alias("node"), F.least("m", first("a"))["n"].alias("to")), "moves")
        steps.append(moves)
        at_a, at_b = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        both = both.join(at_a, "a").join(at_b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        both = save(both.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].withColumnRenamed("to", "root")
    for moves in steps[1:]:
        after = roots.join(moves.withColumnRenamed("node", "root"), "root", "left")
        roots = after.select(roots["node"], F.coalesce("to", "root").alias("root"))
    return save(roots, "roots")
