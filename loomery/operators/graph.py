"""Knowledge graph: triples ``src, pred, dst, weight``, patterns, walks and measures.

Walks keep only the frontier and the visited nodes. Each round writes its small
tables to the shared folder, which cuts lineage and outlives a lost executor.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.components import connected_components
from loomery.sources.scratch import discard, save


#: Steps of a path that one plan holds.
HOPS = 16


def triples(tables: dict[str, DataFrame]) -> DataFrame:
    """The edges of the star schema; ids are like ``customer:17``."""

    def edge(df: DataFrame, src: str, src_key: str, pred: str, dst: str, dst_key: str, weight=None) -> DataFrame:
        name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        return df.select(
            name(src, src_key).alias("src"), F.lit(pred).alias("pred"), name(dst, dst_key).alias("dst"), (F.lit(1.0) if weight is None else weight).alias("weight")
        )

    t = tables
    parts = [
        edge(t["nation"], "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
        edge(t["customer"], "customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
        edge(t["supplier"], "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"),
        edge(t["orders"], "order", "o_orderkey", "placed_by", "customer", "o_custkey", F.col("o_totalprice")),
    ]
    supplied = t["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    parts.append(edge(supplied, "supplier", "l_suppkey", "supplies", "part", "l_partkey", F.col("q")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _pattern(edges: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of one pattern; parts with a leading ``?`` are variables."""
    src, pred, dst = pattern
    rows = edges
    for column, part in (("src", src), ("pred", pred), ("dst", dst)):
        if not part.startswith("?"):
            rows = rows.where(F.col(column) == part)
    named: dict[str, str] = {}
    for column, part in (("src", src), ("pred", pred), ("dst", dst)):
        if part.startswith("?"):
            if part in named:
                rows = rows.where(F.col(column) == F.col(named[part]))
            else:
                named[part] = column
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in named.items()])


def match(edges: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings that satisfy all patterns: an equi-join on what each shares with those before."""
    out = _pattern(edges, patterns[0])
    for pattern in patterns[1:]:
        more = _pattern(edges, pattern)
        shared = [c for c in more.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{pattern} shares no variable with the patterns before it")
        out = out.join(more, shared)
    return out


def optional_match(bound: DataFrame, edges: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    more = _pattern(edges, pattern)
    return bound.join(more, [c for c in more.columns if c in bound.columns], "left")


def not_exists(bound: DataFrame, edges: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    more = _pattern(edges, pattern)
    return bound.join(more, [c for c in more.columns if c in bound.columns], "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``a, b`` both ways, without loops."""
    pairs = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _links(edges: DataFrame) -> DataFrame:
    """The ends of ``edges``, written once, so that hops don't make the edges again."""
    return save(edges.where("src <> dst").select("src", "dst"), "links")


def _ahead(links: DataFrame, frontier: DataFrame, both_ways: bool) -> DataFrame:
    """``a, id`` for the steps from the nodes of ``frontier`` (``id``); only these are shuffled, or none if the frontier is small."""
    own = frontier.select(F.col("id").alias("a"))
    steps = links.join(own, F.col("src") == F.col("a")).select("a", F.col("dst").alias("id"))
    return steps.unionByName(links.join(own, F.col("dst") == F.col("a")).select("a", F.col("src").alias("id"))) if both_ways else steps


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, both_ways: bool = False) -> DataFrame:
    """``id, depth``: nodes within ``max_depth`` steps of ``seeds`` (``id``) and their least distance."""
    links = _links(edges)
    seen = save(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for depth in range(1, max_depth + 1):
        ahead = _ahead(links, frontier, both_ways).select("id").distinct()
        frontier = save(ahead.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``id, depth`` of the nodes 1 to ``hops`` steps from the seeds, either way."""
    return reachable(edges, seeds, hops, both_ways=True).where("depth > 0")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int | None = None) -> DataFrame:
    """``step, id`` of a shortest path, either way along edges; the least predecessor each time. Empty without one.

    The search goes on until it has met all that ``start`` is connected with.
    Where ``max_depth`` is given and reached before, it raises.
    """
    spark = edges.sparkSession
    links = _links(edges)
    seen = save(spark.range(1).select(F.lit(start).alias("id"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("depth")), "path")
    frontier, found, levels, depth = seen, start == end, [], 0
    for depth in itertools.count(1):
        if found:
            depth -= 1
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"no path within {max_depth} steps, and not all nodes met")
        ahead = _ahead(links, frontier, True).groupBy("id").agg(F.min("a").alias("via"))
        frontier = save(ahead.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "path")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
        if depth % HOPS == 0:  # a table of few parts, however long the path
            seen = save(seen, "path")
        found = not frontier.where(F.col("id") == end).isEmpty()
    if not found:
        return spark.createDataFrame([], "step int, id string")
    steps, at = [(depth, end)] if levels else [(0, end)], end
    while levels:  # a job for some levels: a row of each, by the row before
        some, levels = levels[-HOPS:], levels[:-HOPS]
        row = some[-1].where(F.col("id") == at).select("depth", "via")
        rows = [row]
        for level in some[-2::-1]:
            row = level.join(F.broadcast(row.select(F.col("via").alias("id"))), "id").select("depth", "via")
            rows.append(row)
        found = sorted(reduce(DataFrame.unionByName, rows).collect(), reverse=True)
        steps += [(r.depth - 1, r.via) for r in found]
        at = found[-1].via
    return spark.createDataFrame(steps, "step int, id string")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out``; partial counts form before the one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum(1 - F.col("e.o")).alias("n_in"), F.sum("e.o").alias("n_out"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the least id that edges connect a node with."""
    roots = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select(F.col("node").alias("id"), "component")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 200) -> DataFrame:
    """``id, rank``; ranks sum to 1. What nodes without out-edges hold is shared among all.

    Rank that a node has but hasn't passed on is its residual. Each round the
    nodes with residual pass it on, those whose share of it is under
    ``tolerance`` of the usual rank excepted; it ends when there are none, so a
    graph without cycles takes as many rounds as its longest path. Nodes without
    out-edges need no part in that: sharing what they hold evenly only scales
    the ranks, so these are divided by their sum at last.

    Contributions form partial sums before their shuffle, so a node that much
    points at costs no more than others; what a node sends is joined by source,
    where a large one may be split.
    """
    links = save(edges.select("src", "dst").distinct(), "links")
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = save(links.join(out, "src").select("src", "dst", (damping / F.col("out")).alias("share")), "links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    state = save(ends.select("id", F.lit(0.0).alias("rank"), F.lit(1.0).alias("rest")), "ranks")
    active = F.col("rest") > tolerance
    for _ in range(most_rounds):
        passed = links.join(state.where(active).select(F.col("id").alias("src"), "rest"), "src")
        given = passed.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rest") * F.col("share")).alias("got"))
        rest = F.when(active, 0.0).otherwise(F.col("rest")) + F.coalesce("got", F.lit(0.0))
        rank = F.col("rank") + F.when(active, F.col("rest")).otherwise(0.0)
        before, state = state, save(state.join(given, "id", "left").select("id", rank.alias("rank"), rest.alias("rest")), "ranks")
        discard(before)
        if state.where(active).isEmpty():
            break
    whole = state.select("id", (F.col("rank") + F.col("rest")).alias("rank"))
    total = whole.agg(F.sum("rank").alias("total"))
    return whole.join(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from its end of lesser degree: no node then has many."""
    both = undirected(edges)
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    return ranked.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("a") < F.col("b")))).select("a", "b")


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c`` with a < b < c of each triangle of the undirected graph.

    Edges go from lesser to greater degree, so a node starts at most about the
    square root of twice the edges, and the wedges at a hub never form.
    """
    one = save(_oriented(edges), "oriented")
    wedges = one.join(one.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = one.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    ends = F.array_sort(F.array("a", "b", "c"))
    return wedges.join(closed, ["b", "c"]).select(ends[0].alias("a"), ends[1].alias("b"), ends[2].alias("c"))


def common_neighbors(edges: DataFrame) -> DataFrame:
    """``a, b, common, jaccard`` of the two ends of each undirected edge, a < b."""
    both = undirected(edges)
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    found = triangles(edges)
    sides = F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    shared = found.select(sides.alias("s")).groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("common"))
    pairs = both.where("a < b").join(shared, ["a", "b"], "left")
    pairs = pairs.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    common = F.coalesce("common", F.lit(0).cast("long"))
    return pairs.select("a", "b", common.alias("common"), (common / (F.col("d") + F.col("e") - common)).alias("jaccard"))


def cooccurrence(terms: DataFrame, distance: int, id_col: str = "doc_id") -> DataFrame:
    """``a, b, n``: how often terms a < b stand at most ``distance`` apart in a document.

    ``terms`` has the id and the term array ``t``; pairs form within the row, a
    fixed number for each term.
    """
    near = lambda k: F.transform("t", lambda x, i: F.struct(x.alias("x"), F.get("t", i + k).alias("y")))
    pairs = terms.select(F.explode_outer(F.flatten(F.array(*map(near, range(1, distance + 1))))).alias("p")).where("p.x <> p.y")
    return pairs.groupBy(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def resolve_entities(links: DataFrame) -> DataFrame:
    """``id, canonical``: the least id among those that ``links`` (src, dst) call the same."""
    return components(links).withColumnRenamed("component", "canonical")


def expand(hits: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``id, depth``: the hits (``id``) and what lies within ``hops`` of them."""
    return reachable(edges, hits, hops, both_ways=True)
