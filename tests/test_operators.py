"""Properties and small cases that the fixtures don't hold."""

from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import text, vector
from loomery.operators import documents, graph, relational, vectors
from loomery.plans import relational as relational_plans
from loomery.plans import streams
from loomery.plans import vectors as vector_plans
from loomery.sources.scratch import new_path
from loomery.sources.tables import load_table, write_table
from loomery.streaming import events

SF = "/root/testdata/sf0.01"
CYCLES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("p", "p")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, "to", b, 1.0) for a, b in pairs], "src string, pred string, dst string, weight double")


def test_components_of_a_disconnected_cyclic_graph(spark):
    got = {r.id: r.component for r in graph.components(edges_of(spark, CYCLES)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(f"n{k:04}", f"n{k + 1:04}") for k in range(300)]
    hub = [("hub", f"z{k}") for k in range(500)]
    got = {r.id: r.component for r in graph.components(edges_of(spark, path + hub)).collect()}
    assert {got[f"n{k:04}"] for k in range(301)} == {"n0000"}
    assert {got[f"z{k}"] for k in range(500)} == {"hub"}


def test_walks(spark):
    e = edges_of(spark, CYCLES)
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.reachable(e, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [r.id for r in graph.shortest_path(e, "b", "d").orderBy("step").collect()] == ["b", "c", "d"]
    assert graph.shortest_path(e, "a", "x").count() == 0
    assert [r.id for r in graph.shortest_path(e, "a", "a").collect()] == ["a"]


def test_a_path_longer_than_twenty_steps(spark):
    chain = edges_of(spark, [(f"n{k:02}", f"n{k + 1:02}") for k in range(23)])
    assert [r.id for r in graph.shortest_path(chain, "n00", "n23").orderBy("step").collect()] == [f"n{k:02}" for k in range(24)]
    with pytest.raises(RuntimeError):
        graph.shortest_path(chain, "n00", "n23", max_depth=2)


def test_triangles_and_common_neighbors(spark):
    e = edges_of(spark, [*CYCLES, ("d", "a")])
    assert {tuple(r) for r in graph.triangles(e).collect()} == {("a", "b", "c"), ("a", "c", "d")}
    shared = {(r.a, r.b): r.common for r in graph.common_neighbors(e).collect()}
    assert shared[("a", "c")] == 2 and shared[("a", "b")] == 1 and shared[("x", "y")] == 0


def test_pagerank_equals_numpy(spark):
    """With cycles, nodes without out-edges, a hub and repeated edges."""
    pairs = [*CYCLES, ("d", "z"), ("d", "z"), *((f"n{k}", "hub") for k in range(30)), ("hub", "a")]
    names = sorted({n for p in pairs for n in p})
    n, step = len(names), np.zeros((len(names), len(names)))
    for src, dst in set(pairs):
        step[names.index(dst), names.index(src)] = 1
    out = step.sum(0)
    step = np.where(out > 0, step / np.maximum(out, 1), 1 / n)
    want = np.full(n, 1 / n)
    for _ in range(300):
        want = 0.15 / n + 0.85 * step @ want
    got = {r.id: r["rank"] for r in graph.pagerank(edges_of(spark, pairs)).collect()}
    assert set(got) == set(names) and sum(got.values()) == pytest.approx(1)
    assert max(abs(got[name] - want[k]) for k, name in enumerate(names)) < 1e-6
    assert graph.pagerank(edges_of(spark, pairs).limit(0)).collect() == []


def test_match_binds_a_repeated_variable(spark):
    assert [tuple(r) for r in graph.match(edges_of(spark, CYCLES), [("?x", "to", "?x")]).collect()] == [("p",)]
    with pytest.raises(ValueError):
        graph.match(edges_of(spark, CYCLES), [("?x", "to", "?y"), ("?u", "to", "?v")])


def test_ivf_recall_is_at_least_nine_tenths(spark):
    got = vector_plans.ivf_recall(spark, SF).first()
    assert got.n_queries == 5 and got.recall >= 0.9


def test_lsh_recall_is_at_least_nine_tenths(spark):
    base, asked = vector_plans.base(spark, SF), vector_plans.asked(spark, SF)
    got = vectors.recall_at_k(vectors.knn_lsh(asked, base, 10), vectors.knn(asked, base, 10, "l2")).first()
    assert got.recall >= 0.9


def test_lsh_fills_up_where_neighbours_are_far(spark):
    base, asked = (df.withColumn("embedding", F.transform("embedding", lambda x: x * 100)) for df in (vector_plans.base(spark, SF), vector_plans.asked(spark, SF)))
    got = vectors.knn_lsh(asked, base, 10)
    assert {tuple(r) for r in got.groupBy("query_id").count().collect()} == {(r.vec_id, 10) for r in asked.collect()}
    assert vectors.recall_at_k(got, vectors.knn(asked, base, 10, "l2")).first().recall >= 0.9


@pytest.mark.parametrize("block_bytes", [vectors.BLOCK_BYTES, 60_000, 1040])
def test_lsh_equals_the_join_by_buckets(spark, monkeypatch, block_bytes):
    """Of narrow buckets, without a row for each vector and table or for each pair of a bucket."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    base, asked = (df.where("vec_id < 300").select("vec_id", "embedding") for df in (vector_plans.base(spark, SF), vector_plans.base(spark, SF).where("vec_id % 50 = 7")))
    as_vector = lambda df: df.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.02, numHashTables=3, seed=3).fit(as_vector(base))
    pairs = model.approxSimilarityJoin(as_vector(asked), as_vector(base), 1.4, distCol="d").where("datasetA.vec_id <> datasetB.vec_id")
    want = vectors.best(pairs.select(F.col("datasetA.vec_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), (-F.col("d")).alias("score")), 4)
    rows = lambda df: sorted((r.query_id, r.place, r.vec_id, round(r.score, 6)) for r in df.collect())
    found, save = [], vectors.save
    monkeypatch.setattr(vectors, "save", lambda df, name: found.append((name, df)) or save(df, name))
    odd = spark.createDataFrame([(None, None), (9000, None)], "vec_id long, embedding array<float>")
    assert vectors.knn_lsh(asked.unionByName(odd), base.unionByName(odd), 4, bucket=0.02, tables=3, farthest=1.4, block_bytes=block_bytes).count() == 4 * asked.count()
    lsh = next(df for name, df in found if name == "lsh")
    assert rows(lsh) == rows(want) and 0 < pairs.count() < 6 * 150
    assert "Join" not in lsh._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_ties_nulls_and_zeros(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.knn(df.where("vec_id = 0"), df, 2).orderBy("place").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert vectors.knn(df.where("vec_id = 99"), df, 2).count() == 0
    assert vectors.range_search(df.where("vec_id = 0"), df, 0.5).count() == 2


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search_in_blocks_of_both_sides(spark, metric):
    base, asked = vector_plans.base(spark, SF), vector_plans.asked(spark, SF)
    rows = lambda df: sorted((r.query_id, r.place, r.vec_id, round(r.score, 9)) for r in df.collect())
    whole = rows(vectors.knn(asked, base, 3, metric))
    assert len(whole) == 3 * asked.count()
    assert rows(vectors.knn(asked, base, 3, metric, block_bytes=1040)) == whole  # two vectors to a block of queries
    few = base.where("vec_id < 40")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in few.collect()}
    near = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if metric == "cosine" else -np.linalg.norm(a - b)
    best = {q: sorted((-near(x[q], x[v]), v) for v in x if v != q)[:4] for q in x}
    want = sorted((q, p + 1, v, round(-s, 9)) for q in x for p, (s, v) in enumerate(best[q]))
    for block_bytes in (1 << 20, 5 * 520):  # one block, eight by eight
        got = rows(vectors.knn(few, few, 4, metric, block_bytes=block_bytes))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want])
    assert rows(vectors.knn(base, few, 4, metric, block_bytes=40 * 520)) == rows(vectors.knn(base, few, 4, metric))  # the base is broadcast


def test_ties_of_many_copies_go_to_the_least_ids(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).cast("array<float>").alias("embedding"))
    for block_bytes in (1 << 20, 24 * 500):
        got = vectors.knn(df, df, 2, block_bytes=block_bytes).where("query_id in (0, 7, 2998)").orderBy("query_id", "place")
        assert [(r.query_id, r.vec_id) for r in got.collect()] == [(0, 2), (0, 4), (7, 1), (7, 3), (2998, 0), (2998, 2)]


def test_assign_to_more_centroids_than_a_block(spark, monkeypatch):
    base = vector_plans.base(spark, SF)
    means = vectors.centroid_vectors(base)
    rows = lambda df: sorted((r.vec_id, r.list_id, round(r.distance, 9)) for r in df.collect())
    whole = rows(vectors.assign(base, means))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1040)
    assert rows(vectors.assign(base, means)) == whole


def test_mmr_prefers_other_directions(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, score double, embedding array<float>")
    got = vectors.mmr(df, 0.5, 2).orderBy("place").collect()
    assert [r.vec_id for r in got] == [1, 3]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vector.l2_norm("a").alias("n"), vector.cosine("a", "b").alias("c"), vector.l1("a", "b").alias("l"), vector.quantize("a").alias("q")).first()
    assert (r.n, r.c, r.l, r.q) == (5.0, None, 7.0, [127, 127])


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><script>var x = '</p>';</script></head><body><p>One&nbsp;<b>two</b></p><a HREF=\"/x\">y</a></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = df.select(text.html_text("h").alias("t"), text.html_links("h").alias("l")).collect()
    assert got[0].t.endswith("One two y") and "var" not in got[0].t and got[0].l == ["/x"]
    assert got[1].t is None


def test_chunks_cover_the_text(spark):
    whole = "".join(map(str, range(60)))
    df = spark.createDataFrame([(1, whole), (2, ""), (3, None), (4, "ab")], "doc_id long, text string")
    got = documents.chunk(df, 20, 5).orderBy("doc_id", "pos").collect()
    first = [r.chunk for r in got if r.doc_id == 1]
    assert first[0] + "".join(c[5:] for c in first[1:]) == whole
    assert [r.chunk for r in got if r.doc_id == 4] == ["ab"] and {r.doc_id for r in got} == {1, 4}


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([("k", 1, 5), ("k", 2, 1), ("j", 3, 9), (None, 4, 9)], "k string, id long, t long")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 6, "c")], "k string, t long, v string")
    got = {r.id: r.v for r in relational.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: "b", 2: None, 3: None, 4: None}


def test_range_join_equals_comparison(spark):
    points = spark.range(100).select(F.col("id").alias("p"), (F.col("id") * 1.7 - 40).alias("x"))
    ranges = spark.createDataFrame([(1, -50.0, 3.0), (2, 0.0, 0.0), (3, 7.5, 90.25), (4, 500.0, 600.0)], "r long, low double, high double")
    got = {(r.p, r.r) for r in relational.range_join(points, ranges, "x", "low", "high", 10.0).collect()}
    want = {(p, r) for p in range(100) for r, a, b in ((1, -50, 3), (3, 7.5, 90.25)) if a <= p * 1.7 - 40 < b}
    assert got == want


def test_written_tables_are_pruned(spark):
    path = new_path(spark, "t")
    write_table(load_table(spark, SF, "documents"), path, ["lang"])
    plan = spark.read.parquet(path).where("lang = 'de'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = load_table(spark, SF, "orders").where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_sessions_of_a_stream_are_the_batch_sessions_that_closed(spark):
    of = lambda df: {(r.starts, r.user_id, r.n) for r in df.collect()}
    streamed = of(streams.plain(events.run(events.sessions(streams.stream(spark, SF), "2 hours"), "append")))
    batch = of(streams.plain(events.sessions(load_table(spark, SF, "events"), "2 hours")))
    open_from = max(r.ts for r in load_table(spark, SF, "events").select(F.max("ts").alias("ts")).collect()) - timedelta(hours=5)
    assert streamed < batch
    assert all(starts > open_from for starts, _, _ in batch - streamed)


def test_custom_state_keeps_the_users_of_all_batches(spark):
    path = new_path(spark, "many-files")
    rows = load_table(spark, "/root/testdata/sf0.001", "events")
    rows.repartitionByRange(70, "user_id", "event_id").write.parquet(f"{path}/events.parquet")  # more files than a batch takes
    got = {(r.user_id, r.n) for r in streams.custom_state(spark, path).collect()}
    assert got == {(r.user_id, r["count"]) for r in rows.groupBy("user_id").count().collect()}


def test_late_events_are_dropped(spark):
    got = sum(r.n for r in streams.late(spark, SF).collect())
    total = load_table(spark, SF, "events").where("event_id % 10 <> 0").count()
    early = load_table(spark, SF, "events").where("event_id % 10 = 0").count()
    assert 0.9 * total < got < total + early  # those of the days that are still open come in, the rest of the late file doesn't


def test_sketches_are_near_the_exact_figures(spark):
    lines = load_table(spark, SF, "lineitem")
    for r in relational_plans.sketches(spark, SF).collect():
        own = lines.where(F.col("l_returnflag") == r.l_returnflag)
        assert r.theta == pytest.approx(r.n_exact, rel=0.1)
        assert own.where(F.col("l_extendedprice") <= r.kll_median).count() == pytest.approx(own.count() / 2, rel=0.1)
        counts = sorted((n for _, n in own.groupBy("l_linenumber").count().collect()), reverse=True)
        assert [t["count"] for t in r.top_lines] == counts[:3]


def test_medians_equal_percentile(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float(rng.randrange(20)), rng.random()])) for g in (None, "a", "b", "c") for _ in range(rng.randrange(200, 300))]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 5.0), ("same", 5.0), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in relational.medians(df, "g", "v").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("p")).collect()}
    assert len(got) == 9 and got == want
    assert relational.medians(df.limit(0), "g", "v").collect() == []


def test_sketches_stand_apart_from_the_distinct_count(spark):
    """Beside a distinct count in one aggregate, each part of a flag would have sketches of its own, and the exact median its values in one task."""
    plan = relational_plans.sketches(spark, SF)._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.splitlines() if "theta_sketch" in x and "Aggregate" in x]
    assert kept and not [x for x in kept if "l_partkey#" in x.split("functions=")[0]]
    assert " percentile(" not in plan


def test_hybrid_and_recall(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, place int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, place int")
    assert [r.id for r in vectors.hybrid(a, b, 3).collect()] == [2, 1, 3]
    assert np.isclose(vectors.hybrid(a, b, 1).first().score, 1 / 61 + 1 / 62)


@pytest.mark.parametrize("name", ["r5_lateral_join", "r5_lateral_sql"])
def test_lateral_joins_are_decorrelated(spark, name):
    plan = relational_plans.QUERIES[name](spark, SF)._jdf.queryExecution()
    assert "LateralJoin" in plan.analyzed().toString()
    optimized, physical = plan.optimizedPlan().toString(), plan.executedPlan().toString()
    assert "LateralJoin" not in optimized and "outer(" not in optimized and "NestedLoop" not in physical and "CartesianProduct" not in physical
    assert "row_number" in optimized and "WindowGroupLimit" in physical


def test_asof_join_of_one_key_in_many_ranges(spark):
    """One user with nearly all events, ties in time, nulls; against a scan in Python."""
    rng = np.random.default_rng(5)
    users = [None if u == 9 else int(u) for u in np.where(rng.random(4000) < 0.95, 1, rng.integers(2, 10, 4000))]
    left = [(u, int(t) if t < 980 else None, k) for k, (u, t) in enumerate(zip(users, rng.integers(0, 1000, 4000)))]
    right = sorted({(u, int(t)) for u, t in zip(users[:900], rng.integers(300, 1100, 900))}, key=str)
    right = [(u, t, f"v{k}") for k, (u, t) in enumerate(right)]
    a = spark.createDataFrame(left, "u long, t long, k long").repartition(4)
    b = spark.createDataFrame([*right, (1, None, "never")], "u long, s long, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        found = relational.asof_join(a, b, ["u"], "t", "s", ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.k: r.v for r in found.collect()}
    last = lambda u, t: max(((s, v) for w, s, v in right if w == u and t is not None and s <= t), default=(0, None))[1]
    assert got == {k: last(u, t) for u, t, k in left}

    ranges = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles()}).where("u = 1").groupBy("__range").count().collect()
    assert len(ranges) >= 6 and max(r["count"] for r in ranges) < 4000 / 4


def test_mmr_equals_a_greedy_choice_in_numpy(spark):
    near = vectors.knn(vector_plans.asked(spark, SF), vector_plans.base(spark, SF), 20)
    near = near.join(vector_plans.base(spark, SF).select("vec_id", "embedding"), "vec_id")
    got = {(r.query_id, r.place): r.vec_id for r in vectors.mmr(near, 0.6, 5).collect()}
    want, short = {}, {}
    for r in near.collect():
        short.setdefault(r.query_id, []).append((r.vec_id, r.score, np.array(r.embedding) / np.linalg.norm(r.embedding)))
    for query, rows in short.items():
        picked = []
        for place in range(1, 6):
            worth = lambda row: 0.6 * row[1] - 0.4 * max((row[2] @ p[2] for p in picked), default=0)  # noqa: E731, B023
            best = max((r for r in rows if all(r[0] != p[0] for p in picked)), key=worth)
            picked.append(best)
            want[query, place] = best[0]
    assert got == want
