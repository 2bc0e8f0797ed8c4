"""Relational queries over the star schema and events, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.operators import relational as ops
from loomery.sources.tables import load_table as load


def money(c: Column) -> Column:
    return F.round(c, 2)


def filters(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part").where(F.col("p_size").isin(1, 7, 15, 23, 49) & F.col("p_type").isNotNull() & F.col("p_name").like("%a%"))
    band = F.when(F.col("p_retailprice") < 1000, "low").when(F.col("p_retailprice") < 1500, "mid").otherwise("high")
    return part.select("p_partkey", "p_size", band.alias("band"))


def joins(s: SparkSession, d: str) -> DataFrame:
    c, o = load(s, d, "customer"), load(s, d, "orders")
    parts = []
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        big = o.where("o_totalprice > 300000")
        joined = c.where("c_acctbal > 0").join(big, c["c_custkey"] == big["o_custkey"], how)
        parts.append(joined.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("keys")).select(F.lit(how).alias("kind"), "n_rows", "keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crossed(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "region").select("r_regionkey", "r_name")
    return r.crossJoin(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("other"))).where("r_regionkey <= k")


def ranged(s: SparkSession, d: str) -> DataFrame:
    """Events by hour of the month in spells of a day and a half from each even day on."""
    events = load(s, d, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    starts = load(s, d, "events").select((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 172800) * 48).alias("low")).distinct()
    found = ops.range_join(events, starts.withColumn("high", F.col("low") + 36), "h", "low", "high", 48)
    return found.groupBy("low").agg(F.count(F.lit(1)).alias("n"))


def asof(s: SparkSession, d: str) -> DataFrame:
    """The last purchase of the user at or before each click."""
    events = load(s, d, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return ops.asof_join(clicks, bought, ["user_id"], "ts", "ts", ["purchase_id"]).select("user_id", "event_id", "purchase_id")


def lateral(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ops.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


def _placed(found: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return found.select("o_custkey", "o_orderkey", "o_totalprice", place.alias("place"))


def lateral_join(s: SparkSession, d: str) -> DataFrame:
    """The two dearest orders of each customer, by DataFrame.lateralJoin."""
    found = ops.lateral_top(load(s, d, "customer").select("c_custkey"), load(s, d, "orders"), "c_custkey", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return _placed(found)


def lateral_sql(s: SparkSession, d: str) -> DataFrame:
    """The same by a correlated LATERAL subquery."""
    return _placed(s.sql("""
        SELECT o_custkey, o_orderkey, o_totalprice FROM {customer} c,
        LATERAL (SELECT o_custkey, o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""",
        customer=load(s, d, "customer"), orders=load(s, d, "orders")))


def aggregated(s: SparkSession, d: str) -> DataFrame:
    line = load(s, d, "lineitem")
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("l_partkey").alias("n_parts"),
        money(F.sum("l_quantity")).alias("quantity"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n_discounted"),
    )


def grouped(s: SparkSession, d: str) -> DataFrame:
    joined = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    measure = [F.count(F.lit(1)).alias("n"), money(F.sum("c_acctbal")).alias("balance")]
    rolled = joined.rollup("n_regionkey", "c_mktsegment").agg(*measure).withColumn("kind", F.lit("rollup"))
    cubed = joined.cube("n_regionkey", "c_mktsegment").agg(*measure).withColumn("kind", F.lit("cube"))
    sets = joined.groupingSets([[F.col("n_regionkey")], [F.col("c_mktsegment")]], F.col("n_regionkey"), F.col("c_mktsegment")).agg(*measure)
    return rolled.unionByName(cubed).unionByName(sets.withColumn("kind", F.lit("sets")))


def ranked(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    places = {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank(), "ntile": F.ntile(4)}
    shares = {"percent_rank": F.percent_rank(), "cume_dist": F.cume_dist()}
    return load(s, d, "customer").select(
        "c_custkey", *[f.over(w).alias(n) for n, f in places.items()], *[F.round(f.over(w), 6).alias(n) for n, f in shares.items()]
    )


def framed(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    near = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-90, 0)
    rows = load(s, d, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")))
    return rows.select(
        "o_orderkey",
        F.lag("o_orderkey").over(w).alias("before"),
        F.lead("o_orderkey").over(w).alias("after"),
        F.nth_value("o_orderkey", 2).over(w).alias("second"),
        money(F.sum(price).over(w.rowsBetween(-2, 0))).alias("three"),
        money(F.sum(price).over(near)).alias("quarter"),
    )


def sorted_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


def set_ops(s: SparkSession, d: str) -> DataFrame:
    a = load(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = load(s, d, "supplier").select(F.col("s_nationkey").alias("k")).where("k < 12")
    found = {
        "union": a.union(b).distinct(),
        "union_all": a.union(b),
        "intersect": a.intersect(b),
        "intersect_all": a.intersectAll(b),
        "except": a.subtract(b),
        "except_all": a.exceptAll(b),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("total")).select(F.lit(n).alias("op"), "n", "total") for n, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strings(s: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return load(s, d, "part").select(
        "p_partkey",
        F.upper(name).alias("upper"),
        F.levenshtein(name, F.lit("part 1")).alias("distance"),
        F.size(F.split(name, " ")).alias("words"),
        F.regexp_replace(name, "[0-9]+", "#").alias("masked"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
        F.concat_ws("-", "p_brand", "p_type").alias("label"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.reverse("p_brand").alias("reversed"),
        F.instr(name, "a").alias("at_a"),
        F.length(F.trim(name)).alias("chars"),
        F.translate(name, "aeiou", "AEIOU").alias("vowels"),
        F.substring(name, 2, 3).alias("part3"),
    )


def dates(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(s, d, "orders").select(
        "o_orderkey",
        F.trunc(day, "month").cast("string").alias("month"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.add_months(day, 2).cast("string").alias("later"),
        F.year(day).alias("y"),
        F.quarter(day).alias("q"),
        F.dayofyear(day).alias("doy"),
        F.last_day(day).cast("string").alias("last"),
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
    )


def statistics(s: SparkSession, d: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    r6 = lambda c: F.round(c, 4)
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(
        r6(F.corr(x, y)).alias("corr"),
        r6(F.covar_samp(x, "l_discount")).alias("covar"),
        r6(F.stddev_samp(x)).alias("sd"),
        r6(F.var_pop(x)).alias("var"),
        F.median(x).alias("median"),
        F.min(y).alias("least"),
        F.max(y).alias("most"),
        r6(F.avg(F.sqrt(x))).alias("roots"),
        r6(F.sum(F.ln(x))).alias("logs"),
        F.expr("percentile(l_quantity, 0.9)").alias("p90"),
    )


def arrays(s: SparkSession, d: str) -> DataFrame:
    sizes = load(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("a"), F.array_sort(F.collect_set(F.length("p_name"))).alias("b"))
    by = F.map_from_entries(F.transform("a", lambda x: F.struct(x.cast("string"), x * 2)))
    return sizes.select(
        "p_brand",
        F.size("a").alias("n"),
        F.aggregate("a", F.lit(0), lambda t, x: t + x).alias("total"),
        F.size(F.array_intersect("a", "b")).alias("common"),
        F.array_join(F.transform("a", lambda x: x + 1), ",").alias("next"),
        F.size(F.filter("a", lambda x: x % 2 == 0)).alias("even"),
        F.array_join(F.zip_with(F.slice("a", 1, 3), F.slice("a", 2, 3), lambda x, y: F.coalesce(y, x) - x), ",").alias("gaps"),
        F.element_at(by, "7").alias("seven"),
        F.array_position("a", 7).cast("int").alias("place"),
        F.exists("a", lambda x: x > 48).alias("large"),
        F.array_max("a").alias("most"),
    )


def exploded(s: SparkSession, d: str) -> DataFrame:
    sizes = load(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("a"))
    return sizes.select("p_brand", F.posexplode("a").alias("pos", "p_size"))


def json(s: SparkSession, d: str) -> DataFrame:
    events = load(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return events.select("event_id", k.alias("k"), v.alias("v"), F.from_json("props", "k int").getField("k").alias("j"))


def sketches(s: SparkSession, d: str) -> DataFrame:
    """Estimates beside the exact figures."""
    lines = load(s, d, "lineitem")
    estimates = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("n_estimate"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"),
        F.percentile_approx("l_extendedprice", 0.5, 10000).alias("median_estimate"),
        F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))").alias("theta"),
        F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(CAST(l_extendedprice AS DOUBLE)), 0.5D)").alias("kll_median"),
        F.expr("approx_top_k(l_linenumber, 3)").alias("top_lines"),
    )
    # apart, as beside a distinct count every part of a flag would have sketches of its own
    counts = lines.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_exact"))
    medians = ops.medians(lines, "l_returnflag", "l_extendedprice").withColumnRenamed("median", "median_exact")
    found = estimates.alias("e").join(counts.alias("c"), F.col("e.l_returnflag").eqNullSafe(F.col("c.l_returnflag")))
    found = found.join(medians.alias("m"), F.col("e.l_returnflag").eqNullSafe(F.col("m.l_returnflag")))
    return found.select("e.l_returnflag", "n_estimate", "n_exact", "hll", "median_estimate", "median_exact", "theta", "kll_median", "top_lines")


def sql_function(s: SparkSession, d: str) -> DataFrame:
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION loomery_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    rows = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("loomery_net(l_extendedprice, l_discount)")).alias("net"))
    return rows.select("l_orderkey", F.round("net", 4).alias("net"))


def pandas_function(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    rows = load(s, d, "lineitem").select("l_orderkey", net("l_extendedprice", "l_discount").alias("net"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("net"), 4).alias("net"))


def grouped_function(s: SparkSession, d: str) -> DataFrame:
    """The geometric mean of a customer's order prices, a user-defined aggregate over Arrow batches."""
    @F.pandas_udf("double")
    def geometric(price: pd.Series) -> float:
        return float(np.exp(np.log(price).mean()))

    return load(s, d, "orders").groupBy("o_custkey").agg(F.round(geometric("o_totalprice"), 2).alias("mean_price"))


def table_function(s: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="word string, n int")
    class Words:
        def eval(self, text: str):
            words = text.split(" ")
            for w in sorted(set(words)):
                yield w, words.count(w)

    s.udtf.register("loomery_words", Words)
    load(s, d, "part").select("p_partkey", "p_name").createOrReplaceTempView("loomery_parts")
    return s.sql("SELECT p_partkey, word, n FROM loomery_parts, LATERAL loomery_words(p_name)")


def recursive(s: SparkSession, d: str) -> DataFrame:
    load(s, d, "orders").createOrReplaceTempView("loomery_orders")
    return s.sql("""
        WITH RECURSIVE months(m, last) AS (
          SELECT CAST(trunc(min(o_orderdate), 'month') AS DATE), CAST(trunc(max(o_orderdate), 'month') AS DATE) FROM loomery_orders
          UNION ALL SELECT CAST(add_months(m, 1) AS DATE), last FROM months WHERE m < last)
        SELECT CAST(m AS STRING) AS m, count(o_orderkey) AS n FROM months LEFT JOIN loomery_orders ON trunc(o_orderdate, 'month') = m GROUP BY months.m""")


QUERIES = {
    "r1_filter": filters,
    "r2_joins": joins,
    "r3_cross_join": crossed,
    "r3_range_join": ranged,
    "r4_asof_join": asof,
    "r5_lateral_top": lateral,
    "r5_lateral_join": lateral_join,
    "r5_lateral_sql": lateral_sql,
    "r6_aggregate": aggregated,
    "r7_grouping_sets": grouped,
    "r8_ranking": ranked,
    "r9_frames": framed,
    "r10_sort_limit": sorted_rows,
    "r11_set_ops": set_ops,
    "r12_strings": strings,
    "r13_dates": dates,
    "r14_statistics": statistics,
    "r15_arrays": arrays,
    "r15_explode": exploded,
    "r16_json": json,
    "r17_sketches": sketches,
    "r18_sql_function": sql_function,
    "r18_pandas_udf": pandas_function,
    "r19_pandas_udaf": grouped_function,
    "r20_udtf": table_function,
    "r21_recursive": recursive,
}

TOP_ORDERS = """SELECT o_custkey, o_orderkey, o_totalprice,
    (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS place FROM orders QUALIFY place <= 2"""
NET = "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem GROUP BY l_orderkey"
JOIN = "(SELECT * FROM customer WHERE c_acctbal > 0) c {0} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"
SETS = {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}
GROUPED = "count(*) AS n, round(sum(c_acctbal), 2) AS balance, '{0}' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY {1}"

ORACLE_SQL = {
    "r1_filter": """SELECT p_partkey, p_size, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS band
        FROM part WHERE p_size IN (1, 7, 15, 23, 49) AND p_type IS NOT NULL AND p_name LIKE '%a%'""",
    "r2_joins": " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) AS n_rows, sum(c_custkey)::BIGINT AS keys FROM {JOIN.format(j)}"
        for k, j in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI"))
    ),
    "r3_cross_join": "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS k, b.r_name AS other FROM region a, region b WHERE a.r_regionkey <= b.r_regionkey",
    "r3_range_join": """WITH s AS (SELECT DISTINCT (floor(floor(epoch(ts)) / 172800) * 48)::BIGINT AS low FROM events)
        SELECT low, count(*) AS n FROM events, s WHERE floor(epoch(ts)) / 3600 >= low AND floor(epoch(ts)) / 3600 < low + 36 GROUP BY low""",
    "r4_asof_join": """SELECT c.user_id, c.event_id, p.purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') c
        ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
        ON c.user_id = p.user_id AND c.ts >= p.ts""",
    "r5_lateral_top": TOP_ORDERS,
    "r5_lateral_join": TOP_ORDERS,
    "r5_lateral_sql": TOP_ORDERS,
    "r6_aggregate": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, round(sum(l_quantity), 2) AS quantity,
        round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) FILTER (l_discount > 0.05) AS n_discounted
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "r7_grouping_sets": " UNION ALL ".join(
        f"SELECT n_regionkey, c_mktsegment, {GROUPED.format(k, g)}"
        for k, g in (
            ("rollup", "ROLLUP (n_regionkey, c_mktsegment)"),
            ("cube", "CUBE (n_regionkey, c_mktsegment)"),
            ("sets", "GROUPING SETS ((n_regionkey), (c_mktsegment))"),
        )
    ),
    "r8_ranking": """SELECT c_custkey, (row_number() OVER w)::INT AS row_number, (rank() OVER w)::INT AS rank, (dense_rank() OVER w)::INT AS dense_rank,
        (ntile(4) OVER w)::INT AS ntile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)""",
    "r9_frames": """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, nth_value(o_orderkey, 2) OVER w AS second,
        round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1990-01-01', o_orderdate::DATE)
              RANGE BETWEEN 90 PRECEDING AND CURRENT ROW), 2) AS quarter
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "r10_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "r11_set_ops": " UNION ALL ".join(
        f"SELECT '{k}' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT c_nationkey AS k FROM customer {o} SELECT s_nationkey FROM supplier WHERE s_nationkey < 12)"
        for k, o in SETS.items()
    ),
    "r12_strings": """SELECT p_partkey, upper(p_name) AS upper, levenshtein(p_name, 'part 1')::INT AS distance, len(string_split(p_name, ' '))::INT AS words,
        regexp_replace(p_name, '[0-9]+', '#', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, concat_ws('-', p_brand, p_type) AS label,
        lpad(p_size::VARCHAR, 4, '0') AS padded, reverse(p_brand) AS reversed, instr(p_name, 'a')::INT AS at_a, length(trim(p_name))::INT AS chars,
        translate(p_name, 'aeiou', 'AEIOU') AS vowels, substr(p_name, 2, 3) AS part3 FROM part""",
    "r13_dates": """SELECT o_orderkey, date_trunc('month', o_orderdate::DATE)::DATE::VARCHAR AS month, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days,
        (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE::VARCHAR AS later, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS doy,
        last_day(o_orderdate::DATE)::VARCHAR AS last, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""",
    "r14_statistics": """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS corr, round(covar_samp(l_quantity, l_discount), 4) AS covar,
        round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS var, median(l_quantity) AS median, min(l_extendedprice) AS least,
        max(l_extendedprice) AS most, round(avg(sqrt(l_quantity)), 4) AS roots, round(sum(ln(l_quantity)), 4) AS logs, quantile_cont(l_quantity, 0.9) AS p90
        FROM lineitem GROUP BY l_returnflag""",
    "r15_arrays": """SELECT p_brand, len(a)::INT AS n, list_sum(a)::INT AS total, len(list_intersect(a, b))::INT AS common,
        array_to_string(list_transform(a, lambda x: x + 1), ',') AS next, len(list_filter(a, lambda x: x % 2 = 0))::INT AS even,
        array_to_string(list_transform(range(1, least(len(a), 3) + 1), lambda i: coalesce(a[i + 1], a[i]) - a[i]), ',') AS gaps,
        CASE WHEN list_contains(a, 7) THEN 14 END AS seven, coalesce(list_position(a, 7), 0)::INT AS place,
        len(list_filter(a, lambda x: x > 48)) > 0 AS large, list_max(a) AS most
        FROM (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS a, list(DISTINCT length(p_name)) AS b FROM part GROUP BY p_brand)""",
    "r15_explode": """SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1)::INT AS pos, p_size
        FROM (SELECT DISTINCT p_brand, p_size FROM part)""",
    "r16_json": "SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT AS v, (props->>'$.k')::INT AS j FROM events",
    "r18_sql_function": NET,
    "r18_pandas_udf": NET,
    "r19_pandas_udaf": "SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 2) AS mean_price FROM orders GROUP BY o_custkey",
    "r20_udtf": "SELECT p_partkey, word, count(*)::INT AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY p_partkey, word",
    "r21_recursive": """WITH RECURSIVE months(m, last) AS (
          SELECT date_trunc('month', min(o_orderdate))::DATE, date_trunc('month', max(o_orderdate))::DATE FROM orders
          UNION ALL SELECT (m + INTERVAL 1 MONTH)::DATE, last FROM months WHERE m < last)
        SELECT m::VARCHAR AS m, count(o_orderkey) AS n FROM months LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = months.m GROUP BY months.m""",
}
