"""Vector, graph, spatial and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import graph, metrics, spatial
from .queries_core import T
from .registry import query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


_V = "(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("q_cosine_topk", f"""
SELECT qid, id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS r FROM (
  SELECT q.id AS qid, e.id, list_cosine_similarity(q.v, e.v) AS s FROM {_V} q JOIN {_V} e ON q.id % 100 = 0 AND e.id <> q.id)) WHERE r <= 5""")
def q_cosine_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    blocks = 32  # every row is a query's candidate once; the stated queries go to each block of rows
    q = rows.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    pairs = q.join(rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")), "b").where("qid <> id")
    pairs = pairs.select("qid", "id", vec.cosine("q", "v").alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("s", 9)), "id")
    out = pairs.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
    return out.select("qid", "id", F.round("s", 6).alias("score"), "rank")


@query("q_mean_embedding", f"""
WITH m AS (SELECT label, i, avg(v[i]) AS x FROM {_V}, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(x / n, 6) AS value FROM m JOIN n USING (label)""")
def q_mean_embedding(spark, sf_dir):
    means = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return means.select("label", "dim", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), 6).alias("value"))


@query("q_minmax_quantize", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT q, count(*) AS n FROM (SELECT CAST(round_even(least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1) * 255, 0) AS BIGINT) AS q FROM lineitem, r) GROUP BY q""")
def q_minmax_quantize(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select("l_extendedprice")
    ends = rows.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return rows.join(F.broadcast(ends)).groupBy(vec.quantize("l_extendedprice", "lo", "hi", 256).alias("q")).agg(F.count("*").alias("n"))


@query("q_unit_cube", """
WITH r AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) d, min(l_tax) e, max(l_tax) f FROM lineitem),
s AS (SELECT *, greatest(b - a, d - c, f - e) AS w FROM r)
SELECT round(max((l_quantity - a) / w), 6) AS x_max, round(avg((l_quantity - a) / w), 6) AS x_avg, round(avg((l_discount - c) / w), 6) AS y_avg, round(avg((l_tax - e) / w), 6) AS z_avg FROM lineitem, s""")
def q_unit_cube(spark, sf_dir):
    axes = ["l_quantity", "l_discount", "l_tax"]
    rows = T(spark, sf_dir, "lineitem").select(*axes)
    ends = rows.agg(*(F.min(a).alias(f"lo_{a}") for a in axes), *(F.max(a).alias(f"hi_{a}") for a in axes))
    width = F.greatest(*(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in axes))
    u = rows.join(F.broadcast(ends)).select(*(((F.col(a) - F.col(f"lo_{a}")) / width).alias(n) for a, n in zip(axes, "xyz")))
    return u.agg(F.round(F.max("x"), 6).alias("x_max"), *(F.round(F.avg(n), 6).alias(f"{n}_avg") for n in "xyz"))


@query("q_bit_alloc", """
WITH r AS (SELECT quantile_cont(p_retailprice, 0.1) AS lo, quantile_cont(p_retailprice, 0.9) AS hi FROM part)
SELECT bits, count(*) AS n FROM (SELECT CAST(round_even(6 + least(greatest((p_retailprice - lo) / (hi - lo), 0), 1) * 8, 0) AS INTEGER) AS bits FROM part, r) GROUP BY bits""")
def q_bit_alloc(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select("p_retailprice")
    ends = rows.agg(F.percentile("p_retailprice", 0.1).alias("lo"), F.percentile("p_retailprice", 0.9).alias("hi"))
    return rows.join(F.broadcast(ends)).groupBy(vec.bits_of("p_retailprice", "lo", "hi", 6, 14).alias("bits")).agg(F.count("*").alias("n"))


@query("q_standardize", f"""
WITH s AS (SELECT i, avg(v[i]) AS m, CASE WHEN stddev_pop(v[i]) < 1e-6 THEN 1.0 ELSE stddev_pop(v[i]) END AS d FROM {_V}, range(1, 65) t(i) GROUP BY i)
SELECT CAST(i - 1 AS INTEGER) AS dim, round(max((v[i] - m) / d), 5) AS top, round(min((v[i] - m) / d), 5) AS low FROM {_V}, s GROUP BY i""")
def q_standardize(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.posexplode("v").alias("dim", "x"))
    s = rows.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    d = F.when(F.col("d") < 1e-6, 1.0).otherwise(F.col("d"))
    return s.select("dim", F.round((F.col("hi") - F.col("m")) / d, 5).alias("top"), F.round((F.col("lo") - F.col("m")) / d, 5).alias("low"))


@query("q_edge_pack", "SELECT o_orderkey, (o_custkey << 16) | (o_orderkey % 65536) AS packed FROM orders")
def q_edge_pack(spark, sf_dir):
    return T(spark, sf_dir, "orders").select("o_orderkey", vec.pack_edge("o_custkey", F.col("o_orderkey") % 65536).alias("packed"))


@query("q_log_embedding", """
SELECT p_partkey, round(ln(1 + p_size) / sqrt(ln(1 + p_size) ** 2 + ln(1 + p_retailprice) ** 2 + ln(1 + abs(p_size - 25)) ** 2), 6) AS first FROM part""")
def q_log_embedding(spark, sf_dir):
    values = F.array(F.col("p_size").cast("double"), "p_retailprice", (F.col("p_size") - 25).cast("double"))
    return T(spark, sf_dir, "part").select("p_partkey", F.round(vec.log_embedding(values)[0], 6).alias("first"))


# ------------------------------------------------------------------------------------------ graph


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order, as one id space."""
    t = lambda n: T(spark, sf_dir, n)
    a = t("nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    b = t("customer").select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    c = t("orders").select((F.col("o_custkey") + 1000).alias("src"), (F.col("o_orderkey") + 100000000).alias("dst"))
    return a.unionByName(b).unionByName(c)


_E = """(SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 100 AS dst FROM nation UNION ALL SELECT c_nationkey::BIGINT + 100, c_custkey + 1000 FROM customer
UNION ALL SELECT o_custkey + 1000, o_orderkey + 100000000 FROM orders)"""


@query("q_degree_stats", """
WITH e AS (SELECT DISTINCT o_custkey AS src, l_partkey + 100000000 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)
SELECT count(*) AS nodes, round(avg(i), 6) AS avg_in, CAST(max(i) AS BIGINT) AS max_in, CAST(max(o) AS BIGINT) AS max_out, count(*) FILTER (i = 0) AS roots, count(*) FILTER (o = 0) AS leaves FROM d""")
def q_degree_stats(spark, sf_dir):
    e = T(spark, sf_dir, "orders").join(T(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 100000000).alias("dst")).distinct()
    d = graph.degrees(e)
    return d.agg(F.count("*").alias("nodes"), F.round(F.avg("in_degree"), 6).alias("avg_in"), F.max("in_degree").cast("long").alias("max_in"), F.max("out_degree").cast("long").alias("max_out"), F.count_if(F.col("in_degree") == 0).alias("roots"), F.count_if(F.col("out_degree") == 0).alias("leaves"))


@query("q_components", """
SELECT component, count(*) AS n FROM (SELECT n_regionkey::BIGINT AS component FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT n_regionkey::BIGINT FROM nation
UNION ALL SELECT n_regionkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY component""")
def q_components(spark, sf_dir):
    return graph.connected_components(_tree(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"))


@query("q_khop", f"""
WITH RECURSIVE e AS {_E}, r AS (SELECT 0::BIGINT AS node, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def q_khop(spark, sf_dir):
    return graph.k_hop(_tree(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 2)


@query("q_closure", f"""
WITH RECURSIVE e AS {_E}, r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst) SELECT depth, count(*) AS pairs FROM r GROUP BY depth""")
def q_closure(spark, sf_dir):
    return graph.reachable(_tree(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("pairs"))


@query("q_shortest_path", f"""
WITH RECURSIVE e AS {_E}, r AS (SELECT src AS node, 0 AS hops, src::VARCHAR AS path FROM (SELECT DISTINCT n_regionkey::BIGINT AS src FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT e.dst, r.hops + 1, r.path || '>' || e.dst::VARCHAR FROM r JOIN e ON e.src = r.node) SELECT node, hops, path FROM r""")
def q_shortest_path(spark, sf_dir):
    out = graph.shortest_paths(_tree(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")))
    return out.select("node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("q_levels_compat", f"""
WITH e AS {_E} SELECT level, count(*) AS n FROM (SELECT node, CASE WHEN node IN (SELECT dst FROM e) THEN -1 ELSE 0 END AS level FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)) GROUP BY level""")
def q_levels_compat(spark, sf_dir):
    return graph.levels(_tree(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query("q_bom", f"""
WITH RECURSIVE e AS {_E}, r AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst)
SELECT src AS node, count(*) AS descendants, max(depth) AS depth FROM r GROUP BY src""")
def q_bom(spark, sf_dir):
    return graph.roll_up(_tree(spark, sf_dir))


# ---------------------------------------------------------------------------------------- spatial


@query("q_voxel", """
SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS l_quantity_voxel, CAST(floor(l_tax / 0.025) AS BIGINT) AS l_tax_voxel, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax / 0.025), 6) AS tax, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q_voxel(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("q"), (F.col("l_tax") / 0.025).alias("t"), "l_quantity")
    out = spatial.voxel_mean(rows, ["q", "t"], 1.0, ["l_quantity"])
    return out.select(F.col("q_voxel").alias("l_quantity_voxel"), F.col("t_voxel").alias("l_tax_voxel"), F.round("l_quantity", 6).alias("l_quantity"), F.round("t", 6).alias("tax"), "n")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part")
    x, y = F.col("p_partkey") % 977, F.col("p_retailprice")
    return p.select("p_partkey", x.cast("double").alias("x_min"), (x + F.col("p_size") / 8).alias("x_max"), y.alias("y_min"), (y + F.col("p_size") / 10).alias("y_max"))


_B = "(SELECT p_partkey AS id, (p_partkey % 977)::DOUBLE AS x1, p_partkey % 977 + p_size / 8 AS x2, p_retailprice AS y1, p_retailprice + p_size / 10 AS y2 FROM part)"


@query("q_range_overlap", f"""
SELECT a.id AS a_id, b.id AS b_id, round((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)), 4) AS overlap
FROM {_B} a JOIN {_B} b ON a.id < b.id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""")
def q_range_overlap(spark, sf_dir):
    return spatial.overlaps(_boxes(spark, sf_dir), "p_partkey", ["x", "y"], 8.0).select("a_id", "b_id", F.round("overlap", 4).alias("overlap"))


@query("q_containment", f"""SELECT a.id AS "outer", b.id AS "inner" FROM {_B} a JOIN {_B} b ON a.id <> b.id AND a.x1 <= b.x1 AND b.x2 <= a.x2 AND a.y1 <= b.y1 AND b.y2 <= a.y2""")
def q_containment(spark, sf_dir):
    return spatial.contains(_boxes(spark, sf_dir), "p_partkey", ["x", "y"], 8.0)


@query("q_clearance", f"""
SELECT a_id, b_id, round(d, 4) AS distance FROM (SELECT a.id AS a_id, b.id AS b_id, sqrt(greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), 0) ** 2 + greatest(greatest(a.y1, b.y1) - least(a.y2, b.y2), 0) ** 2) AS d
FROM {_B} a JOIN {_B} b ON a.id < b.id AND a.x1 <= b.x2 + 1.01 AND b.x1 <= a.x2 + 1.01) WHERE d <= 1.0""")
def q_clearance(spark, sf_dir):
    out = spatial.clearances(_boxes(spark, sf_dir), "p_partkey", ["x", "y"], 8.0, 1.0)
    return out.select("a_id", "b_id", F.round("distance", 4).alias("distance"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 211).cast("double").alias("x"), (F.col("c_acctbal") / 50).alias("y"))


_P = "(SELECT c_custkey AS id, (c_custkey % 211)::DOUBLE AS x, c_acctbal / 50 AS y FROM customer)"


@query("q_proximity_pairs", f"""
SELECT a_id, b_id, round(d, 4) AS distance FROM (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM {_P} a JOIN {_P} b ON a.id < b.id AND abs(a.x - b.x) <= 1.5) WHERE d <= 1.5""")
def q_proximity_pairs(spark, sf_dir):
    return spatial.point_pairs(_points(spark, sf_dir), "id", ["x", "y"], 1.5).withColumn("distance", F.round("distance", 4))


@query("q_ball_group", f"""
WITH n AS (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM {_P} a JOIN {_P} b ON abs(a.x - b.x) <= 2.5 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.5),
l AS (SELECT a_id, list(b_id ORDER BY b_id) AS near FROM n WHERE r <= 4 GROUP BY a_id) SELECT a_id, array_to_string(list_resize(near, 4, near[1]), ',') AS near FROM l""")
def q_ball_group(spark, sf_dir):
    out = spatial.ball_neighbours(_points(spark, sf_dir), "id", ["x", "y"], 2.5, 4)
    return out.select("a_id", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


@query("q_dbscan", f"""
WITH RECURSIVE p AS {_P}, n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 3 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3), c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4),
e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), l AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a)
SELECT cluster, count(*) AS n FROM (SELECT p.id, coalesce(l.cluster, (SELECT min(m.cluster) FROM n JOIN l m ON m.id = n.b WHERE n.a = p.id), -1) AS cluster FROM p LEFT JOIN l ON l.id = p.id) GROUP BY cluster""")
def q_dbscan(spark, sf_dir):
    return spatial.density_clusters(_points(spark, sf_dir), "id", ["x", "y"], 3.0, 4).groupBy("cluster").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------- metrics


@query("q_validity", "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS validity, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS clean FROM labels")
def q_validity(spark, sf_dir):
    return T(spark, sf_dir, "labels").agg(F.round(metrics.rate(F.col("quality") == 1), 6).alias("validity"), F.round(metrics.rate(F.col("toxic") == 0), 6).alias("clean"))


_HALVES = f"a AS (SELECT * FROM {_V} WHERE label < 3), b AS (SELECT * FROM {_V} WHERE label = 5)"


def _halves(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.where("label < 3").select("id", "v"), rows.where("label = 5").select("id", "v")


@query("q_coverage", f"WITH {_HALVES}, d AS (SELECT a.id, min(list_distance(a.v, b.v)) AS d FROM a, b GROUP BY a.id) SELECT round(avg(CASE WHEN d <= 1.2 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(d), 5) AS mmd FROM d")
def q_coverage(spark, sf_dir):
    return metrics.coverage(*_halves(spark, sf_dir), 1.2).select(F.round("coverage", 6).alias("coverage"), F.round("mmd", 5).alias("mmd"))


@query("q_chamfer", f"WITH {_HALVES}, d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM a, b) SELECT round((SELECT avg(m) FROM (SELECT min(d) AS m FROM d GROUP BY i)) + (SELECT avg(m) FROM (SELECT min(d) AS m FROM d GROUP BY j)), 5) AS chamfer")
def q_chamfer(spark, sf_dir):
    return metrics.chamfer(*_halves(spark, sf_dir)).select(F.round("chamfer", 5).alias("chamfer"))


@query("q_jsd", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / (hi - lo) * 20), 19) AS bin, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS q FROM events, r WHERE value IS NOT NULL GROUP BY 1),
s AS (SELECT p / (SELECT sum(p) FROM c) AS p, q / (SELECT sum(q) FROM c) AS q FROM c)
SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS jsd FROM s""")
def q_jsd(spark, sf_dir):
    counts = metrics.histogram(T(spark, sf_dir, "events").where("value is not null").select("event_type", "value"), ["event_type"], "value", 20)
    return metrics.js_divergence(counts, "event_type", "view", "click").select(F.round("jsd", 6).alias("jsd"))


@query("q_histogram", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1""")
def q_histogram(spark, sf_dir):
    return metrics.histogram(T(spark, sf_dir, "lineitem").select("l_extendedprice"), [], "l_extendedprice", 50)


@query("q_iou", """
WITH t AS (SELECT quality AS a, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS b FROM labels) SELECT class, round(hit / (t + p - hit), 6) AS iou FROM (
SELECT c AS class, (SELECT count(*) FROM t WHERE a = c AND b = c) AS hit, (SELECT count(*) FROM t WHERE a = c) AS t, (SELECT count(*) FROM t WHERE b = c) AS p FROM (SELECT DISTINCT a AS c FROM t UNION SELECT DISTINCT b FROM t))""")
def q_iou(spark, sf_dir):
    rows = T(spark, sf_dir, "labels").select("quality", F.when(F.col("toxic") == 1, 0).otherwise(1).alias("guess"))
    return metrics.iou_by_class(rows, "quality", "guess").withColumn("iou", F.round("iou", 6))


@query("q_distinct_rounded", "SELECT count(*) AS n FROM (SELECT DISTINCT round_even(l_quantity, 0), round_even(l_extendedprice / 1000, 0) FROM lineitem)")
def q_distinct_rounded(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select(F.bround("l_quantity").alias("a"), F.bround(F.col("l_extendedprice") / 1000).alias("b"))
    return rows.distinct().agg(F.count("*").alias("n"))


@query("q_power_law", "SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 5) AS exponent, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) AS factor FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def q_power_law(spark, sf_dir):
    return metrics.power_law(T(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("exponent", 5).alias("exponent"), F.round("factor", 3).alias("factor"))
