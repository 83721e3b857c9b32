"""Metric, rule, window, streaming and whole-object queries."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import assembly, clouds, mesh, metrics
from ..sources import files
from ..streaming import streams
from .queries_core import T
from .queries_geometry import _HALVES, _V, _halves, _tree, _vectors
from .registry import query


@query("q_novelty", f"WITH {_HALVES}, d AS (SELECT a.id, min(list_distance(a.v, b.v)) AS d FROM a, b GROUP BY a.id) SELECT round(avg(CASE WHEN d > 1.1 THEN 1.0 ELSE 0.0 END), 6) AS novelty FROM d")
def q_novelty(spark, sf_dir):
    return metrics.nearest(*_halves(spark, sf_dir)).agg(F.round(metrics.rate(F.col("distance") > 1.1), 6).alias("novelty"))


@query("q_kernel_mmd", f"""
WITH {_HALVES} SELECT round((SELECT avg(exp(-(list_distance(p.v, q.v) ** 2) / 2)) FROM a p, a q) + (SELECT avg(exp(-(list_distance(p.v, q.v) ** 2) / 2)) FROM b p, b q) - 2 * (SELECT avg(exp(-(list_distance(p.v, q.v) ** 2) / 2)) FROM a p, b q), 6) AS mmd""")
def q_kernel_mmd(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    parts = [metrics.kernel_mean(x, y).select(F.lit(i).alias("i"), "m") for i, (x, y) in enumerate(((a, a), (b, b), (a, b)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(F.round(F.sum(F.when(F.col("i") < 2, F.col("m")).otherwise(-2 * F.col("m"))), 6).alias("mmd"))


@query("q_knn_outliers", f"""
WITH k AS (SELECT label, id, d FROM (SELECT p.label, p.id, list_distance(p.v, q.v) AS d, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.v, q.v), q.id) AS r FROM {_V} p JOIN {_V} q ON p.label = q.label AND p.id <> q.id) WHERE r <= 8),
m AS (SELECT label, id, avg(d) AS d FROM k GROUP BY label, id), s AS (SELECT label, avg(d) + 2 * stddev_pop(d) AS cut FROM m GROUP BY label)
SELECT label, count(*) AS n, count(*) FILTER (d > cut) AS outliers FROM m JOIN s USING (label) GROUP BY label""")
def q_knn_outliers(spark, sf_dir):
    m = metrics.nearest_mean(_vectors(spark, sf_dir), 8)
    cut = m.groupBy("label").agg((F.avg("d") + 2 * F.stddev_pop("d")).alias("cut"))
    return m.join(cut, "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("d") > F.col("cut")).alias("outliers"))


@query("q_parallel_pairs", """
WITH f AS (SELECT p_size AS g, p_partkey AS id, [(p_partkey % 3 = 0)::INT, (p_partkey % 3 = 1)::INT, (p_partkey % 3 = 2)::INT]::DOUBLE[] AS n FROM part)
SELECT g, CASE WHEN list_dot_product(a.n, b.n) > 0.5 THEN 'parallel' ELSE 'perpendicular' END AS kind, count(*) AS n FROM f a JOIN f b USING (g) WHERE a.id < b.id GROUP BY 1, 2""")
def q_parallel_pairs(spark, sf_dir):
    unit = [(F.col("p_partkey") % 3 == i).cast("double").alias(f"n{x}") for i, x in enumerate("xyz")]
    faces = T(spark, sf_dir, "part").select(F.col("p_size").alias("g"), F.col("p_partkey").alias("id"), *unit)
    return assembly.parallel_pairs(faces, "g").groupBy("g", "kind").agg(F.count("*").alias("n"))


@query("q_nucleus", """
SELECT user_id, event_type, round(p, 6) AS p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type)) WHERE b < 0.59""")
def q_nucleus(spark, sf_dir):
    n = T(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    p = n.select("user_id", "event_type", (F.col("count") / F.sum("count").over(Window.partitionBy("user_id"))).alias("p"))
    return assembly.nucleus(p, ["user_id"], "p", "event_type", 0.59).withColumn("p", F.round("p", 6))


@query("q_spacing", """
SELECT o_custkey, count(*) AS n, CAST(floor(avg(g) / 100) AS BIGINT) AS spacing, coalesce(stddev_pop(g) < 20000, false) AS regular FROM (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS g FROM orders) GROUP BY o_custkey""")
def q_spacing(spark, sf_dir):
    return assembly.spacing(T(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 20000.0).withColumn("spacing", F.floor(F.col("spacing") / 100))


@query("q_rule_violations", """
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN p_size < 5 THEN 'too_small' END, CASE WHEN p_retailprice / p_size > 100 THEN 'too_dear' END, CASE WHEN contains(p_type, 'TIN') THEN 'soft' END]) AS rule FROM part) WHERE rule IS NOT NULL GROUP BY rule""")
def q_rule_violations(spark, sf_dir):
    rules = {"too_small": F.col("p_size") < 5, "too_dear": F.col("p_retailprice") / F.col("p_size") > 100, "soft": F.col("p_type").contains("TIN")}
    return assembly.violations(T(spark, sf_dir, "part"), "p_partkey", rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("q_findings", """
WITH f AS (SELECT o_custkey, CASE WHEN o_totalprice > 400000 THEN 'critical' WHEN o_totalprice > 200000 THEN 'warning' ELSE 'info' END AS s, o_orderpriority AS c FROM orders),
k AS (SELECT o_custkey, c, count(*) FILTER (s = 'critical') AS a, count(*) FILTER (s = 'warning') AS b, count(*) FILTER (s = 'info') AS d FROM f GROUP BY o_custkey, c)
SELECT o_custkey, CASE WHEN sum(a) > 0 THEN 'critical' WHEN sum(b) > 0 THEN 'warning' ELSE 'info' END AS overall, CAST(sum(a + b + d) AS BIGINT) AS total,
CAST(sum(a) AS BIGINT) AS critical, CAST(sum(b) AS BIGINT) AS warning, CAST(sum(d) AS BIGINT) AS info, string_agg(c || ':' || a || '/' || b || '/' || d, ';' ORDER BY c) AS checks FROM k GROUP BY o_custkey""")
def q_findings(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = T(spark, sf_dir, "orders").select("o_custkey", F.when(p > 400000, "critical").when(p > 200000, "warning").otherwise("info").alias("s"), "o_orderpriority")
    entry = F.transform(F.map_entries("checks"), lambda e: F.concat(e["key"], F.lit(":"), F.concat_ws("/", *(e["value"][s].cast("string") for s in assembly.SEVERITIES))))
    return assembly.findings(rows, ["o_custkey"], "s", "o_orderpriority").withColumn("checks", F.array_join(F.array_sort(entry), ";"))


@query("q_reward", """
SELECT l_returnflag, round(avg(r), 6) AS mean_reward FROM (SELECT l_returnflag, round_even(greatest(-1, least(1, l_discount * 5 - l_tax * 2 + CASE WHEN l_quantity > 25 THEN 0.5 ELSE 0 END)), 4) AS r FROM lineitem) GROUP BY l_returnflag""")
def q_reward(spark, sf_dir):
    r = assembly.reward({"gain": F.col("l_discount") * 5, "loss": -F.col("l_tax") * 2, "size": F.when(F.col("l_quantity") > 25, 0.5)})
    return T(spark, sf_dir, "lineitem").select("l_returnflag", r.alias("r")).groupBy("l_returnflag").agg(F.round(F.avg("r"), 6).alias("mean_reward"))


@query("q_route", """
WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations), s AS (SELECT conv_id, turn, (list_contains(w, 'the')::INT * 2 + list_contains(w, 'of')::INT)::DOUBLE AS en, (list_contains(w, 'de')::INT * 2 + list_contains(w, 'la')::INT)::DOUBLE AS ro FROM w)
SELECT conv_id, turn, CASE WHEN en + ro > 0 AND greatest(en, ro) / (en + ro) >= 0.6 THEN CASE WHEN en >= ro THEN 'en' ELSE 'romance' END ELSE 'none' END AS route FROM s""")
def q_route(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.split(F.lower("text"), " ").alias("w"))
    out = assembly.routed(rows, "k", F.col("w"), {"en": {"the": 2.0, "of": 1.0}, "romance": {"de": 2.0, "la": 1.0}}, 0.6, "none")
    return out.select("k.conv_id", "k.turn", "route")


@query("q_annotation_groups", """
SELECT t, v, count(*) AS n, min(p_partkey) AS head FROM (SELECT p_partkey, p_type AS t, translate(lower(trim(p_brand)), ' -_', '') AS v FROM part) GROUP BY t, v""")
def q_annotation_groups(spark, sf_dir):
    return T(spark, sf_dir, "part").groupBy(F.col("p_type").alias("t"), tx.normal_value("p_brand").alias("v")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("head"))


@query("q_edge_manifold", """
WITH f AS (SELECT p_brand AS m, p_partkey % 40 AS v0, p_partkey % 40 + 1 + p_size % 3 AS v1, p_partkey % 40 + 5 + p_size % 2 AS v2 FROM part), e AS (SELECT m, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT m, v0 AS a, v1 AS b FROM f UNION ALL SELECT m, v1, v2 FROM f UNION ALL SELECT m, v2, v0 FROM f)),
c AS (SELECT m, a, b, count(*) AS n FROM e GROUP BY m, a, b) SELECT m AS mesh, bool_and(n <= 2) AS manifold, count(*) FILTER (n = 1) AS boundary_edges, count(*) FILTER (n > 2) AS non_manifold_edges FROM c GROUP BY m""")
def q_edge_manifold(spark, sf_dir):
    k = F.col("p_partkey") % 40
    facets = T(spark, sf_dir, "part").select(F.col("p_brand").alias("mesh"), F.col("p_partkey").alias("facet"), k.alias("v0"), (k + 1 + F.col("p_size") % 3).alias("v1"), (k + 5 + F.col("p_size") % 2).alias("v2"))
    return mesh.manifold(facets).select("mesh", "manifold", "boundary_edges", "non_manifold_edges")


@query("q_ngram_bans", r"""
WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] = w[len(w) - 1] AND w[i + 1] = w[len(w)]), lambda i: w[i + 2]))), ' ') AS banned FROM t WHERE len(w) >= 3""")
def q_ngram_bans(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w")).where("size(w) >= 3")
    return rows.select("conv_id", "turn", F.array_join(tx.banned_next("w", 3), " ").alias("banned"))


@query("q_published_delta", """
WITH m AS (SELECT 'validity' AS metric, 100 * avg(quality) AS value FROM labels UNION ALL SELECT 'toxicity', 100 * avg(toxic) FROM labels), p AS (SELECT * FROM (VALUES ('validity', 46.1), ('toxicity', 12.0)) t(metric, published))
SELECT metric, round(value - published, 6) AS delta, CASE WHEN metric = 'toxicity' THEN value < published ELSE value > published END AS better FROM m JOIN p USING (metric)""")
def q_published_delta(spark, sf_dir):
    l = T(spark, sf_dir, "labels")  # noqa: E741
    m = l.agg((100 * F.avg("quality")).alias("value")).select(F.lit("validity").alias("metric"), "value").unionByName(l.agg((100 * F.avg("toxic")).alias("value")).select(F.lit("toxicity").alias("metric"), "value"))
    out = assembly.compared(m, spark.createDataFrame([("validity", 46.1), ("toxicity", 12.0)], "metric string, published double"), ("toxicity",))
    return out.select("metric", F.round("delta", 6).alias("delta"), "better")


@query("q_critique", """
WITH r AS (SELECT lang, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 5 + 1 END AS a, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 7 % 5 + 1 END AS b FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (coalesce((a + b) / 2.0 >= 3, true)) AS passed, round(avg((a + b) / 2.0), 6) AS mean_rating FROM r GROUP BY lang""")
def q_critique(spark, sf_dir):
    n = F.col("n_chars")
    value = lambda x: F.when(n % 3 != 0, x.cast("double"))
    rows = T(spark, sf_dir, "documents").select("lang", F.create_map(F.lit("clear"), value(n % 5 + 1), F.lit("right"), value(n % 7 % 5 + 1)).alias("ratings"))
    return assembly.critique_summary(rows, ["lang"], "ratings", 3.0).withColumn("mean_rating", F.round("mean_rating", 6))


# -------------------------------------------------------------------------------------- streaming


@query("q_stream_filter_batch", """
SELECT event_type, batch, count(*) AS n, min(event_id) AS first FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32 AS batch FROM events WHERE value > 10) GROUP BY event_type, batch""")
def q_stream_filter_batch(spark, sf_dir):
    rows = streams.count_batches(T(spark, sf_dir, "events").where("value > 10").select("event_type", "event_id"), ["event_id"], 32, ["event_type"])
    return rows.groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("b_stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def b_stream_tumbling(spark, sf_dir):
    """A stream over the events, drained into a table in the shared folder."""
    schema = T(spark, sf_dir, "events").schema
    base = os.path.join(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "checkpoints"), f"tumbling-{uuid.uuid4().hex}")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = streams.tumbling(source, "ts", "event_type", "value", "1 day")
    streams.drain(out, "complete", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/log")
    return spark.read.parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("b_sessionize", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def b_sessionize(spark, sf_dir):
    return streams.sessions(T(spark, sf_dir, "events").select("ts", "user_id"), "ts", "user_id", "6 hours")


# ---------------------------------------------------------------------------------- whole objects


@query("q_serialize")
def q_serialize(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")
    out = files.serialize_chunks(rows, "markdown").withColumnRenamed("output", "markdown")
    return out.join(files.serialize_chunks(rows, "html").withColumnRenamed("output", "html"), "doc_id")


@query("q_dfs_order")
def q_dfs_order(spark, sf_dir):
    """The whole tree, each region's vertices a graph of their own; an order of an unknown customer hangs on that one."""
    nation = T(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("key"))
    customer = T(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("node"), (F.col("c_nationkey") + 100).cast("long").alias("src"))
    roots = nation.select(F.col("key").alias("src"), "key").distinct().unionByName(nation).unionByName(customer.join(F.broadcast(nation), "src").select(F.col("node").alias("src"), "key"))
    edges = _tree(spark, sf_dir).join(roots, "src", "left")
    return assembly.dfs_order(edges.select(F.coalesce("key", "src").alias("key"), "src", "dst"), "key")


def _clouds(spark, sf_dir):
    return T(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("cloud"), F.col("p_partkey").alias("point"), (F.col("p_partkey") % 17).cast("double").alias("x"), (F.col("p_partkey") % 13).cast("double").alias("y"), (F.col("p_retailprice") / 100).alias("z"))


@query("q_fps")
def q_fps(spark, sf_dir):
    return clouds.farthest_points(_clouds(spark, sf_dir), 8)


@query("q_normals")
def q_normals(spark, sf_dir):
    return clouds.normals(_clouds(spark, sf_dir), 8)


@query("q_planes")
def q_planes(spark, sf_dir):
    return clouds.planes(_clouds(spark, sf_dir), 0.5)


@query("q_icp")
def q_icp(spark, sf_dir):
    a = _clouds(spark, sf_dir).withColumnRenamed("cloud", "pair")
    return clouds.register(a.withColumn("side", F.lit("a")).unionByName(a.withColumn("side", F.lit("b")).withColumn("x", F.col("x") + 0.01)))


@query("q_unit_sphere", """
WITH p AS (SELECT p_size AS cloud, p_partkey % 17 AS x, p_partkey % 13 AS y, p_retailprice / 100 AS z FROM part), c AS (SELECT cloud, avg(x) AS a, avg(y) AS b, avg(z) AS c FROM p GROUP BY cloud),
m AS (SELECT cloud, sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2) AS d FROM p JOIN c USING (cloud)) SELECT cloud::BIGINT AS cloud, round(avg(CASE WHEN r > 0 THEN d / r ELSE d END), 6) AS mean_radius FROM m JOIN (SELECT cloud, max(d) AS r FROM m GROUP BY cloud) USING (cloud) GROUP BY cloud""")
def q_unit_sphere(spark, sf_dir):
    rows = clouds.normalised(_clouds(spark, sf_dir))
    return rows.groupBy("cloud").agg(F.round(F.avg(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)), 6).alias("mean_radius"))
