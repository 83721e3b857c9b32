"""Queries over filters, lookups, exchange-structure text and small distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assembly, selection, topology
from .queries_core import T
from .registry import query

#: A statement of exchange-structure text for each part: every fifth refers to the parts after it.
_STEP_SQL = """(SELECT p_partkey, '#' || p_partkey || ' = ' || CASE WHEN p_partkey % 5 = 0 THEN 'CLOSED_SHELL' WHEN p_partkey % 5 = 1 THEN 'Advanced_Face' ELSE 'VERTEX_POINT' END
 || '(''' || p_name || ''',(#' || (p_partkey + 1) || ',#' || (p_partkey + 2) || '),' || p_size || '.5E-1,.T.,$);' AS line FROM part)"""
_PATTERN = tx.STEP_TOKEN.replace("'", "''")


def _step(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "CLOSED_SHELL").when(k % 5 == 1, "Advanced_Face").otherwise("VERTEX_POINT")
    return T(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), k, F.lit(" = "), kind, F.lit("('"), F.col("p_name"), F.lit("',(#"), k + 1, F.lit(",#"), k + 2, F.lit("),"), F.col("p_size"), F.lit(".5E-1,.T.,$);")).alias("line"))


def _entities(spark, sf_dir):
    rows = _step(spark, sf_dir).select(F.lit("f").alias("file"), tx.parse_entity("line").alias("e"))
    return rows.select("file", "e.*")


@query("q_step_tokens", f"SELECT p_partkey, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT p_partkey, regexp_extract_all(line, '{_PATTERN}') AS t FROM {_STEP_SQL})")
def q_step_tokens(spark, sf_dir):
    rows = _step(spark, sf_dir).select("p_partkey", tx.step_tokens("line").alias("t"))
    return rows.select("p_partkey", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("q_step_entities", rf"""
SELECT p_partkey AS id, upper(regexp_extract(line, '= ([A-Za-z_]+)', 1)) AS type, array_to_string(regexp_extract_all(line, '\((.*)\);', 1), '') AS params, array_to_string(regexp_extract_all(regexp_replace(line, '^#', ''), '#(\d+)', 1), ',') AS refs FROM {_STEP_SQL}""")
def q_step_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select("id", "type", "params", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query("q_step_references", "SELECT p.p_partkey AS src, q.p_partkey AS dst FROM part p JOIN part q ON q.p_partkey IN (p.p_partkey + 1, p.p_partkey + 2)")
def q_step_references(spark, sf_dir):
    return topology.references(_entities(spark, sf_dir)).select("src", "dst")


@query("q_step_hierarchy", """
SELECT string_agg(CASE WHEN p_partkey % 5 = 0 THEN p_partkey END, ',' ORDER BY p_partkey) AS shells, string_agg(CASE WHEN p_partkey % 5 = 1 THEN p_partkey END, ',' ORDER BY p_partkey) AS faces FROM part""")
def q_step_hierarchy(spark, sf_dir):
    out = selection.hierarchy(_entities(spark, sf_dir), ["file"], {"shells": ["CLOSED_SHELL"], "faces": ["ADVANCED_FACE"]})
    return out.select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("shells", "faces")))


@query("q_step_importance", """
WITH r AS (SELECT p.p_partkey AS src, q.p_partkey AS dst FROM part p JOIN part q ON q.p_partkey IN (p.p_partkey + 1, p.p_partkey + 2)),
i AS (SELECT dst AS id, count(*) AS n FROM r GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM r GROUP BY src)
SELECT p_partkey AS id, round(0.5 * CASE WHEN p_partkey % 5 = 0 THEN 0.9 WHEN p_partkey % 5 = 1 THEN 0.7 ELSE 0.3 END
 + 0.3 * (0.6 * coalesce(i.n, 0) / (SELECT max(n) FROM i) + 0.4 * coalesce(o.n, 0) / (SELECT max(n) FROM o)) + 0.2 * p_size / (SELECT max(p_size) FROM part), 6) AS importance
FROM part LEFT JOIN i ON i.id = p_partkey LEFT JOIN o ON o.id = p_partkey""")
def q_step_importance(spark, sf_dir):
    levels = T(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("id"), F.col("p_size").alias("level"))
    return topology.importance(_entities(spark, sf_dir), levels=levels).select("id", F.round("importance", 6).alias("importance"))


@query("q_hashed_embedding", r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:64] AS w FROM benchmark),
v AS (SELECT item_id, list_transform(w, lambda x: CAST(('0x' || substr(md5(x), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 - 0.5) AS v FROM w)
SELECT item_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS total FROM v""")
def q_hashed_embedding(spark, sf_dir):
    rows = T(spark, sf_dir, "benchmark").select("item_id", tx.hashed_embedding("text").alias("v"))
    return rows.select("item_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("q_stable_hash")
def q_stable_hash(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", tx.stable_hash("p_name", 1 << 20).alias("token"))


@query("q_code_copies", """
WITH t AS (SELECT p_partkey, p_brand AS name, substr(md5(p_brand || '(' || p_type || ', ' || p_size || ')'), 1, 8) AS sig, substr(md5(p_name), 1, 8) AS body FROM part)
SELECT p_partkey, sig, body FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.name = t.name AND u.p_partkey < t.p_partkey AND (u.sig = t.sig OR u.body = t.body))""")
def q_code_copies(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), tx.code_hashes("p_brand", F.array("p_type", F.col("p_size").cast("string")), "p_name").alias("h"))
    rows = rows.select("p_partkey", "name", F.col("h.sig_hash").alias("sig"), F.col("h.body_hash").alias("body"))
    return selection.removed_copies(rows, "p_partkey", "name", "sig", "body").select("p_partkey", "sig", "body")


@query("q_rich_enough", r"""
SELECT doc_id, n FROM (SELECT doc_id, lang, source, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents) WHERE n >= 50 AND (lang IN ('en', 'de') OR source IN ('en', 'de'))""")
def q_rich_enough(spark, sf_dir):
    rows = T(spark, sf_dir, "documents").select("doc_id", tx.token_count("text").cast("long").alias("n"), F.array("lang", "source").alias("kinds"))
    return selection.rich_enough(rows, "n", 50, "kinds", ["en", "de"]).select("doc_id", "n")


@query("q_by_kind", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value >= 50")
def q_by_kind(spark, sf_dir):
    return selection.by_kind(T(spark, sf_dir, "events"), "event_type", "purchase", "value", 50).select("event_id", "value")


@query("q_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 10")
def q_lookup(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 10).alias("k"))
    return selection.looked_up(rows, T(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k").drop("k")


@query("q_capable", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q_capable(spark, sf_dir):
    regions = T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.col("n_regionkey").cast("string")).alias("capabilities"))
    models = T(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "provider").join(regions, "c_nationkey")
    return selection.capable(models, "BUILDING", "1").select("c_custkey")


@query("q_bounds", "SELECT l_returnflag, count(*) FILTER (v > 0) AS outside, round(max(v), 6) AS worst FROM (SELECT l_returnflag, greatest(0.0, 2 - l_quantity, l_quantity - 40, 2 - l_discount * 400, l_discount * 400 - 40) AS v FROM lineitem) GROUP BY l_returnflag")
def q_bounds(spark, sf_dir):
    v = selection.bounds_violation([F.col("l_quantity"), F.col("l_discount") * 400], 2, 40)
    return T(spark, sf_dir, "lineitem").select("l_returnflag", v.alias("v")).groupBy("l_returnflag").agg(F.count_if(F.col("v") > 0).alias("outside"), F.round(F.max("v"), 6).alias("worst"))


@query("q_faces_inside", """
WITH v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_size BETWEEN 5 AND 45 AND p_retailprice BETWEEN 900 AND 1500)
SELECT a.n AS a, b.n AS b, c.n AS c FROM part p JOIN v a ON a.id = p.p_partkey JOIN v b ON b.id = p.p_partkey + 1 JOIN v c ON c.id = p.p_partkey + 2""")
def q_faces_inside(spark, sf_dir):
    part = T(spark, sf_dir, "part").withColumn("file", F.lit("f"))
    inside = part.where(selection.in_box([F.col("p_size"), F.col("p_retailprice")], [5, 900], [45, 1500])).select("file", F.col("p_partkey").alias("id"))
    k = F.col("p_partkey")
    faces = part.select("file", k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c"))
    return selection.faces_inside(faces, inside, ["file"])[0].select(*(F.col(v).cast("long").alias(v) for v in "abc"))


@query("q_box_summary", """
SELECT p_brand, min(p_size) AS min_p_size, min(p_retailprice) AS min_p_retailprice, max(p_size) AS max_p_size, max(p_retailprice) AS max_p_retailprice,
round((max(p_size) - min(p_size)) * (max(p_retailprice) - min(p_retailprice)), 4) AS volume, round(avg(length(p_name)), 6) AS mean_refs, max(length(p_name)) AS most_refs, CAST(sum(length(p_name)) AS BIGINT) AS refs FROM part GROUP BY p_brand""")
def q_box_summary(spark, sf_dir):
    rows = T(spark, sf_dir, "part").withColumn("r", F.length("p_name").cast("long"))
    out = selection.box_summary(rows, ["p_brand"], ["p_size", "p_retailprice"], "r")
    return out.withColumns({"volume": F.round("volume", 4), "mean_refs": F.round("mean_refs", 6)})


@query("q_subassemblies", """
WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN 'M6_Bolt' ELSE 'Frame_' || s_nationkey END || '_' || s_suppkey AS name FROM supplier UNION ALL SELECT n_nationkey + 1000000, n_name FROM nation),
p AS (SELECT id, regexp_extract(name, '^(.*)_[0-9]+$', 1) AS prefix FROM t WHERE regexp_matches(name, '_[0-9]+$'))
SELECT prefix, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM p WHERE prefix <> 'M6_Bolt' GROUP BY prefix HAVING count(*) >= 2""")
def q_subassemblies(spark, sf_dir):
    k = F.col("s_nationkey")
    parts = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.when(k % 4 == 0, F.lit("M6_Bolt")).otherwise(F.concat(F.lit("Frame_"), k)), F.lit("_"), F.col("s_suppkey")).alias("name"))
    parts = parts.unionByName(T(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).cast("long").alias("id"), F.col("n_name").alias("name")))
    out = assembly.subassemblies(parts, "id", "name")
    return out.select("prefix", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("q_first_match", "SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def q_first_match(spark, sf_dir):
    part = T(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return assembly.first_match(part.select("p_brand").distinct(), part, "p_brand", "p_partkey")


@query("q_curvature_histogram", """
WITH x AS (SELECT l_returnflag AS g, l_extendedprice / 10 - 2000 AS v, greatest(-100.0, least(100.0, l_extendedprice / 10 - 2000)) AS c FROM lineitem),
s AS (SELECT g, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(c) AS low, max(c) AS high FROM x GROUP BY g),
b AS (SELECT g, least(floor((c - low) / (high - low) * 50), 49) AS bin, count(*) AS k FROM x JOIN s USING (g) GROUP BY g, bin)
SELECT g, n, round(mean, 4) AS mean, round(std, 4) AS std, (SELECT string_agg(coalesce(k, 0), ',' ORDER BY i) FROM range(50) r(i) LEFT JOIN b ON b.bin = i AND b.g = s.g) AS counts FROM s""")
def q_curvature_histogram(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 10 - 2000).alias("v"))
    out = selection.histogram(rows, ["g"], "v", 50, 100.0)
    return out.select("g", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("q_error_categories", "SELECT event_type, count(*) AS n, string_agg(DISTINCT user_id, ',' ORDER BY user_id) AS items FROM events GROUP BY event_type")
def q_error_categories(spark, sf_dir):
    out = selection.categories(T(spark, sf_dir, "events"), "event_type", "user_id")
    return out.select("event_type", "n", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("q_preserved", """
WITH a AS (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 30), b AS (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20)
SELECT l_returnflag, round(count(b.l_partkey) / count(*), 6) AS rate FROM a LEFT JOIN b USING (l_returnflag, l_partkey, l_suppkey) GROUP BY l_returnflag""")
def q_preserved(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem")
    out = selection.preserved(rows.where("l_quantity < 30"), rows.where("l_quantity > 20"), ["l_partkey", "l_suppkey"], ["l_returnflag"])
    return out.withColumn("rate", F.round("rate", 6))


@query("q_collapse", """
WITH t AS (SELECT l_returnflag AS g, l_extendedprice AS x, round(l_extendedprice / 1000) * 1000 AS y FROM lineitem),
c AS (SELECT g, y, count(*) AS n, sum(abs(x - y)) AS s, max(abs(x - y)) AS m, max(x) - min(x) AS w FROM t GROUP BY g, y)
SELECT g, CAST(sum(n) AS BIGINT) AS points, round(sum(s) / sum(n), 4) AS mean_moved, round(max(m), 4) AS most_moved, CAST(sum(CASE WHEN w > 1e-6 THEN n ELSE 0 END) AS BIGINT) AS collapsed FROM c GROUP BY g""")
def q_collapse(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), (F.round(F.col("l_extendedprice") / 1000) * 1000).alias("y"))
    return selection.collapse(rows, ["g"], [("x", "y")], 1e-4).withColumns({"mean_moved": F.round("mean_moved", 4), "most_moved": F.round("most_moved", 4)})


@query("q_children", "SELECT o_custkey AS src, string_agg(DISTINCT o_orderkey, ',' ORDER BY o_orderkey) AS children FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def q_children(spark, sf_dir):
    edges = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderstatus").alias("kind"))
    return selection.children(edges, "F").select("src", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query("q_root_order", """
WITH i AS (SELECT DISTINCT p_brand, p_partkey + p_size AS id FROM part)
SELECT p.p_brand, p.p_partkey AS id, row_number() OVER (PARTITION BY p.p_brand ORDER BY i.id IS NOT NULL, CASE WHEN i.id IS NULL THEN p.p_partkey END, p_retailprice DESC, p.p_partkey DESC) - 1 AS position FROM part p LEFT JOIN i ON i.p_brand = p.p_brand AND i.id = p.p_partkey""")
def q_root_order(spark, sf_dir):
    part = T(spark, sf_dir, "part")
    edges = part.select("p_brand", (F.col("p_partkey") + F.col("p_size")).alias("dst"))
    out = selection.root_order(part.select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("weight")), edges, ["p_brand"])
    return out.withColumn("position", F.col("position").cast("long"))


@query("q_packed_batches", """
WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem WHERE l_quantity <= 45),
r AS (SELECT l_orderkey, l_linenumber, i, s AS total, 0 AS batch FROM t WHERE i = 1
 UNION ALL SELECT t.l_orderkey, t.l_linenumber, t.i, CASE WHEN r.total + t.s > 45 THEN t.s ELSE r.total + t.s END, CASE WHEN r.total + t.s > 45 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.l_orderkey = r.l_orderkey AND t.i = r.i + 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(batch AS BIGINT) AS batch FROM r""")
def q_packed_batches(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("s"))
    return selection.packed_batches(rows, ["l_orderkey"], "l_linenumber", "s", 45)
