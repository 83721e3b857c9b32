"""Queries over command sequences and adaptive quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands as cmd
from ..functions import vectors as vec
from ..operators import metrics
from .queries_core import T
from .registry import query

#: An order is a sequence, a line of it a command with ten raw parameters; line numbers repeat, so type and part follow.
_LINES = """lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 6, l_partkey) AS l_linenumber, CAST(l_suppkey % 6 AS INTEGER) AS k, l_partkey FROM lineitem),
used AS (SELECT *, [2, 4, 6, 3, 8, 0][k + 1] AS a, ['SOL', 'LINE', 'ARC', 'CIRCLE', 'EXTRUDE', 'EOS'][k + 1] AS kind FROM lines),
cut AS (SELECT *, coalesce(min(CASE WHEN k = 5 THEN l_linenumber END) OVER (PARTITION BY l_orderkey), 1000) AS stop FROM used),
params AS (SELECT c.*, j, CAST(round_even((least(greatest((l_partkey * (j + 1)) % 29 / 10e0 - 1.4e0, -1e0), 1e0) + 1e0) / 2e0 * 255, 0) AS BIGINT) AS q FROM cut c JOIN range(0, 8) t(j) ON j < a)"""


def _sequences(spark, sf_dir):
    """(l_orderkey, commands) with quantized commands in the order of the lines."""
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    raw = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda j: F.col("l_partkey") * j % 29 / 10.0 - 1.4)
    number = (F.col("l_suppkey") % 6).cast("int")
    kind = F.get(F.array(*map(F.lit, cmd.KINDS)), number)
    rows = rows.select("l_orderkey", "l_linenumber", number.alias("k"), "l_partkey", cmd.quantized_command(F.struct(kind.alias("type"), raw.alias("params"))).alias("command"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "k", "l_partkey", "command")))
    return rows.groupBy("l_orderkey").agg(F.transform(lines, lambda x: x["command"]).alias("commands"))


def _shown(command):
    return F.concat_ws(" ", command["type"], F.concat_ws(",", F.slice(command["params"], 1, 8).cast("array<string>")))


@query("q_command_encode", f"""
WITH {_LINES}, ids AS (SELECT l_orderkey, l_linenumber, -1 AS j, k + 5 AS id FROM cut WHERE l_linenumber < stop
 UNION ALL SELECT l_orderkey, l_linenumber, j, 11 + (k * 16 + j) * 256 + q FROM params WHERE l_linenumber < stop)
SELECT o.l_orderkey, rtrim('1 ' || coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY l_linenumber, j), '')) || ' 2' AS ids
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN ids USING (l_orderkey) GROUP BY o.l_orderkey""")
def q_command_encode(spark, sf_dir):
    return _sequences(spark, sf_dir).select("l_orderkey", F.array_join(cmd.encoded("commands").cast("array<string>"), " ").alias("ids"))


@query("q_command_decode", f"""
WITH {_LINES}, shown AS (SELECT l_orderkey, l_linenumber, any_value(kind) || ' ' || string_agg(CAST(coalesce(q, 0) AS VARCHAR), ',' ORDER BY t.j) AS s
 FROM (SELECT * FROM cut WHERE l_linenumber < stop) c CROSS JOIN range(0, 8) t(j) LEFT JOIN (SELECT l_orderkey AS ok, l_linenumber AS ln, j AS pj, q FROM params) p ON ok = l_orderkey AND ln = l_linenumber AND pj = t.j GROUP BY l_orderkey, l_linenumber)
SELECT o.l_orderkey, coalesce(string_agg(s, ';' ORDER BY l_linenumber), '') AS commands FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN shown USING (l_orderkey) GROUP BY o.l_orderkey""")
def q_command_decode(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("l_orderkey", cmd.encoded("commands").alias("ids"))
    return rows.select("l_orderkey", cmd.decoded("ids").alias("commands")).select("l_orderkey", F.array_join(F.transform("commands", _shown), ";").alias("commands"))


@query("q_command_fit", f"""
WITH {_LINES}, placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM used),
ends AS (SELECT l_orderkey, CASE WHEN max(n) <= 4 THEN max(n) ELSE coalesce(max(CASE WHEN place <= 4 AND k IN (4, 5) THEN place END), 4) END AS keep FROM placed GROUP BY l_orderkey)
SELECT l_orderkey, string_agg(CASE WHEN place <= keep THEN kind ELSE 'EOS' END, ' ' ORDER BY slot) AS kinds
FROM (SELECT e.l_orderkey, e.keep, slot, p.place, p.kind FROM ends e CROSS JOIN range(1, 5) s(slot) LEFT JOIN placed p ON p.l_orderkey = e.l_orderkey AND p.place = slot) GROUP BY l_orderkey""")
def q_command_fit(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("l_orderkey", cmd.fitted("commands", 4).alias("commands"))
    return rows.select("l_orderkey", F.array_join(F.transform("commands", lambda x: x["type"]), " ").alias("kinds"))


@query("q_adaptive_quantize", """
WITH r AS (SELECT quantile_cont(p_retailprice, 0.1) AS lo, quantile_cont(p_retailprice, 0.9) AS hi FROM part),
b AS (SELECT p_partkey, p_size / 50e0 AS u, CAST(round_even(6 + least(greatest((p_retailprice - lo) / (hi - lo), 0), 1) * 8, 0) AS INTEGER) AS bits FROM part, r),
l AS (SELECT *, CAST(round_even(u * ((1 << bits) - 1), 0) AS BIGINT) AS level FROM b)
SELECT p_partkey, bits, level, round(level / CAST((1 << bits) - 1 AS DOUBLE), 8) AS value FROM l""")
def q_adaptive_quantize(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    ends = rows.agg(F.percentile("p_retailprice", 0.1).alias("lo"), F.percentile("p_retailprice", 0.9).alias("hi"))  # one row
    rows = rows.join(F.broadcast(ends)).select("p_partkey", (F.col("p_size") / 50.0).alias("unit"), vec.bits_of("p_retailprice", "lo", "hi", 6, 14).alias("bits"))
    rows = rows.select("p_partkey", "bits", cmd.adaptive_level("unit", "bits").alias("level"))
    return rows.select("*", F.round(cmd.adaptive_value("level", "bits"), 8).alias("value"))


@query("q_collapse", """
WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, round_even(l_quantity / 50e0 * 15, 0) AS qx, round_even(l_discount * 15e0, 0) AS qy FROM lineitem),
d AS (SELECT *, sqrt((x - qx / 15 * 50) ** 2 + (y - qy / 15) ** 2) AS off FROM v),
s AS (SELECT x, y, qx, qy, count(*) AS m FROM v GROUP BY ALL), g AS (SELECT sum(m) AS n, sum(m * m) AS alike FROM s GROUP BY qx, qy)
SELECT CAST((SELECT count(*) FROM v) AS BIGINT) AS vertices, CAST((SELECT sum((n * n - alike) // 2) FROM g) AS BIGINT) AS collapsed_pairs, (SELECT round(avg(off), 6) FROM d) AS mean_displacement, (SELECT round(max(off), 6) FROM d) AS max_displacement""")
def q_collapse(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    rows = rows.select("x", "y", (F.bround(F.col("x") / 50 * 15) / 15 * 50).alias("rx"), (F.bround(F.col("y") * 15) / 15).alias("ry"))
    out = metrics.collapse(rows, ["x", "y"], ["rx", "ry"])
    return out.select("vertices", "collapsed_pairs", F.round("mean_displacement", 6).alias("mean_displacement"), F.round("max_displacement", 6).alias("max_displacement"))
