"""Relational, text and chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import chunks, relational
from .registry import query


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("q_token_count", r"""
SELECT lang, count(*) AS n_docs, round(avg(n), 6) AS avg_tokens, CAST(max(n) AS BIGINT) AS max_tokens,
       round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM (SELECT d.lang, len(regexp_extract_all(d.text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, l.quality
      FROM documents d JOIN labels l USING (doc_id)) WHERE n >= 20 GROUP BY lang""")
def q_token_count(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").select("doc_id", "lang", tx.token_count("text").alias("n")).where("n >= 20")
    rows = docs.join(T(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").cast("long").alias("max_tokens"), F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("pass_rate"))


@query("q_project_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount <= 0.05 AND l_returnflag <> 'N'""")
def q_project_filter(spark, sf_dir):
    conditions = [("l_quantity", ">=", 30), ("l_discount", "<=", 0.05), ("l_returnflag", "!=", "N"), ("absent", "==", 1)]
    return relational.scan(T(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], filters=conditions)


@query("q_schema_validate", """
SELECT count(*) AS n_rows, count(*) FILTER (NOT coalesce(o_orderkey > 0, false)) AS bad_key,
  count(*) FILTER (NOT coalesce(o_totalprice BETWEEN 0 AND 100000, false)) AS bad_price,
  count(*) FILTER (NOT coalesce(o_orderstatus IN ('O', 'F', 'P'), false)) AS bad_status FROM orders""")
def q_schema_validate(spark, sf_dir):
    rules = {"bad_key": F.col("o_orderkey") > 0, "bad_price": F.col("o_totalprice").between(0, 100000), "bad_status": F.col("o_orderstatus").isin("O", "F", "P")}
    return relational.validation(T(spark, sf_dir, "orders"), rules)


@query("q_split_manifest", """
SELECT split, count(*) AS n, min(p_partkey) AS first_key FROM (
  SELECT p_partkey, CASE WHEN b < 10 THEN 'test' WHEN b < 25 THEN 'val' ELSE 'train' END AS split FROM (
    SELECT p_partkey, floor(((p_partkey::HUGEINT * 2654435761 + 40503) % 4294967296)::DOUBLE / 65536)::BIGINT % 100 AS b FROM part)) GROUP BY split""")
def q_split_manifest(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select("p_partkey", relational.split_of(F.col("p_partkey"), val=15, test=10).alias("split"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("q_semi_dedupe", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE md5(e.text) = md5(d.text) AND e.doc_id < d.doc_id)")
def q_semi_dedupe(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").where("doc_id > first").select("doc_id")


@query("q_anti_dedupe", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q_anti_dedupe(spark, sf_dir):
    return T(spark, sf_dir, "customer").select("c_custkey").join(T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("q_best_of_group", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r
FROM events WHERE value IS NOT NULL) WHERE r = 1""")
def q_best_of_group(spark, sf_dir):
    rows = T(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "event_id", "value")
    return relational.best_of(rows, ["user_id", "event_type"], "value", "event_id")


@query("q_topk_types", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def q_topk_types(spark, sf_dir):
    out = T(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median_value"))
    return out.orderBy(F.desc("n"), "event_type").limit(3)


@query("q_set_ops", """
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""")
def q_set_ops(spark, sf_dir):
    a, b = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    sets = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct()}
    parts = [df.agg(F.lit(name).alias("op"), F.count("*").alias("n")) for name, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q_bench_stats", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def q_bench_stats(spark, sf_dir):
    return T(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("b_join_revenue", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def b_join_revenue(spark, sf_dir):
    t = lambda n: T(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("b_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def b_pricing_summary(spark, sf_dir):
    return T(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("b_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def b_rollup(spark, sf_dir):
    return T(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("b_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def b_cube(spark, sf_dir):
    return T(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("b_window_running", """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank FROM orders""")
def b_window_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    running = F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return T(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(running, 2).alias("running"), F.rank().over(w.orderBy(F.desc("o_totalprice"))).cast("long").alias("price_rank"))


@query("b_pivot", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o FROM orders GROUP BY o_orderpriority""")
def b_pivot(spark, sf_dir):
    out = T(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("n_f"), F.coalesce("O", F.lit(0)).alias("n_o"))


@query("q_filename_split", """
SELECT CASE WHEN contains(p_type, 'STEEL') THEN 'train' WHEN contains(p_type, 'BRASS') THEN 'val' WHEN contains(p_type, 'TIN') THEN 'test' ELSE 'other' END AS split, count(*) AS n FROM part GROUP BY 1""")
def q_filename_split(spark, sf_dir):
    split = relational.first_match(F.col("p_type"), [("STEEL", "train"), ("BRASS", "val"), ("TIN", "test")], "other")
    return T(spark, sf_dir, "part").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------- text


@query("q_token_hash", r"""
SELECT DISTINCT token, ((('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT) % 50000)::BIGINT AS id
FROM (SELECT token, md5(token) AS h FROM (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark) WHERE token <> '')""")
def q_token_hash(spark, sf_dir):
    words = T(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''").distinct()
    return words.select("token", tx.md5_token_id("token", 50000).alias("id"))


@query("q_seq_chunks", """
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, chunk, count(*) AS items, min(turn) AS first_turn FROM p, range(0, 2000) t(chunk)
WHERE pos >= chunk * 2 AND pos < chunk * 2 + 3 AND (chunk = 0 OR n - chunk * 2 > 1) GROUP BY conv_id, chunk""")
def q_seq_chunks(spark, sf_dir):
    rows = chunks.sliding_chunks(T(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], size=3, overlap=1)
    return rows.groupBy("conv_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("items"), F.min("turn").alias("first_turn"))


@query("q_type_chunks", """
SELECT l_returnflag, chunk, count(*) AS n, min(l_orderkey) AS first_key FROM (
  SELECT l_returnflag, l_orderkey, (row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey % 64 ORDER BY l_orderkey, l_linenumber) - 1) // 50 AS chunk FROM lineitem) GROUP BY l_returnflag, chunk""")
def q_type_chunks(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", (F.col("l_partkey") % 64).alias("part"))
    out = chunks.typed_chunks(rows, ["l_returnflag", "l_linestatus", "part"], ["l_orderkey", "l_linenumber"], 50)
    return out.groupBy("l_returnflag", "chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


@query("q_budget_chunks", r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS w FROM conversations),
r AS (SELECT conv_id, i, turn, w, 0 AS chunk, w AS s FROM t WHERE i = 1
      UNION ALL SELECT t.conv_id, t.i, t.turn, t.w, CASE WHEN r.s > 0 AND r.s + t.w > 120 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.s > 0 AND r.s + t.w > 120 THEN t.w ELSE r.s + t.w END
      FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, CAST(w AS BIGINT) AS tokens, CAST(chunk AS BIGINT) AS chunk FROM r""")
def q_budget_chunks(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_count("text").cast("long").alias("tokens"))
    return chunks.budget_chunks(rows, ["conv_id"], "turn", "tokens", 120).withColumn("chunk", F.col("chunk").cast("long"))


@query("q_size_shards", r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS w FROM conversations),
r AS (SELECT conv_id, i, turn, w, 0 AS shard, w AS s FROM t WHERE i = 1
      UNION ALL SELECT t.conv_id, t.i, t.turn, t.w, CASE WHEN r.s >= 500 THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.s >= 500 THEN t.w ELSE r.s + t.w END
      FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, CAST(shard AS BIGINT) AS shard FROM r""")
def q_size_shards(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return chunks.size_shards(rows, ["conv_id"], "turn", "size", 500).select("conv_id", "turn", F.col("shard").cast("long").alias("shard"))


@query("q_split_boundaries", r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS tok FROM benchmark)
SELECT item_id, w, len(part) AS n, array_to_string(part, ' ') AS piece FROM (
  SELECT item_id, w, list_slice(tok, w * 12 + 1, w * 12 + 16) AS part FROM t, range(0, 5000) r(w) WHERE w * 12 + 1 <= greatest(len(tok) - 4, 1))""")
def q_split_boundaries(spark, sf_dir):
    rows = T(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.split_windows(tx.simple_tokens("text"), 16, 4)).alias("w", "part"))
    return rows.select("item_id", F.col("w").cast("long").alias("w"), F.size("part").cast("long").alias("n"), F.array_join("part", " ").alias("piece"))


_CLEAN = r"""
SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = '{}'"""


def _prefixes(t: str, prefixes: tuple[str, ...]) -> str:
    for p in prefixes:
        t = f"CASE WHEN starts_with(lower({t}), '{p.lower()}') THEN regexp_replace(substr({t}, {len(p) + 1}), '^\\s+', '') ELSE {t} END"
    return t


@query("q_clean_questions", f"""
WITH a AS ({_CLEAN.format('user')}), b AS (SELECT conv_id, turn, {_prefixes('t', ('Question:', 'Q:'))} AS t FROM a), d AS (SELECT conv_id, turn, {_prefixes('t', ('Here is a question:', 'Generated question:'))} AS t FROM b),
e AS (SELECT conv_id, turn, CASE WHEN t = '' OR t LIKE '%?' THEN t ELSE t || '?' END AS t FROM d) SELECT conv_id, turn, CASE WHEN length(t) >= 10 THEN t END AS question FROM e""")
def q_clean_questions(spark, sf_dir):
    return T(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", tx.clean_question("text").alias("question"))


@query("q_clean_answers", f"""
WITH a AS ({_CLEAN.format('assistant')}), b AS (SELECT conv_id, turn, {_prefixes('t', ('Answer:', 'A:'))} AS t FROM a), d AS (SELECT conv_id, turn, {_prefixes('t', ('Here is the answer:', 'Generated answer:'))} AS t FROM b)
SELECT conv_id, turn, {_prefixes('t', ('Based on the context,', 'According to the CAD data,'))} AS answer FROM d""")
def q_clean_answers(spark, sf_dir):
    return T(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", tx.clean_answer("text").alias("answer"))


@query("q_parse_refs", r"""
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def q_parse_refs(spark, sf_dir):
    rows = T(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"))


@query("q_ngram_overlap", r"""
WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM b, range(1, 4000) r(i) WHERE i + 7 <= len(w)),
d AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM d, range(1, 30000) r(i) WHERE i + 7 <= len(w))
SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY item_id, doc_id""")
def q_ngram_overlap(spark, sf_dir):
    def grams(df, key, text):
        words = df.select(key, F.split(text, " ").alias("w")).where(F.size("w") >= 8)
        return words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("g")).distinct()

    bench = grams(T(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    docs = grams(T(spark, sf_dir, "documents"), "doc_id", F.translate("text", "\n", " "))
    return docs.join(bench, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("q_pad_collate", """
WITH t AS (SELECT conv_id, list(CAST(length(text) AS BIGINT) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_resize(a[1:8], 8, 0::BIGINT), ',') AS ids, array_to_string(list_transform(list_resize(a[1:8], 8, 0::BIGINT), lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ',') AS mask FROM t""")
def q_pad_collate(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("a"))
    ids = vec.pad(F.transform("a", lambda s: s["n"]), 8, F.lit(0).cast("long"))
    return rows.select("conv_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.array_join(tx.attention_mask(ids).cast("array<string>"), ",").alias("mask"))


@query("q_shift_labels", """
WITH t AS (SELECT conv_id, list(CAST(length(text) AS BIGINT) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_append(a[2:], -100), ',') AS labels FROM t""")
def q_shift_labels(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("a"))
    return rows.select("conv_id", F.array_join(vec.next_labels(F.transform("a", lambda s: s["n"])).cast("array<string>"), ",").alias("labels"))


@query("q_normal_values", "SELECT v, count(*) AS n FROM (SELECT translate(lower(trim(p_name)), ' -_', '') AS v FROM part) GROUP BY v")
def q_normal_values(spark, sf_dir):
    return T(spark, sf_dir, "part").groupBy(tx.normal_value("p_name").alias("v")).agg(F.count("*").alias("n"))


@query("q_content_key", "SELECT doc_id, sha256(sha256(text) || ':' || '{\"bits\":8}') AS cache_key FROM documents")
def q_content_key(spark, sf_dir):
    key = F.sha2(F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit(':{"bits":8}')), 256)
    return T(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


@query("q_chunk_stats", """
SELECT lang, CAST(min(w) AS BIGINT) AS least, CAST(max(w) AS BIGINT) AS most, round(avg(w), 6) AS mean, round(median(w), 6) AS median FROM (SELECT lang, len(string_split(text, ' ')) AS w FROM documents) GROUP BY lang""")
def q_chunk_stats(spark, sf_dir):
    rows = T(spark, sf_dir, "documents").select("lang", F.size(F.split("text", " ")).alias("w"))
    return rows.groupBy("lang").agg(F.min("w").cast("long").alias("least"), F.max("w").cast("long").alias("most"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.median("w"), 6).alias("median"))


@query("q_cross_refs", """
WITH i AS (SELECT conv_id * 1000 + turn AS item, conv_id, turn // 2 AS chunk FROM conversations), r AS (SELECT item AS src, item + 1 AS dst FROM i)
SELECT a.conv_id * 1000 + a.chunk AS src_chunk, b.conv_id * 1000 + b.chunk AS dst_chunk, count(*) AS n FROM r JOIN i a ON r.src = a.item JOIN i b ON r.dst = b.item
WHERE a.conv_id * 1000 + a.chunk <> b.conv_id * 1000 + b.chunk GROUP BY 1, 2""")
def q_cross_refs(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("chunk"))
    return chunks.cross_references(rows, rows.select(F.col("item").alias("src"), (F.col("item") + 1).alias("dst")))


@query("q_running_offsets", """
SELECT o_custkey, o_orderkey, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM orders""")
def q_running_offsets(spark, sf_dir):
    rows = T(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return chunks.running_offsets(rows, ["o_custkey"], ["o_orderkey"], "size").drop("size")
