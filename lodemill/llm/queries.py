"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_ann_graph
from .lm_mixing import op4_lm_mixing
from .mixing import op9_mixing
from .near_dup import op3_near_dup
from .packing import op7_best_fit_packing
from .quality_rules import op10_quality_rules
from .site_classifier import op5_site_classifier
from .suffix_dedup import op6_suffix_dedup
from .token_files import op8_token_files
from .warc import op1_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_ann_graph": op2_ann_graph,
    "op3_near_dup": op3_near_dup,
    "op4_lm_mixing": op4_lm_mixing,
    "op5_site_classifier": op5_site_classifier,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for what it can express: op2, op4, op7, op8 and op10 rest on graphs, models and tokenizers, op5 on a
#: classifier, op9 on a knapsack programme; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, octet_length(encode(p.html)) AS payload_bytes, upper(sha1(p.html)) AS hex, first FROM p JOIN f ON f.html = p.html)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
    "op3_near_dup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM n GROUP BY k),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM (SELECT g.* FROM g JOIN c ON c.node = g.doc_id) a JOIN (SELECT g.* FROM g JOIN c ON c.node = g.doc_id) b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN c x ON x.node = o.a JOIN c y ON y.node = o.b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
l AS (SELECT a AS node, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.low, d.doc_id) AS component_id, coalesce(l.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.k = n.k LEFT JOIN l ON l.node = c.node""",
    "op6_suffix_dedup": """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING count(*) > 1),
z AS (SELECT s.doc_id, i FROM s JOIN m USING (x) WHERE s.doc_id > first),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM z),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
v AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM q GROUP BY doc_id, k),
y AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS z FROM v UNION ALL SELECT doc_id, 0, min(lo) FROM v GROUP BY doc_id),
u AS (SELECT t.doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (z - a), len(h))), '' ORDER BY a) AS kept FROM y JOIN t USING (doc_id) GROUP BY t.doc_id),
j AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM v GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN u ON u.doc_id = t.doc_id LEFT JOIN j ON j.doc_id = t.doc_id""",
}
