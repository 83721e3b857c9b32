"""Quality rules: text statistics, and a learned decision list over them.

``with_stats`` measures whole texts in numpy, a block of rows at a time. ``learn`` covers the bad
labelled rows one rule after another: each rule grows by the threshold with the best information
gain, is pruned on held-back rows and kept if it is precise enough. The list becomes an ordered
``CASE WHEN`` that Spark evaluates; only the labelled rows (a bounded sample) reach the driver.

Defined results: a null or empty text has zero in every statistic and fails the base rule; repeated
rows are judged one by one alike; an empty table gives an empty result; without labelled rows the
list is empty and only the base rule rejects. Labels that are null are ignored, and of several labels
for a document the smallest counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, ragged, ship, utf8, word_spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_code_points")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _kinds(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A number for each b[lo:hi], the same for equal bytes and no others."""
    size = hi - lo
    off = np.concatenate(([0], np.cumsum(size)))
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(b[ragged(b, lo, size)])])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]) of numbers below 2**31, the same for equal pairs and no others."""
    return np.unique((a << 31) | b, return_inverse=True)[1].astype(np.int64)


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def block_stats(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text b[off[i]:off[i+1]]."""
    n = len(off) - 1
    starts, ends, first = word_spans(b, off)
    letter = (b & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
    out = {"n_words": np.diff(first), "word_chars": _sums(points[ends] - points[starts], first), "n_symbols": _sums(_SYMBOL[b], off), "n_upper": _sums(_UPPER[b], off), "n_code_points": points[off[1:]] - points[off[:-1]]}
    newline = np.flatnonzero(b == 10)
    lo, hi = np.sort(np.concatenate((off[:-1], newline + 1))), np.sort(np.concatenate((newline, off[1:])))
    row = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(newline, off)))
    worded = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi, row = lo[worded], hi[worded], row[worded]
    out["n_lines"] = np.bincount(row, minlength=n)
    kind = _pairs(row, _kinds(b, lo, hi))  # equal lines of a text
    first_of = np.unique(kind, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first_of], minlength=n)
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        word_row = np.repeat(np.arange(n), np.diff(first))
        word = _kinds(b, starts, ends)
        at = np.flatnonzero(word_row[:-2] == word_row[2:])
        window = _pairs(word_row[at], _pairs(_pairs(word[at], word[at + 1]), word[at + 2]))
        twice = at[np.bincount(window)[window] > 1] if len(at) else at
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = _sums(covered, first)
    return out


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "stats") -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and a struct ``out`` of STATS of the whole text."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    struct = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, struct)])

    def run(batches):
        for batch in batches:
            b, off = utf8(batch.column(batch.schema.get_field_index(text)))
            parts: dict[str, list[np.ndarray]] = {s: [] for s in STATS}
            for i, j in blocks(off):
                for s, v in block_stats(b[off[i] : off[j]], off[i : j + 1] - off[i]).items():
                    parts[s].append(v)
            cols = [pa.array(np.concatenate(parts[s]) if parts[s] else np.zeros(0), pa.int64()) for s in STATS]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.StructArray.from_arrays(cols, list(STATS))], [*keep, out])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------- the decision list

#: Ratios of the statistics, as (name, numerator, denominator); an absent denominator counts as 1.
FEATURES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("repeated_lines", "n_dup_lines", "n_lines"),
    ("upper_share", "n_upper", "n_code_points"),
    ("words_per_line", "n_words", "n_lines"),
)


def feature_columns(stats: str = "stats") -> dict[str, Column]:
    return {name: F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1)) for name, a, b in FEATURES}


@dataclass
class DecisionList:
    """Rules in order; each is a list of (feature, '>' or '<=', threshold). A matching rule rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def expression(self, features: dict[str, Column]) -> Column:
        """0 if no rule matches, else the number of the first that does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for name, op, x in rule:
                test = test & (features[name] > x if op == ">" else features[name] <= x)
            out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def apply(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(frame), np.int64)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out[_match(frame, rule)] = i
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{a} {op} {x:.4g}" for a, op, x in rule) for rule in self.rules)


def _match(frame: pd.DataFrame, rule) -> np.ndarray:
    hit = np.ones(len(frame), bool)
    for name, op, x in rule:
        v = frame[name].to_numpy()
        hit &= v > x if op == ">" else v <= x
    return hit


def _grow(frame: pd.DataFrame, bad: np.ndarray, names: list[str], cuts: int, longest: int) -> list:
    rule, live = [], np.ones(len(frame), bool)
    while len(rule) < longest:
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name in names:
            v = frame[name].to_numpy()
            own = np.unique(v[live])
            if len(own) < 2:
                continue
            pick = np.unique(np.linspace(0, len(own) - 2, min(cuts, len(own) - 1)).astype(int))
            at = (own[pick] + own[pick + 1]) / 2
            pos, neg = np.sort(v[live & bad]), np.sort(v[live & ~bad])
            p, n = np.searchsorted(pos, at, "right"), np.searchsorted(neg, at, "right")
            for op, a, b in (("<=", p, n), (">", len(pos) - p, len(neg) - n)):
                gain = a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1e-9)) - base)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float(at[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _match(frame, rule[-1:])
    return rule


def learn(frame: pd.DataFrame, bad: np.ndarray, *, precision: float = 0.98, support: int = 5, longest: int = 3, cuts: int = 256, most: int = 24) -> DecisionList:
    """Sequential covering of the rows with ``bad``; every third row is held back for pruning."""
    names, rules = [n for n, _, _ in FEATURES], []
    left = np.ones(len(frame), bool)
    held = np.arange(len(frame)) % 3 == 2
    while len(rules) < most and (left & bad).sum() >= support:
        grow, prune = left & ~held, left & held
        rule = _grow(frame[grow], bad[grow], names, cuts, longest)
        if not rule:
            break

        def worth(r, on=prune):
            hit = _match(frame, r) & on
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / max(p + n, 1)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), len(r)))
        hit = _match(frame, rule) & left
        if (hit & bad).sum() < max(support, precision * hit.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, text: str = "text") -> pd.DataFrame:
    """Features and quality of at most ``most`` labelled documents, the first by a hash of their id; of rows
    that share an id, the one with the smallest statistics."""
    pick = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label_quality"))
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows: small enough to broadcast
    rows = with_stats(docs.select("doc_id", text).join(F.broadcast(pick), "doc_id"), text, ["doc_id", "label_quality"])
    rows = rows.select("doc_id", "label_quality", F.col("stats.n_words").alias("n_words"), *(c.alias(n) for n, c in feature_columns().items()))
    names = [c for c in rows.columns if c != "doc_id"]
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("one")).select("doc_id", "one.*")  # a row for each id
    return rows.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def base_failed(stats: str = "stats") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows of three."""
    return (F.col(f"{stats}.n_words") < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * F.col(f"{stats}.n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, text: str = "text") -> DecisionList:
    frame = labelled_sample(docs, labels, sample_rows, text)
    if not len(frame):
        return DecisionList()
    order = np.argsort(pd.util.hash_array(frame["doc_id"].to_numpy()), kind="stable")
    frame = frame.iloc[order].reset_index(drop=True)
    return learn(frame, (frame["label_quality"] == 0).to_numpy())


def judged(docs: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with its statistics, base_failed, the number of the rule that rejects it, and kept.

    The statistics are a struct ``stats``, with underscores before it if ``docs`` has such a column;
    columns of the other three names are replaced.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("base_failed", "rule", "kept")]
    stats = "stats"
    while stats in own:
        stats = f"_{stats}"
    out = with_stats(docs, text, own, stats).withColumn("base_failed", base_failed(stats))
    out = out.withColumn("rule", rules.expression(feature_columns(stats)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    out = judged(docs, rules, keep=["doc_id"])
    return out.select("doc_id", *(F.col(f"stats.{s}").alias(s) for s in STATS[:5]), "base_failed", "kept", "rule")
