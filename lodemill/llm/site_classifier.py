"""Quality and toxicity by hierarchical empirical Bayes over documents, paths and hosts.

Document evidence: a bounded labelled sample gives log likelihood ratios for the hashed words that
tell the classes apart beyond doubt (a likelihood-ratio test) and for quantile bins of the text
statistics; a logistic fit on held-back sample rows calibrates their sum. Site evidence: the expected
counts of every host and of every path in it are grouped; a host's rate is shrunk to the corpus rate
and a path's to its host's, each by a prior size fitted by moments, so sparse sites say little. A
document's posterior is its evidence with its path's rate as prior instead of the corpus rate.

Defined results: a null or empty text has the statistics 0 and no words; a null host or path is a
site of its own; null labels are ignored, and of several for a document the worst counts; repeated
rows count one by one; without labels of both classes the class is taken as absent (posterior 0);
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import FEATURES, block_stats
from .shared import LOWER, U, blocks, cut, ship, span_hashes, utf8, word_spans

BUCKETS = 1 << 22
#: Log-likelihood ratio a word must reach in the test, words kept at most, and quantile bins.
TEST, WORDS, BINS = 24.0, 4096, 16

_SPLIT = np.zeros(256, bool)
_SPLIT[:128] = [not chr(c).isalnum() for c in range(128)]


def word_buckets(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of the words of a block, lower-cased runs of letters and digits."""
    starts, ends, first = word_spans(b, off, _SPLIT)
    key = (span_hashes(LOWER[b], starts, ends) % U(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    both = np.sort(row * BUCKETS + key)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both // BUCKETS, both % BUCKETS


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, FEATURES) ratios of the text statistics, then the number of words."""
    cols = [stats[a] / np.maximum(stats[b], 1) for _, a, b in FEATURES]
    return np.column_stack([*cols, stats["n_words"]]).astype(np.float64)


@dataclass
class Head:
    """Evidence for one class: word and bin log ratios, and the calibration."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    edges: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0]))  # of 1, words and bins
    rate: float = 0.0

    def evidence(self, n: int, row: np.ndarray, bucket: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log ratios of words and of bins."""
        word, stat = np.zeros(n), np.zeros(n)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, bucket), len(self.words) - 1)
            hit = self.words[k] == bucket
            word = np.bincount(row[hit], weights=self.ratio[k[hit]], minlength=n)
        for j, (e, r) in enumerate(zip(self.edges, self.bins)):
            stat += r[np.searchsorted(e, x[:, j], "right")]
        return word, stat


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, quality_bad, toxic, fold, features and distinct word buckets of the labelled sample."""
    pick = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"), F.max("toxic").cast("int").alias("toxic"))
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            b, off = utf8(batch.column(3))
            for i, j in blocks(off):
                part, at = b[off[i] : off[j]], off[i : j + 1] - off[i]
                row, bucket = word_buckets(part, at)
                x = features(block_stats(part, at))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), pa.array(bucket))
                xs = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), xs, lists], ["doc_id", "bad", "toxic", "x", "words"])

    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    rows = rows.groupBy("doc_id", "bad", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # a text for each id
    return rows.mapInArrow(run, "doc_id long, bad int, toxic int, x array<double>, words array<long>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[Head, Head]:
    """Heads for low quality and for toxicity."""
    ship(docs.sparkSession)
    rows = cut(_sampled(docs, labels, sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3))))
    stats = rows.select("doc_id", "bad", "toxic", "fold", "x").toPandas().sort_values("doc_id", kind="stable")
    heads = []
    for name in ("bad", "toxic"):
        head = Head()
        heads.append(head)
        known = stats[stats[name].notna()]
        if known[name].nunique() < 2:
            continue
        own = known[known["fold"] != 2]
        n1, n0 = int((own[name] == 1).sum()), int((own[name] == 0).sum())
        if not n1 or not n0:
            continue
        head.rate = float((known[name] == 1).mean())
        counts = rows.where((F.col("fold") != 2) & F.col(name).isNotNull()).select(name, F.explode("words").alias("w")).groupBy("w").agg(F.sum(F.col(name)).alias("a"), F.sum(1 - F.col(name)).alias("b"))

        def g(observed: Column, expected: Column) -> Column:
            return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

        a, b, all_ = F.col("a"), F.col("b"), F.lit(float(n1 + n0))
        has = a + b
        test = 2 * (g(a, has * n1 / all_) + g(b, has * n0 / all_) + g(n1 - a, (all_ - has) * n1 / all_) + g(n0 - b, (all_ - has) * n0 / all_))
        best = counts.withColumn("test", test).where(F.col("test") >= TEST).orderBy(F.desc("test"), "w").limit(WORDS).toPandas().sort_values("w")
        head.words = best["w"].to_numpy(np.int64)
        head.ratio = np.log((best["a"].to_numpy(float) + 0.5) / (n1 + 1)) - np.log((best["b"].to_numpy(float) + 0.5) / (n0 + 1))
        x, y = np.stack(own["x"].to_numpy()), own[name].to_numpy()
        for j in range(x.shape[1]):
            e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
            at = np.searchsorted(e, x[:, j], "right")
            n = np.bincount(at[y == 1], minlength=len(e) + 1), np.bincount(at[y == 0], minlength=len(e) + 1)
            head.edges.append(e)
            head.bins.append(np.log((n[0] + 1) / (n1 + len(e) + 1)) - np.log((n[1] + 1) / (n0 + len(e) + 1)))
        calibrate(head, rows.where("fold = 2"), name)
    return heads[0], heads[1]


def calibrate(head: Head, rows: DataFrame, name: str) -> None:
    """Fit the weights of word and bin evidence on held-back rows."""
    kept = F.filter("words", lambda w: F.array_contains(F.lit(head.words.tolist()), w)) if 0 < len(head.words) <= 512 else F.col("words")
    held = rows.where(F.col(name).isNotNull()).select("doc_id", name, "x", kept.alias("words")).toPandas().sort_values("doc_id", kind="stable")
    if held[name].nunique() < 2:
        head.weights = np.array([np.log(max(head.rate, 1e-6) / max(1 - head.rate, 1e-6)), 1.0, 1.0])
        return
    row = np.repeat(np.arange(len(held)), [len(w) for w in held["words"]])
    word, stat = head.evidence(len(held), row, np.concatenate(held["words"].to_numpy()).astype(np.int64), np.stack(held["x"].to_numpy()))
    head.weights = _logistic(np.column_stack((np.ones(len(held)), word, stat)), held[name].to_numpy(float))


def evidence(docs: DataFrame, heads: tuple[Head, Head], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the calibrated log-odds (bad_odds, toxic_odds) of the whole text."""

    def run(batches):
        for batch in batches:
            b, off = utf8(batch.column(len(keep)))
            odds: list[list[np.ndarray]] = [[], []]
            for i, j in blocks(off):
                part, at = b[off[i] : off[j]], off[i : j + 1] - off[i]
                row, bucket = word_buckets(part, at)
                x = features(block_stats(part, at))
                for head, out in zip(heads, odds):
                    w = head.weights
                    word, stat = head.evidence(j - i, row, bucket, x)
                    out.append(w[0] + w[1] * word + w[2] * stat)
            cols = [pa.array(np.concatenate(o) if o else np.zeros(0), pa.float64()) for o in odds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], [*keep, "bad_odds", "toxic_odds"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", bad_odds double, toxic_odds double"
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _prior_size(rate: float, var_sites: float | None, noise: float | None, most: float = 1e4) -> float:
    """Size of the Beta prior whose variance is what the sites' rates vary beyond their own noise."""
    between = max((var_sites or 0.0) - (noise or 0.0), 1e-9)
    return float(np.clip(rate * (1 - rate) / between - 1, 2.0, most))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 20_000, keep: tuple[str, ...] = ("doc_id",), bad_from: float = 0.9, toxic_from: float = 0.5) -> DataFrame:
    """``keep``, host, path, the site rates and posteriors of both classes, and kept.

    A document goes from a posterior of ``bad_from`` or ``toxic_from`` on; a good document lost costs more
    than a poor one kept, so low quality must be likelier.
    """
    heads = fit(docs.select("doc_id", "text"), labels, sample)
    rows = evidence(docs.withColumn("_host", host.cast("string")).withColumn("_path", path.cast("string")), heads, [*keep, "_host", "_path"])
    rows = cut(rows)
    both = ("bad", "toxic")
    p = {c: 1 / (1 + F.exp(-F.greatest(F.least(F.col(f"{c}_odds"), F.lit(30.0)), F.lit(-30.0)))) for c in both}
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), *(F.sum(p[c]).alias(f"{c}_sum") for c in both))
    paths = cut(paths)
    hosts = cut(paths.groupBy("_host").agg(F.sum("n").alias("host_n"), *(F.sum(f"{c}_sum").alias(f"{c}_host_sum") for c in both)))
    stats = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"{c}_host_sum").alias(c) for c in both)).first()
    n = stats["n"] or 0
    rate = {c: float(np.clip((stats[c] or 0.0) / n if n else 0.0, 1e-6, 1 - 1e-6)) for c in both}
    out = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    moments, inner = [], []
    for c in both:
        r = rate[c]
        moments += [F.avg((F.col(f"{c}_host_sum") / F.col("host_n") - r) ** 2).alias(f"{c}_var"), F.avg(r * (1 - r) / F.col("host_n")).alias(f"{c}_noise")]
        h = F.col(f"{c}_host_sum") / F.col("host_n")
        inner += [F.avg((F.col(f"{c}_sum") / F.col("n") - h) ** 2).alias(f"{c}_var"), F.avg(h * (1 - h) / F.col("n")).alias(f"{c}_noise")]
    m, i = hosts.agg(*moments).first(), out.agg(*inner).first()
    for c in both:
        k_host, k_path = _prior_size(rate[c], m[f"{c}_var"], m[f"{c}_noise"]), _prior_size(rate[c], i[f"{c}_var"], i[f"{c}_noise"])
        out = out.withColumn(f"{c}_host_rate", (F.col(f"{c}_host_sum") + k_host * rate[c]) / (F.col("host_n") + k_host))
        out = out.withColumn(f"{c}_path_rate", (F.col(f"{c}_sum") + k_path * F.col(f"{c}_host_rate")) / (F.col("n") + k_path))
    sites = out.select(F.col("_host").alias("host"), F.col("_path").alias("path"), *(f"{c}_{s}_rate" for c in both for s in ("host", "path")))
    done = rows.join(sites, F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path")))
    for c in both:
        r = F.least(F.greatest(F.col(f"{c}_path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
        odds = F.col(f"{c}_odds") + F.ln(r / (1 - r)) - float(np.log(rate[c] / (1 - rate[c])))
        done = done.withColumn(f"{c}_posterior", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0)))))
    done = done.withColumn("kept", (F.col("bad_posterior") < bad_from) & (F.col("toxic_posterior") < toxic_from))
    return done.select(*keep, "host", "path", *(f"{c}_{s}" for c in both for s in ("host_rate", "path_rate", "posterior")), "kept")


def op5_site_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classified(docs, labels, F.col("source"), F.col("lang"))
