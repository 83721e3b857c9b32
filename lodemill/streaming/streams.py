"""Structured Streaming: scans, count batches, event-time windows, per-key n-gram state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def count_batches(df: DataFrame, order: list[str], size: int, group: list[str] = ()) -> DataFrame:
    """Rows with the number of their batch of ``size`` rows within the group; the last may be smaller."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size))


def prepared(df: DataFrame, ids: str, pad_id: int = 0) -> DataFrame:
    """Token rows with their mask and number of tokens that are not padding."""
    mask = F.transform(ids, lambda x: (x != pad_id).cast("int"))
    return df.withColumn("mask", mask).withColumn("n_tokens", F.aggregate("mask", F.lit(0), lambda a, x: a + x))


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and key; works on streams and tables alike."""
    events, w = events.withColumn(ts, F.col(ts).cast("timestamp")), F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def ngram_bans(events: DataFrame, key: str, token: str, n: int, keep: int = 4096) -> DataFrame:
    """key, position, banned: after each token of a key, the tokens that would repeat an n-gram.

    The state of a key holds its last n-1 tokens and at most ``keep`` prefixes, the oldest go first.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, seen, at = state.get if state.exists else ([], [], 0)
        recent, table = list(recent), {tuple(p): list(v) for p, v in seen}
        rows = []
        for pdf in batches:
            for t in pdf[token].tolist():
                if len(recent) == n - 1:
                    p = tuple(recent)
                    table.setdefault(p, [])
                    if t not in table[p]:
                        table[p].append(t)
                    table[p] = table.pop(p)
                    if len(table) > keep:
                        table.pop(next(iter(table)))
                recent = (recent + [t])[-(n - 1) :]
                rows.append((keys[0], at, sorted(table.get(tuple(recent), []))))
                at += 1
        state.update((recent, [(list(p), v) for p, v in table.items()], at))
        yield pd.DataFrame(rows, columns=[key, "position", "banned"])

    kind = dict(events.dtypes)[token]
    out = f"{key} {dict(events.dtypes)[key]}, position long, banned array<{kind}>"
    held = f"recent array<{kind}>, seen array<struct<p: array<{kind}>, v: array<{kind}>>>, at long"
    return events.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> None:
    """Run a stream over all that is there now, giving each micro-batch to ``each``."""
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.foreachBatch(each or (lambda batch, number: None)).start().awaitTermination()
