"""Command sequences and the collapse metric on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from lodemill.functions import commands as cmd
from lodemill.operators import metrics

SCHEMA = "id int, c array<struct<type: string, params: array<bigint>>>"


def command(kind, *params):
    return (kind, [*params, *[0] * (16 - len(params))])


def got(spark, rows, fn):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(rows)), SCHEMA).orderBy("id").select(fn("c").alias("x")).collect()]


def test_encode_and_decode(spark):
    line, arc = command("LINE", 1, 2, 3, 300), command("CIRCLE", 7, 0, 255)
    out = got(spark, [[], [line], [arc, command("EOS"), line], None], cmd.encoded)
    first, circle = 11 + 16 * 256, 11 + 3 * 16 * 256
    assert out[0] == [1, 2]
    assert out[1] == [1, 6, first + 1, first + 256 + 2, first + 512 + 3, first + 768 + 255, 2]
    assert out[2] == [1, 8, circle + 7, circle + 256, circle + 512 + 255, 2]
    back = got(spark, [[arc, line], []], lambda c: cmd.decoded(cmd.encoded(c)))
    assert [(x["type"], x["params"]) for x in back[0]] == [arc, command("LINE", 1, 2, 3, 255)] and back[1] == []


def test_decode_odd_numbers(spark):
    first = 11 + 16 * 256
    rows = [(0, [1, 6, first + 9, first + 5, 6, first + 4, 2, 6]), (1, [3, first, 8]), (2, []), (3, [1, 0, 6]), (4, None)]
    out = [r["x"] for r in spark.createDataFrame(rows, "id int, i array<bigint>").orderBy("id").select(cmd.decoded("i").alias("x")).collect()]
    assert [(x["type"], x["params"][:3]) for x in out[0]] == [("LINE", [9, 0, 0]), ("LINE", [4, 0, 0])]
    assert [x["type"] for x in out[1]] == ["CIRCLE"] and out[2] == [] and out[3] == []


def test_fitted(spark):
    line, out, end = command("LINE", 1), command("EXTRUDE", 2), command("EOS")
    kinds = [[x["type"] for x in r] for r in got(spark, [[line], [line, out, line, line], [line] * 4, []], lambda c: cmd.fitted(c, 3))]
    assert kinds == [["LINE", "EOS", "EOS"], ["LINE", "EXTRUDE", "EOS"], ["LINE"] * 3, ["EOS"] * 3]
    assert got(spark, [[end, line]], lambda c: cmd.fitted(c, 2))[0][0]["type"] == "EOS"


def test_masks_and_levels(spark):
    row = spark.range(1).select(
        cmd.parameter_mask(F.lit("CIRCLE")).alias("m"), cmd.parameter_mask(F.lit("other")).alias("n"),
        cmd.quantized_command(F.struct(F.lit("LINE").alias("type"), F.array(*map(F.lit, (-5.0, 0.0, 1.0, 0.5, 1.0))).alias("params"))).alias("q"),
        cmd.adaptive_level(F.lit(0.5), F.lit(3)).alias("l"), cmd.adaptive_level(F.lit(7.0), F.lit(3)).alias("top"),
    ).first()
    assert row["m"] == [True] * 3 + [False] * 13 and not any(row["n"])
    assert row["q"]["params"] == [0, 128, 255, 191, *[0] * 12] and (row["l"], row["top"]) == (4, 7)


def test_collapse(spark):
    rows = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.0), (0.9, 1.0)]
    r = metrics.collapse(spark.createDataFrame(rows, "x double, r double"), ["x"], ["r"]).first()
    assert (r["vertices"], r["collapsed_pairs"], r["total_pairs"]) == (4, 2, 6)
    assert r["collapse_rate"] == pytest.approx(1 / 3) and r["mean_displacement"] == pytest.approx(0.075) and math.isclose(r["max_displacement"], 0.1)
    r = metrics.collapse(spark.createDataFrame([], "x double, r double"), ["x"], ["r"]).first()
    assert tuple(r) == (0, 0, 0, 0.0, 0.0, 0.0)
