"""Sketch-and-extrude commands as column expressions: masks, quantization, fixed lengths, token numbers.

A command is a struct (type, params); a sequence is an array of them. Nulls stay null; a command of an
unknown type has no active parameter and the number of the first type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import c, pad, quantize

#: Command types in the order of their numbers, and how many leading parameters each uses.
KINDS = {"SOL": 2, "LINE": 4, "ARC": 6, "CIRCLE": 3, "EXTRUDE": 8, "EOS": 0}
#: Special tokens, and the parameters of a command.
PAD, BOS, EOS, SEP, UNK = range(5)
SPECIALS, WIDTH = 5, 16
_PARAMS = SPECIALS + len(KINDS)  # the first number of a parameter's value


def _once(x: Column, then) -> Column:
    """then(x), with x evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def kind_number(kind) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, KINDS)), c(kind)) - 1, F.lit(0))


def active(kind) -> Column:
    """How many parameters of a command of this type are in use."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[c(kind)], F.lit(0))


def parameter_mask(kind) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: j < active(kind))


def quantized_command(command: Column, levels: int = 256, width: float = 2.0) -> Column:
    """The command with its active parameters, cut to half the width either side of 0, as levels; others are 0."""
    kept = F.slice(command["params"], 1, active(command["type"]))
    return F.struct(command["type"].alias("type"), pad(F.transform(kept, lambda v: quantize(v, F.lit(-width / 2), F.lit(width / 2), levels)), WIDTH, F.lit(0).cast("long")).alias("params"))


def fitted(commands, length: int) -> Column:
    """The sequence filled up with ends to ``length``, or cut after the last extrusion or end that fits."""
    a = F.slice(c(commands), 1, length)
    whole = F.array_max(F.transform(a, lambda x, i: F.when(x["type"].isin("EXTRUDE", "EOS"), i + 1)))
    cut = F.when(F.size(c(commands)) > length, F.slice(a, 1, F.coalesce(whole, F.lit(length)))).otherwise(a)
    end = F.struct(F.lit("EOS").alias("type"), F.array_repeat(F.lit(0).cast("long"), WIDTH).alias("params"))
    return F.concat(cut, F.array_repeat(end, F.lit(length) - F.size(cut)))


def _value_number(kind: Column, place: Column, levels: int) -> Column:
    """The number of level 0 of a parameter."""
    return F.lit(_PARAMS) + (kind * WIDTH + place) * levels


def encoded(commands, levels: int = 256) -> Column:
    """Numbers of quantized commands up to the first end: its type's, then its active parameters'; between BOS and EOS."""
    a = c(commands)
    end = F.array_position(F.transform(a, lambda x: x["type"]), "EOS").cast("int")
    live = F.when(end > 0, F.slice(a, 1, end - 1)).otherwise(a)

    def numbers(x: Column) -> Column:
        kind = kind_number(x["type"])
        level = lambda v, j: _value_number(kind, j, levels) + F.least(F.greatest(v, F.lit(0)), F.lit(levels - 1))
        return F.concat(F.array((kind + SPECIALS).cast("long")), F.transform(F.slice(x["params"], 1, active(x["type"])), lambda v, j: level(v, j).cast("long")))

    return F.concat(F.array(F.lit(BOS).cast("long")), F.flatten(F.transform(live, numbers)), F.array(F.lit(EOS).cast("long")))


def decoded(ids, levels: int = 256) -> Column:
    """The commands of token numbers up to the first EOS or PAD. A parameter out of its place ends its command's
    parameters, the rest of which are 0; numbers that belong to no command are passed over."""
    names, uses = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, KINDS.values()))

    def command(own: Column, at: Column) -> Column:
        kind = (F.get(own, at) - SPECIALS).cast("int")
        values = F.transform(F.slice(own, at + 2, F.get(uses, kind)), lambda v, j: v - _value_number(kind, j, levels))
        odd = lambda v: F.array_position(F.transform(v, lambda x: (x >= 0) & (x < levels)), False).cast("int")
        fine = _once(values, lambda v: _once(odd(v), lambda k: F.when(k > 0, F.slice(v, 1, k - 1)).otherwise(v)))
        return F.struct(F.get(names, kind).alias("type"), _once(fine, lambda v: pad(v, WIDTH, F.lit(0).cast("long"))).alias("params"))

    def begins(own: Column) -> Column:
        return F.filter(F.transform(own, lambda x, i: F.when((x >= SPECIALS) & (x < _PARAMS), i)), lambda i: i.isNotNull())

    own = _once(c(ids), lambda a: F.when(F.get(a, F.lit(0)) == BOS, F.slice(a, 2, F.size(a))).otherwise(a))
    stop = lambda a: F.array_position(F.transform(a, lambda x: x.isin(PAD, EOS)), True).cast("int")
    own = _once(own, lambda a: _once(stop(a), lambda k: F.when(k > 0, F.slice(a, 1, k - 1)).otherwise(a)))
    return _once(own, lambda a: F.transform(begins(a), lambda at: command(a, at)))


def adaptive_level(unit, bits) -> Column:
    """The level of a value in [0, 1], clipped, among 2**bits; half to even."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), c(bits)) - 1
    return F.bround(F.least(F.greatest(c(unit), F.lit(0.0)), F.lit(1.0)) * top).cast("long")


def adaptive_value(level, bits) -> Column:
    return c(level) / (F.call_function("shiftleft", F.lit(1).cast("long"), c(bits)) - 1)
