"""Column functions on text: tokenization, hashing, parsing, clean-up. All run in the JVM."""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

#: Words, or single signs that are neither word characters nor white space.
SIMPLE_TOKEN = r"(?U)\w+|[^\w\s]"
#: Tokens of exchange-structure text, first alternative first: fixed values.
STEP_TOKEN = r"\[/?[A-Z]+\]|#\d+|[A-Z_][A-Z0-9_]*|-?\d+\.?\d*(?:[Ee][+-]?\d+)?|\.[A-Z_]+\.|'[^']*'|[=(),;]|\$|\*"
ENTITY = r"(?s)^\s*#(\d+)\s*=\s*([A-Za-z_][A-Za-z_0-9]*)\s*\((.*)\)\s*;?\s*$"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_tokens(text) -> Column:
    return F.regexp_extract_all(c(text), F.lit(SIMPLE_TOKEN), F.lit(0))


def token_count(text) -> Column:
    return F.regexp_count(c(text), F.lit(SIMPLE_TOKEN))


def step_tokens(text) -> Column:
    return F.regexp_extract_all(c(text), F.lit(STEP_TOKEN), F.lit(0))


def md5_token_id(token, vocab_size: int) -> Column:
    """The first 8 bytes of the MD5 as a little-endian number, modulo the vocabulary size."""
    h = F.md5(c(token).cast("binary"))
    turned = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(vocab_size).cast("decimal(20,0)")).cast("long")


def encode_tokens(tokens, vocab: Column, vocab_size: int) -> Column:
    """Ids of an array of tokens: from the map ``vocab`` where known, else hashed."""
    return F.transform(c(tokens), lambda t: F.coalesce(F.try_element_at(vocab, t), md5_token_id(t, vocab_size)))


def decode_tokens(ids, vocab: Column, unknown: str = "<UNK>") -> Column:
    """Tokens of an array of ids, from the inverse of the map ``vocab``, with blanks between."""
    back = F.map_from_entries(F.transform(F.map_entries(vocab), lambda e: F.struct(e["value"], e["key"])))
    return F.array_join(F.transform(c(ids), lambda i: F.coalesce(F.try_element_at(back, i), F.lit(unknown))), " ")


def stable_hash(value, modulo: int | None = None) -> Column:
    """The 64-bit BLAKE2b of a text as a big-endian number, or its remainder."""

    @F.pandas_udf(DecimalType(20, 0))
    def blake(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else Decimal(int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big")))

    h = blake(c(value))
    return h if modulo is None else (h % F.lit(modulo).cast("decimal(20,0)")).cast("long")


FLOAT = r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?"


def normal_floats(text, precision: int = 6) -> Column:
    """A text with its decimal numbers at ``precision`` significant digits, without trailing zeros but with a point."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(m):
            out = f"{float(m[0]):.{precision}g}"
            return out if "." in out or "e" in out else out + ".0"

        return values.map(lambda v: None if v is None else re.sub(FLOAT, one, v))

    return run(c(text))


def frame_ids(ids, length: int, cls_id: int, sep_id: int, pad_id: int = 0) -> Column:
    """CLS + ids + SEP, cut to ``length`` (which may cut SEP) and padded."""
    full = F.slice(F.concat(F.array(F.lit(cls_id).cast("long")), c(ids), F.array(F.lit(sep_id).cast("long"))), 1, length)
    return F.concat(full, F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - F.size(full)))


def attention_mask(ids, pad_id: int = 0) -> Column:
    return F.transform(c(ids), lambda x: (x != pad_id).cast("int"))


def strip_comments(text) -> Column:
    return F.regexp_replace(c(text), r"(?s)/\*.*?\*/", "")


def references(text) -> Column:
    """All ``#n`` references as longs, in order."""
    return F.transform(F.regexp_extract_all(c(text), F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def parse_entity(line) -> Column:
    """struct(id, type, params, refs) of one ``#id = TYPE(params);`` statement; nulls if it is none."""
    line, ok = c(line), c(line).rlike(ENTITY)
    part = lambda i: F.when(ok, F.regexp_extract(line, ENTITY, i))
    return F.struct(part(1).cast("long").alias("id"), F.upper(part(2)).alias("type"), part(3).alias("params"), F.when(ok, references(part(3))).alias("refs"))


def statements(text) -> Column:
    """Statements of an exchange-structure text: split at semicolons outside quotes, white space collapsed."""
    found = F.regexp_extract_all(strip_comments(text), F.lit(r"(?s)((?:[^;']|'(?:[^']|'')*')+);"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def normal_value(value) -> Column:
    """Lower case, trimmed, without spaces, dashes and underscores."""
    return F.translate(F.lower(F.trim(c(value))), " -_", "")


#: Prefixes that a generated question or answer loses, one after the other: fixed values.
QUESTION_PREFIXES = ("Question:", "Q:", "Here is a question:", "Generated question:")
ANSWER_PREFIXES = ("Answer:", "A:", "Here is the answer:", "Generated answer:", "Based on the context,", "According to the CAD data,")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _without(text: Column, prefixes: tuple[str, ...]) -> Column:
    """``text`` stripped, without each of ``prefixes`` in turn, whatever their case."""
    out = _stripped(text)
    for p in prefixes:
        out = F.regexp_replace(out, rf"(?is)^{re.escape(p)}\s*", "")
    return out


def clean_question(text) -> Column:
    """Without the usual prefixes, with a question mark at the end; null below 10 characters."""
    t = _without(c(text), QUESTION_PREFIXES)
    t = F.when(t.endswith("?") | (t == ""), t).otherwise(F.concat(t, F.lit("?")))
    return F.when(F.length(t) >= 10, t)


def clean_answer(text) -> Column:
    """Without the usual prefixes; a null answer is empty."""
    return F.coalesce(_without(c(text), ANSWER_PREFIXES), F.lit(""))


def parse_critique(text) -> Column:
    """struct(rating 1..5, evaluation, suggestions) of a reply with the fields RATING, EVALUATION, SUGGESTIONS.

    A field starts a line and the last of a name counts; the rating is the first digits of its line; the
    others go on over the non-empty lines that follow. Suggestions "none", "n/a" and "-" are null.
    """
    lines = F.filter(F.transform(F.split(_stripped(c(text)), "\n"), _stripped), lambda x: x != "")
    start = F.struct(F.lit(None).cast("int").alias("rating"), F.lit(None).cast("string").alias("evaluation"), F.lit(None).cast("string").alias("suggestions"), F.lit("").alias("field"))

    def step(s, line):
        name = F.upper(F.regexp_extract(line, r"(?i)^(RATING|EVALUATION|SUGGESTIONS):", 1))
        rest = _stripped(F.regexp_replace(line, r"(?s)^[^:]*:", ""))
        number = F.regexp_extract(rest, r"[0-9]+", 0)
        rating = F.when((name == "RATING") & (number != ""), F.least(F.greatest(number.try_cast("decimal(38,0)"), F.lit(1)), F.lit(5)).cast("int")).otherwise(s["rating"])
        evaluation = F.when(name == "EVALUATION", rest).when((name == "") & (s["field"] == "EVALUATION"), F.concat(F.coalesce(s["evaluation"], F.lit("")), F.lit("\n"), line)).otherwise(s["evaluation"])
        hints = F.when(name == "SUGGESTIONS", F.when(~F.lower(rest).isin("none", "n/a", "-"), rest)).when((name == "") & (s["field"] == "SUGGESTIONS"), F.concat(s["suggestions"], F.lit("\n"), line)).otherwise(s["suggestions"])
        return F.struct(rating.alias("rating"), evaluation.alias("evaluation"), hints.alias("suggestions"), F.when(name == "", s["field"]).otherwise(name).alias("field"))

    return F.aggregate(lines, start, step, lambda s: F.struct(s["rating"], s["evaluation"], s["suggestions"]))


def code_hashes(name, args, body) -> Column:
    """struct(sig_hash, body_hash): the first 8 digits of the MD5 of ``name(arg, arg)`` and of the body's first 10 lines."""
    signature = F.concat(c(name), F.lit("("), F.array_join(c(args), ", "), F.lit(")"))
    first = F.array_join(F.slice(F.split(c(body), "\n"), 1, 10), "\n")
    return F.struct(*(F.substring(F.md5(x.cast("binary")), 1, 8).alias(n) for n, x in (("sig_hash", signature), ("body_hash", first))))


def hashed_embedding(text, dims: int = 64) -> Column:
    """Hashed words of the text, one dimension each for up to ``dims``, scaled to norm 1 (0 stays 0)."""
    words = F.slice(F.filter(F.split(c(text), r"\s+"), lambda w: w != ""), 1, dims)
    value = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) - 0.5)
    full = F.concat(value, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(value)))
    norm = F.sqrt(F.aggregate(full, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(full, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def banned_next(tokens, n: int) -> Column:
    """Tokens that followed an earlier occurrence of the last n-1 tokens (no n-gram may repeat)."""
    t = c(tokens)
    size = F.size(t)
    last = F.slice(t, F.greatest(size - (n - 2), F.lit(1)), n - 1)
    at = F.filter(F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(t, i, n - 1) == last)
    return F.array_sort(F.array_distinct(F.transform(at, lambda i: F.element_at(t, i + n - 1))))


def split_windows(tokens, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` tokens, each starting ``size - overlap`` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    t = c(tokens)
    starts = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.greatest(F.size(t) - overlap, F.lit(1)), F.lit(size - overlap)))
    return F.transform(starts, lambda i: F.slice(t, i, size))
