import hashlib

import pytest
from pyspark.sql import functions as F

from lodemill.functions import text as tx
from lodemill.functions import vectors as vec


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


def test_md5_token_id(spark):
    want = int.from_bytes(hashlib.md5(b"FOO").digest()[:8], "little") % 50000
    assert one(spark, tx.md5_token_id(F.lit("FOO"), 50000)) == want == 1744


def test_simple_tokens_are_unicode(spark):
    assert one(spark, tx.simple_tokens(F.lit("Señor, 3 œufs!"))) == ["Señor", ",", "3", "œufs", "!"]


def test_statements_keep_quoted_semicolons(spark):
    text = "#1=A('x;y',#2); /* off; */ #2=B(\n1.0);"
    assert one(spark, tx.statements(F.lit(text))) == ["#1=A('x;y',#2)", "#2=B( 1.0)"]


def test_entity(spark):
    r = one(spark, tx.parse_entity(F.lit("#12 = Face_Bound('a', (#3,#4), .T.);")))
    assert (r["id"], r["type"], r["refs"]) == (12, "FACE_BOUND", [3, 4])
    assert one(spark, tx.parse_entity(F.lit("no entity")))["id"] is None


@pytest.mark.parametrize("text,want", [("Q: what is it", "what is it?"), ("3. How long?", "3. How long?"), ("plain text.", "plain text.?"), ("", None), ("short", None), (" question: generated QUESTION:  why so long\n", "why so long?")])
def test_clean_question(spark, text, want):
    assert one(spark, tx.clean_question(F.lit(text))) == want


def test_clean_answer(spark):
    assert one(spark, tx.clean_answer(F.lit(" Answer: A: Based on the context, it is. "))) == "it is."
    assert one(spark, tx.clean_answer(F.lit(None).cast("string"))) == ""


def test_critique_fields(spark):
    for text, want in [("RATING: about 4", (4, None, None)), ("rating: -3\nEVALUATION:\n a\n\n b", (3, "\na\nb", None)), ("SUGGESTIONS: x\ny\nRATING: 0", (1, None, "x\ny")), ("no field\nRATING: none", (None, None, None))]:
        r = one(spark, tx.parse_critique(F.lit(text)))
        assert (r["rating"], r["evaluation"], r["suggestions"]) == want


def test_step_tokens(spark):
    text = "#1=CARTESIAN_POINT('a',(-1.5E-3,+2.,.T.),$,*);[CLS] .B2."
    assert one(spark, tx.step_tokens(F.lit(text))) == ["#1", "=", "CARTESIAN_POINT", "(", "'a'", ",", "(", "-1.5E-3", ",", "2.", ",", ".T.", ")", ",", "$", ",", "*", ")", ";", "[CLS]", "B2"]


def test_ids_to_text(spark):
    vocab = F.create_map(F.lit("A"), F.lit(5).cast("long"), F.lit("="), F.lit(6).cast("long"))
    ids = tx.encode_tokens(F.array(F.lit("A"), F.lit("="), F.lit("zz")), vocab, 4)
    assert one(spark, tx.decode_tokens(ids, vocab)) == "A = <UNK>"


def test_stable_hash_and_floats(spark):
    import hashlib

    want = int.from_bytes(hashlib.blake2b(b"face", digest_size=8).digest(), "big")
    assert int(one(spark, tx.stable_hash(F.lit("face")))) == want and one(spark, tx.stable_hash(F.lit("face"), 1000)) == want % 1000
    assert one(spark, tx.normal_floats(F.lit("(1.50000,2.,-3.14159265,.5E-9,7)"))) == "(1.5,2.0,-3.14159,5e-10,7)"


def test_code_hashes(spark):
    import hashlib

    r = one(spark, tx.code_hashes(F.lit("f"), F.array(F.lit("a"), F.lit("b")), F.lit("\n".join(map(str, range(20))))))
    assert r["sig_hash"] == hashlib.md5(b"f(a, b)").hexdigest()[:8] and r["body_hash"] == hashlib.md5("\n".join(map(str, range(10))).encode()).hexdigest()[:8]


def test_critique(spark):
    r = one(spark, tx.parse_critique(F.lit("RATING: 9\nEVALUATION: fine\nreally\nSUGGESTIONS: none")))
    assert (r["rating"], r["evaluation"], r["suggestions"]) == (5, "fine\nreally", None)


def test_banned_next(spark):
    assert one(spark, tx.banned_next(F.array(*map(F.lit, "abcabdab")), 3)) == ["c", "d"]
    assert one(spark, tx.banned_next(F.array(F.lit("a")), 3)) == []


def test_windows(spark):
    assert one(spark, tx.split_windows(F.array(*map(F.lit, "abcde")), 3, 1)) == [["a", "b", "c"], ["c", "d", "e"]]
    with pytest.raises(ValueError):
        tx.split_windows(F.array(F.lit(1)), 2, 2)


def test_frame_ids_can_cut_sep(spark):
    ids = F.array(*(F.lit(i).cast("long") for i in (7, 8, 9)))
    assert one(spark, tx.frame_ids(ids, 4, 1, 2)) == [1, 7, 8, 9]
    assert one(spark, tx.frame_ids(ids, 6, 1, 2)) == [1, 7, 8, 9, 2, 0]


def test_half_to_even(spark):
    got = [one(spark, vec.quantize(F.lit(x), F.lit(0.0), F.lit(5.0), 6)) for x in (0.5, 1.5, 2.5, 9.0, -1.0)]
    assert got == [0, 2, 2, 5, 0]
    assert one(spark, vec.quantize(F.lit(3.0), F.lit(3.0), F.lit(3.0), 6)) == 0


def test_vectors(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vec.cosine(z, a)) == 0.0
    assert one(spark, vec.normalised(a)) == [0.6, 0.8]
    assert one(spark, vec.pack_edge(F.lit(3), F.lit(5))) == (3 << 16) | 5
    assert one(spark, vec.next_labels(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))) == [2, -100]


def test_triangle(spark):
    p, q, r = ([F.lit(float(x)) for x in c] for c in ((0, 0, 0), (2, 0, 0), (0, 2, 0)))
    t = spark.range(1).select(*(v.alias(k) for k, v in vec.triangle(p, q, r).items())).first()
    assert t["area"] == 2.0 and t["normal"] == [0.0, 0.0, 1.0] and t["edges"][0] == 2.0


def test_box_iou(spark):
    a, b = ([F.lit(float(x)) for x in c] for c in ((0, 0, 2, 2), (1, 1, 3, 3)))
    assert abs(one(spark, vec.box_iou(a, b)) - 1 / 7) < 1e-12
