import io
import struct
import tarfile

from pyspark.sql import functions as F

from lodemill.sources import files
from lodemill.streaming import streams

STEP = """ISO-10303-21;
HEADER; FILE_DESCRIPTION(('a part'),'2;1'); FILE_NAME('p.stp','',(''),(''),'','',''); FILE_SCHEMA(('AP214')); ENDSEC;
DATA;
#1=SOLID('a;b',#2); #2 = SHELL((#3,#4)); /* #9=NO(); */
#3=FACE(#4,#99);
#4=FACE();
ENDSEC; END-ISO-10303-21;"""


def test_step(spark, tmp_path):
    (tmp_path / "p.stp").write_text(STEP)
    rows = {r["id"]: r for r in files.read_step(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["refs"] == [2] and rows[3]["refs"] == [4, 99] and rows[4]["params"] == ""
    head = files.step_header(spark.createDataFrame([("p", STEP)], "path string, value string")).first()
    assert (head["description"], head["name"], head["schema"]) == ("a part", "p.stp", "AP214")


def test_stl(spark, tmp_path):
    tri = [0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0]
    (tmp_path / "b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12f", *tri) + b"\0\0")
    (tmp_path / "a.stl").write_text("solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid")
    rows = files.read_stl(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r["normal"] == [0, 0, 1] and r["v1"] == [1, 0, 0] for r in rows)


def test_points(spark, tmp_path):
    (tmp_path / "c.xyz").write_text("# c\n0 0 1\n1 2 3 9\n\nbad\n")
    assert sorted(r["z"] for r in files.read_points(spark, str(tmp_path / "c.xyz"), "xyz").collect()) == [1.0, 3.0]
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 1\n4 5 6\n")
    assert [r["x"] for r in files.read_points(spark, str(tmp_path / "c.ply"), "ply").orderBy("point").collect()] == [0.0, 4.0]


def test_tar_round_trip(spark, tmp_path):
    rows = [(f"k{i:02d}", "step", bytes([i]) * i, '{"n": 1}' if i % 2 else None) for i in range(7)]
    shards = files.tar_shards(spark.createDataFrame(rows, "key string, ext string, content binary, meta string").coalesce(1), 3).collect()
    for r in shards:
        (tmp_path / f"{r['shard']}.tar").write_bytes(bytes(r["content"]))
    back = sorted((r["key"], r["ext"], bytes(r["content"]), r["meta"]) for r in files.read_tar(spark, str(tmp_path)).collect())
    assert back == rows


def test_tar_skips_broken_sidecars(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, raw in (("a.STEP", b"x"), ("a.json", b"{broken"), ("b.txt", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    (tmp_path / "t.tar").write_bytes(out.getvalue())
    assert [tuple(r)[1:3] + (r["meta"],) for r in files.read_tar(spark, str(tmp_path)).collect()] == [("a", "step", None)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\n\n{broken\n{"q": "y"}\n')
    assert sorted(r["q"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "q string").collect()) == ["x", "y"]


def test_formats(spark):
    rows = spark.createDataFrame([("a/p.STP", b""), ("x", b"solid a"), ("x", b"\x00"), ("y.bin", b"ISO-10303-21;")], "p string, c binary")
    assert [r[0] for r in rows.select(files.detect_format(F.col("p"), F.col("c"))).collect()] == ["step", "stl", "unknown", "step"]


def test_serializers(spark):
    df = spark.createDataFrame([(1, 1, "b<"), (1, 0, "a")], "doc_id long, chunk int, text string")
    got = {s: files.serialize_chunks(df, s).first()["output"] for s in ("json", "jsonl", "markdown", "html")}
    assert got["jsonl"].split("\n")[0] == '{"chunk":0,"text":"a"}' and "b&lt;" in got["html"] and got["markdown"].startswith("## Chunk 0")


def test_stream_matches_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type", F.col("value").alias("v"), "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    s = streams.tumbling(streams.stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", "v", "1 day", "3650 days")
    streams.drain(s, "complete", lambda batch, n: seen.append({(r["start"], r["event_type"]): r["n"] for r in batch.collect()}), str(tmp_path / "ck"))
    assert seen[-1] == {(r["start"], r["event_type"]): r["n"] for r in streams.tumbling(events, "ts", "event_type", "v", "1 day").collect()}


def test_stateful_bans(spark, tmp_path):
    rows = spark.createDataFrame([("k", t) for t in "abcab"], "key string, token string").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    s = streams.ngram_bans(streams.stream(spark, str(tmp_path / "in"), rows.schema), "key", "token", 3)
    streams.drain(s, "append", lambda batch, n: got.extend((r["position"], r["banned"]) for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(got)[-1] == (4, ["c"])
