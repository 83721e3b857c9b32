"""Readers and writers for exchange-structure (STEP), mesh, point-cloud, TAR and line formats.

All read through Spark's own file sources (``text``, ``csv``, ``binaryFile``, ``json``), so any file
system Spark reads will do; binary formats are decoded by Arrow functions, a file at a time.
"""

from __future__ import annotations

import io
import re
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Format by file extension: fixed values.
EXTENSIONS = {
    "step": "step", "stp": "step", "stl": "stl", "iges": "iges", "igs": "iges", "brep": "brep", "obj": "obj", "ply": "ply",
    "pcd": "pcd", "xyz": "xyz", "dxf": "dxf", "pdf": "pdf", "off": "off", "glb": "glb", "las": "las", "laz": "laz", "parquet": "parquet", "json": "json", "jsonl": "jsonl",
}


def detect_format(path: Column, content: Column) -> Column:
    """The format by the path's extension, else by the first bytes of the content, else ``unknown``."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    sniffed = F.when(head.contains("ISO-10303-21"), "step").when(head.startswith("solid"), "stl").when(head.startswith("ply"), "ply").when(head.startswith("%PDF"), "pdf").when(head.contains("# .PCD"), "pcd").when(head.contains("DBRep_DrawableShape"), "brep")
    return F.coalesce(F.try_element_at(known, ext), sniffed, F.lit("unknown"))


# ------------------------------------------------------------------------------------------- STEP


def step_entities(files: DataFrame, key: str = "path", content: str = "value") -> DataFrame:
    """key, pos, id, type, params, refs of every entity of exchange-structure texts; complex instances and
    statements that are no entity are left out."""
    data = F.regexp_extract(F.col(content), r"(?s)\bDATA\s*;(.*?)\bENDSEC\s*;", 1)
    body = F.when(data != "", data).otherwise(F.col(content))
    rows = files.select(key, F.posexplode(tx.statements(body)).alias("pos", "statement"))
    parsed = rows.select(key, "pos", tx.parse_entity("statement").alias("e")).where("e.id is not null")
    return parsed.select(key, "pos", "e.id", "e.type", "e.params", "e.refs")


def step_header(files: DataFrame, key: str = "path", content: str = "value") -> DataFrame:
    """key, description, name and schema of the header section (null where absent)."""
    part = lambda tag: F.nullif(F.regexp_extract(F.col(content), rf"(?s)\b{tag}\s*\(\s*\(?\s*'((?:[^']|'')*)'", 1), F.lit(""))
    return files.select(key, part("FILE_DESCRIPTION").alias("description"), part("FILE_NAME").alias("name"), part("FILE_SCHEMA").alias("schema"))


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the STEP files under ``path``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return step_entities(files)


# ------------------------------------------------------------------------------- meshes and clouds

_FACETS = "path string, facet long, normal array<double>, v0 array<double>, v1 array<double>, v2 array<double>"


def parse_stl(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(normals [n, 3], vertices [n, 3, 3]) of an ASCII or binary STL; a cut-off file gives its whole facets."""
    n = int.from_bytes(raw[80:84], "little") if len(raw) >= 84 else 0
    if len(raw) >= 84 and (84 + 50 * n == len(raw) or not raw.lstrip()[:5].lower() == b"solid"):
        n = min(n, (len(raw) - 84) // 50)
        rec = np.frombuffer(raw, np.dtype([("f", "<f4", 12), ("a", "<u2")]), n, 84)["f"].astype(np.float64).reshape(n, 4, 3)
        return rec[:, 0], rec[:, 1:]
    number = rb"([-+0-9.eE]+)"
    facet = re.compile(rb"facet\s+normal\s+" + rb"\s+".join([number] * 3) + rb"\s+outer\s+loop" + (rb"\s+vertex\s+" + rb"\s+".join([number] * 3)) * 3)
    rows = np.array([[float(x) for x in m.groups()] for m in facet.finditer(raw)]).reshape(-1, 4, 3)
    return rows[:, 0], rows[:, 1:]


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """path, facet, normal, v0, v1, v2 of the STL files under ``path``."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                normal, v = parse_stl(raw.as_py())
                cols = [normal, v[:, 0], v[:, 1], v[:, 2]] if len(v) else [np.zeros((0, 3))] * 4
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), 3).cast(pa.list_(pa.float64())) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v))), *lists], ["path", "facet", "normal", "v0", "v1", "v2"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _FACETS)


def parse_cloud(raw: bytes, kind: str) -> np.ndarray:
    """Coordinates [n, 3] of an ASCII XYZ, PLY or PCD cloud, or a little-endian binary PLY of floats."""
    if kind == "xyz":
        start = 0
    else:
        mark = b"end_header" if kind == "ply" else b"DATA"
        start = raw.index(b"\n", raw.index(mark)) + 1
        head = raw[:start].decode("ascii", "replace")
        if kind == "ply" and "binary_little_endian" in head:
            count = int(re.search(r"element vertex (\d+)", head)[1])
            vertex = head[head.index("element vertex") :].split("element", 2)[1]
            size = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "int": "<i4", "int32": "<i4", "short": "<i2", "ushort": "<u2", "char": "i1", "uint": "<u4"}
            kinds = np.dtype([(m[1], size[m[0]]) for m in re.findall(r"property (\w+) (\w+)", vertex)])
            rec = np.frombuffer(raw, kinds, count, start)
            return np.column_stack([rec[a] for a in "xyz"]).astype(np.float64)
        if "binary" in head:
            raise ValueError(f"binary {kind} of this kind is not supported")
        found = re.search(r"element vertex (\d+)", head) or re.search(r"POINTS (\d+)", head)
        lines = raw[start:].split(b"\n")[: int(found[1])] if found else raw[start:].split(b"\n")
        raw, start = b"\n".join(lines), 0
    rows = [line.split()[:3] for line in raw[start:].splitlines() if line.strip() and not line.lstrip().startswith(b"#")]
    return np.array([[float(x) for x in r] for r in rows if len(r) == 3]).reshape(-1, 3)


def read_points(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, point, x, y, z of point clouds; XYZ text goes through Spark's text source and splits."""
    if kind == "xyz":
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"[\s,]+").alias("c")).where((F.size("c") >= 3) & ~F.col("c")[0].startswith("#"))
        return rows.select("path", F.monotonically_increasing_id().alias("point"), *(F.col("c")[i].cast("double").alias(a) for i, a in enumerate("xyz")))

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = parse_cloud(raw.as_py(), kind)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), pa.array(np.arange(len(p))), *(pa.array(p[:, i]) for i in range(3))], ["path", "point", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, point long, x double, y double, z double")


def write_xyz(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz")).alias("value")).write.text(path)


# --------------------------------------------------------------------------------------- archives


def read_tar(spark: SparkSession, path: str, keep: tuple[str, ...] = ("step", "stp")) -> DataFrame:
    """shard, key, ext, content, meta of TAR shards: a sample is a member with a kept extension, and the
    JSON sidecar of the same stem (null if absent or broken)."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                files, side = {}, {}
                with tarfile.open(fileobj=io.BytesIO(raw.as_py())) as tar:
                    for m in tar:
                        stem, _, ext = m.name.rpartition(".")
                        if m.isfile() and ext.lower() in keep:
                            files[stem] = (ext.lower(), tar.extractfile(m).read())
                        elif m.isfile() and ext.lower() == "json":
                            side[stem] = tar.extractfile(m).read().decode("utf-8", "replace")
                rows = [(name, k, e, c, side.get(k)) for k, (e, c) in files.items()]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))], ["shard", "key", "ext", "content", "meta"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "shard string, key string, ext string, content binary, meta string")
    return out.withColumn("meta", F.when(F.try_parse_json("meta").isNotNull(), F.col("meta")))


def tar_shards(samples: DataFrame, per_shard: int) -> DataFrame:
    """(shard, content): TAR files of ``per_shard`` samples (key, ext, content, meta) in order of key."""
    n = F.row_number().over(Window.partitionBy("_p").orderBy("key")) - 1
    ranged = samples.repartitionByRange("key").withColumn("_p", F.spark_partition_id())
    numbered = ranged.withColumn("_s", F.floor(n / per_shard))

    def run(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in sorted(table.to_pylist(), key=lambda r: r["key"]):
                for ext, raw in ((r["ext"], r["content"]), ("json", r["meta"].encode() if r["meta"] else None)):
                    if raw is not None:
                        info = tarfile.TarInfo(f"{r['key']}.{ext}")
                        info.size = len(raw)
                        tar.addfile(info, io.BytesIO(raw))
        p, s = table.column("_p")[0].as_py(), table.column("_s")[0].as_py()
        return pa.table({"shard": [f"{p:05d}-{s:05d}"], "content": pa.array([out.getvalue()], pa.binary())})

    return numbered.groupBy("_p", "_s").applyInArrow(run, "shard string, content binary")


# ------------------------------------------------------------------------------------- lines, export


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of zstd Parquet for each split."""
    df.write.partitionBy(split).option("compression", "zstd").parquet(path)


def export_pairs(df: DataFrame, tokens: str, levels: list[str]) -> DataFrame:
    """Rows with tokens and a text at some level: training pairs."""
    text = F.coalesce(*(F.nullif(F.trim(F.col(x)), F.lit("")) for x in levels))
    return df.where((F.size(tokens) > 0) & text.isNotNull()).withColumn("text", text)


def serialize_chunks(chunks: DataFrame, style: str, key: str = "doc_id", order: str = "chunk", text: str = "text") -> DataFrame:
    """key, output: the chunks of each document, in order, as json, jsonl, markdown or html."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("chunk"), F.col(text).alias("text")))).alias("c"))
    one = {
        "json": F.to_json(F.struct(F.size("c").alias("total_chunks"), F.col("c").alias("chunks"))),
        "jsonl": F.array_join(F.transform("c", lambda s: F.to_json(s)), "\n"),
        "markdown": F.array_join(F.transform("c", lambda s: F.concat(F.lit("## Chunk "), s["chunk"].cast("string"), F.lit("\n\n"), s["text"], F.lit("\n"))), "\n"),
        "html": F.concat(F.lit("<html><body>"), F.array_join(F.transform("c", lambda s: F.concat(F.lit('<div class="chunk" id="chunk-'), s["chunk"].cast("string"), F.lit('"><pre>'), F.replace(F.replace(F.replace(s["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</pre></div>"))), ""), F.lit("</body></html>")),
    }
    if style not in one:
        raise ValueError(f"style is one of {', '.join(one)}")
    return rows.select(key, one[style].alias("output"))


