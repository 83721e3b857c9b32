"""WARC archives: a deduplicating writer, and a reader that salvages what surrounds damage.

The writer sends each record, a gzip member of its own, through Spark's text writer, so archives land
on any file system Spark writes to and under its commit protocol; one NUL stands between members, as
padding that gzip readers skip. Rows of the writer hold about a MiB, longer ones are followed by rows
of padding alone, so files are bounded by bytes: ``file_bytes`` and one record. Records with equal
payloads of at least ``min_bytes`` bytes become revisits of the one with the smallest page_id.

The reader walks each archive. A record counts if its version line, headers and length agree, its
block is followed by the record end, and its payload digest (where given) matches. Members are
inflated a slice at a time and hand over every record as soon as it is whole, so records before the
damage in a member are kept. After a failed check it searches the inflated bytes for the next version
line, or the archive for the next gzip member or version line, from which a whole record passes, goes
on from there, and reports the bytes between as a gap row with the reason. A gap inside a member that
inflates names its inflated bytes in the reason; its offset and length are the member's.

Defined results: a null html is an empty payload and a null url gives a record without target; rows
that share a page_id and payload are all responses if that is the smallest page_id; a null page_id is
written without one and never referred to; an empty table makes an archive without records; other
columns are not read. Heads and urls may have any length; fields other than those that describe the
record may repeat and are joined by commas.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, ship
from .token_files import delete_at_exit

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_END = b"\r\n\r\n"
_ID = "<urn:page:%d>"
#: Bytes of a row sent to the writer, and compressed bytes inflated at a time.
ROW, SLICE = 1 << 20, 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, sha: bytes | None = None) -> bytes:
    """One WARC/1.1 record, without the blank lines that end it. Revisits hold no payload.

    ``sha`` is the payload's SHA-1, where it is known.
    """
    digest = base64.b32encode(sha).decode() if sha else payload_digest(payload)
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Date: {date}"]
    head.append("WARC-Record-ID: " + (_ID % page_id if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"))
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    block = _HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_ID % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0, gzip_level: int | None = 4, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of ``pages`` (page_id, url, html); ``gzip_level`` None leaves them uncompressed."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    first = rows.where(large).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    rows = rows.join(first, "sha", "left").select("page_id", "url", "payload", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"), F.unhex("sha").alias("sha"))
    between = _END if gzip_level is None else b"\0"

    def run(batches):
        for batch in batches:
            out, held, size = [], [], 0
            for i in range(batch.num_rows):
                page_id, url, payload, to, sha = (c[i].as_py() for c in batch.columns)
                record = build_record(page_id, url, payload, to, date, sha)
                if gzip_level is not None:
                    z = zlib.compressobj(gzip_level, zlib.DEFLATED, 31)
                    record = z.compress(record + _END) + z.flush()
                if held and size + len(record) > ROW:
                    out.append(between.join(held))
                    held, size = [], 0
                if len(record) > ROW:  # rows of padding stand for its weight
                    out += [record, *[b""] * (len(record) // ROW)]
                else:
                    held.append(record)
                    size += len(record)
            if held:
                out.append(between.join(held))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = lines.write.mode("error").option("maxRecordsPerFile", max(1, file_bytes // ROW))
    writer.option("lineSep", between.decode()).text(path)


# ----------------------------------------------------------------------------------------- reading


class Damaged(Exception):
    pass


class More(Exception):
    """A record may stand here, but ``size`` bytes of the buffer are not enough to tell."""

    def __init__(self, size: int):
        self.size = size


def _head(lines: list[bytes]) -> dict[str, str]:
    head: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        name, value = name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")
        if name not in head:
            head[name] = value
        elif name.startswith(("warc-", "content-")) and name != "warc-concurrent-to":
            if head[name] != value:
                raise Damaged("a header that stands twice")  # two records' heads run into one
        else:
            head[name] += f", {value}"
    return head


class Buffer:
    """Bytes at hand, from which records are parsed; it remembers where the last search for a head's end led."""

    def __init__(self, data: bytes | bytearray, whole: bool):
        self.data, self.whole = data, whole  # whole: no more will come
        self.searched, self.found = -1, -1

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.searched, self.found = -1, -1

    def _end_of_head(self, at: int) -> int:
        if not (0 <= self.searched <= at and (self.found >= at or (self.found < 0 and self.whole))):
            self.searched, self.found = at, self.data.find(_END, at)
        return self.found

    def record(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """(headers with lower-case names, payload, end) of the record at ``at``; raises Damaged, or More
        where the bytes at hand do not decide."""
        data = self.data
        if data[at : at + 7] != b"WARC/1."[: len(data) - at if not self.whole else 7]:
            raise Damaged("no version line")
        body = self._end_of_head(at)
        if body < 0:
            if self.whole:
                raise Damaged("headers do not end")
            raise More(2 * (len(data) - at) + 1)
        if data.find(b"\nWARC/1.", at + 7, body) >= 0:
            raise Damaged("a version line among the headers")
        head = _head(bytes(data[at:body]).split(b"\r\n")[1:])
        if not re.fullmatch(r"[0-9]{1,10}", head.get("content-length", "")):
            raise Damaged("no content length")
        body += 4
        end = body + int(head["content-length"])
        if end - at >= 1 << 31:
            raise Damaged("longer than a row can be")
        if len(data) < end + 4 and not self.whole:
            raise More(end + 4 - at)
        if data[end : end + 4] != _END:
            raise Damaged("the block does not end where its length says")
        block = bytes(data[body:end])
        payload = block
        if head.get("content-type", "").startswith("application/http"):
            _, blank, payload = block.partition(_END)
            if not blank:
                raise Damaged("an HTTP head that does not end")
        digest = head.get("warc-payload-digest", "")
        if digest.startswith("sha1:") and head.get("warc-type") != "revisit" and digest[5:].upper() != payload_digest(payload):
            raise Damaged("payload digest")
        return head, payload, end + 4


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with lower-case names, payload, end) of the record at ``at``."""
    return Buffer(data, True).record(at)


_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")
_PADDING = re.compile(rb"[\0\r\n]*")


class Member:
    """The gzip member at ``at`` of an archive; iterating gives (headers, payload, None) of its records and
    (None, None, reason) of what is damaged inside; ``end`` is then where it ends, None if it breaks off."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data, at, None

    def _slices(self):
        z, i = zlib.decompressobj(31), self.at
        while not z.eof:
            part = z.unconsumed_tail or self.data[i : i + SLICE]
            if not z.unconsumed_tail:
                i += len(part)
            try:
                plain = z.decompress(part, 16 * SLICE)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if not part and not plain:
                raise Damaged("gzip: the member does not end")
            yield plain
        self.end = i - len(z.unused_data)

    def __iter__(self):
        buffer, slices, before, broken = Buffer(bytearray(), False), self._slices(), 0, None
        at, bad, want = 0, None, 1  # place in the buffer, (start, reason) of damage, bytes needed from there
        while True:
            while not buffer.whole and len(buffer.data) - at < want:
                if at > 16 * SLICE or at == len(buffer.data):
                    buffer.drop(at)
                    before, at = before + at, 0
                try:
                    buffer.data += next(slices)
                except StopIteration:
                    buffer.whole = True
                except Damaged as e:
                    buffer.whole, broken = True, str(e)
            want = 1
            if not bad:
                at = _PADDING.match(buffer.data, at).end()
            if at >= len(buffer.data):
                if buffer.whole:
                    break
                continue
            try:
                head, payload, end = buffer.record(at)
            except More as m:
                want = m.size
                continue
            except Damaged as e:
                bad = bad or (before + at, str(e))
                hit = _VERSION.search(buffer.data, at + 1)
                if hit:
                    at = hit.start()
                elif buffer.whole:
                    break
                else:  # a version line may lie over the edge
                    at, want = max(at + 1, len(buffer.data) - 9), 10
                continue
            if bad:
                yield None, None, f"{bad[1]} (inflated bytes {bad[0]} to {before + at})"
                bad = None
            yield head, payload, None
            at = end
        if broken:
            yield None, None, broken
        elif bad:
            yield None, None, f"{bad[1]} (inflated bytes {bad[0]} to {before + len(buffer.data)})"


def salvage(data: bytes):
    """(offset, end, headers, payload, None) of each record, and (offset, end, None, None, reason) of each gap.

    The end of a record in a member that breaks off or holds several is None.
    """
    plain = Buffer(data, True)
    at = _PADDING.match(data, 0).end()
    gap: tuple[int, str] | None = None  # start of damage that no good record has followed yet, and why
    while at < len(data):
        start, reason, end = at, "", None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            member, last, several, broken = Member(data, at), None, False, []
            for head, payload, why in member:
                if head is None:
                    broken.append(why)
                    continue
                if gap:
                    yield gap[0], start, None, None, gap[1]
                    gap = None
                if last:
                    several = True
                    yield start, None, *last, None
                last = head, payload
            end = member.end
            if last:
                yield start, None if several else end, *last, None
            if last and end is not None:
                for why in broken:
                    yield start, end, None, None, why
            elif broken:
                reason, end = broken[0], None
        else:
            try:
                head, payload, end = plain.record(at)
                if gap:
                    yield gap[0], start, None, None, gap[1]
                    gap = None
                yield start, end, head, payload, None
            except Damaged as e:
                reason = str(e)
        if end is None:
            gap = gap or (start, reason)
            hit = _CANDIDATE.search(data, at + 1)
            at = hit.start() if hit else len(data)
        else:
            at = _PADDING.match(data, end).end()
    if gap:
        yield gap[0], len(data), None, None, gap[1]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record, and for each quarantined gap (``gap`` holds the reason).

    Columns: path, offset and length in the archive (null for records of members that hold several), gap, headers (lower-case names), payload_bytes and
    payload_digest of the full payload (revisits: as recorded), and the payload if asked for.
    """
    ship(spark)
    schema = "path string, offset long, length long, gap string, headers map<string,string>, payload_bytes long, payload_digest string" + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for at, end, head, body, reason in salvage(content.as_py()):
                    if reason is not None:
                        rows.append((name, at, end - at, reason, None, None, None, None))
                    else:
                        size, digest = len(body), None
                        if head.get("warc-type") == "revisit":
                            size = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None
                            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        else:
                            given = head.get("warc-payload-digest", "")  # checked, if it is a SHA-1
                            digest = given[5:].upper() if given.startswith("sha1:") else payload_digest(body)
                        rows.append((name, at, None if end is None else end - at, None, list(head.items()), size, digest, body if payload else None))
                        held += len(body)
                    if len(rows) >= 1000 or held > 16 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, schema)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read_warc(spark, path, payload=False).where("gap is null")

    def page(name: str):
        return F.regexp_extract(F.col("headers")[name], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return rows.select(page("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", F.col("headers")["warc-type"].alias("record_type"), page("warc-refers-to").alias("refers_to"))
