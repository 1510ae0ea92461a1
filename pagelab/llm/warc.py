"""WARC archives: a deduplicating writer and a salvage reader.

Writer: one record per page, each in a gzip member of its own, so archives can
be cut at any record. Of the records with equal payloads the one with the
largest page_id is a response, the others are revisits of it. Files are written
by Spark's own text writer (committed per task, on any file system Spark can
write): a member goes out as raw bytes, and its last byte, a zero, is the
writer's line separator. A file holds at most ``max_file_bytes`` of them (and the
record that passes it): records are written in classes of size, each with its own
number of records a file, since the writer closes files by rows.

Reader: archives are read as binary files. A record must pass its checks: gzip
CRC and size, version line, headers, block length, end mark, and SHA-1 digests
where given. After a failed check the reader looks for the next valid member or
version line, goes on from there, and reports the bytes between as a gap. The
content of a member is salvaged alike, record by record; records and gaps of a
member carry the byte range of the member, and the reason of a gap tells its place
in the content. Of a member that is cut or fails its own checks, the records that
came out whole are kept (with a block digest that agrees) and a gap tells what
failed. If such a member is not cut and holds one record with nothing else amiss,
the damage may be in that record's headers, and it is a gap.

Defined cases: null html is an empty payload; a null page_id is smaller than
any other; rows that share the largest page_id of a payload are all responses;
null URLs have no target line; other bytes than printable ASCII in a URL are
percent-encoded; an empty table writes no archive and reads no record; a file
of garbage is one gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.llm.common import checkpointed, small_batches

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           date: str = DATE) -> bytes:
    """One WARC record, not compressed. A revisit keeps the HTTP header only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % len(payload))
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}",
                 f"WARC-Refers-To: <urn:x-page:{'null' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as a gzip member that ends in a zero byte. The last byte of a member
    is the top byte of its size; from 16 MiB on an empty member follows."""
    def gz(x: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()
    out = gz(data)
    return out if out[-1] == 0 else out + gz(b"")


_CLASS = 1 << 18  # bytes of the smallest class; each next one is four times as wide
_OVER = 2_000  # bytes of a record beside its payload and URL, and what a member may add


def _size_class(payload: F.Column, url: F.Column) -> F.Column:
    """Class k holds records of up to _CLASS * 4**k bytes before compression."""
    size = F.octet_length(payload) + F.coalesce(3 * F.octet_length(url), F.lit(0)) + _OVER
    return F.greatest(F.ceil(F.log(4.0, size * 1.001 / _CLASS)), F.lit(0)).cast("int")


def write(pages: DataFrame, path: str, *, min_bytes: int = 0, records_per_file: int = 5_000,
          max_broadcast: int = 500_000, max_file_bytes: int = 1 << 30) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives below ``path``.

    Payloads of under ``min_bytes`` bytes are never revisits. Payload digests that
    occur more than once are found by one pre-aggregated shuffle of (digest, page_id);
    they are broadcast only below ``max_broadcast``."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = F.sha1("payload")
    top = checkpointed(rows.where(F.octet_length("payload") >= min_bytes).groupBy(key.alias("_d"))
                       .agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1")
                       .select("_d", "_top"))
    if top.count() <= max_broadcast:
        top = F.broadcast(top)
    met = rows.withColumn("_key", F.when(F.octet_length("payload") >= min_bytes, key))
    met = met.join(top, F.col("_key") == F.col("_d"), "left").select(
        "page_id", "url", "payload", "_top",
        (F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))).alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(small_batches(batches, "payload"), "url"):
            out = [member(record(i, u, p, t, r))[:-1] for i, u, p, t, r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    kind = _size_class(F.col("payload"), F.col("url"))
    found = rows.select(kind.alias("_k")).distinct().collect()  # a few classes: sizes grow fourfold
    for k in sorted(r["_k"] for r in found) or [0]:
        most = max(1, min(records_per_file, max_file_bytes // (_CLASS * 4 ** k)))
        (met.where(kind == k).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
         .write.mode("append").option("lineSep", "\x00").option("maxRecordsPerFile", most).text(path))


# -- salvage reader ------------------------------------------------------------
class Damaged(Exception):
    """A check failed."""


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|\r\nWARC/\d+\.\d+\r\n")
_STEP = 1 << 16


def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, block) of the record at ``at``."""
    m = _VERSION.match(data, at)
    if m is None:
        raise Damaged("no version line")
    # headers have no bound, but the next record's version line
    found = _HEAD_END.search(data, m.end() - 2)
    if found is None or found.end() != found.start() + 4:
        raise Damaged("headers do not end")
    stop = found.start()
    head: dict[str, str] = {}
    for line in data[m.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("broken header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not {"warc-type", "warc-record-id", "warc-date"} <= head.keys():
        raise Damaged("a named field is missing")
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no block length")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block length is wrong or the record is cut")
    block = data[begin:end]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != sha1_base32(block):
        raise Damaged("block digest differs")
    return end + 4, head, block


def _inflate(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """(end, content, failure) of the gzip member at ``at``; CRC and size are checked.
    After a failure the content is what came out before it."""
    z = zlib.decompressobj(31)
    out, pos, view = [], at, memoryview(data)
    while not z.eof:
        if pos >= len(data):
            return pos, b"".join(out), "gzip member is cut"
        part = view[pos:pos + _STEP]
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error:
            for k in range(len(part)):  # once more, up to the byte that fails
                try:
                    out.append(before.decompress(part[k:k + 1]))
                except zlib.error as e:
                    return pos + k, b"".join(out), f"gzip: {e}"
        pos += len(part)
    return pos - len(z.unused_data), b"".join(out), None


def _spans(content: bytes, strict: bool) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Where the valid records of a member's content begin, and the (begin, end, reason)
    of the bytes between. ``strict``: a record needs a block digest."""
    begins, holes = [], []
    at, n = 0, len(content)
    hole: tuple[int, str] | None = None
    while at < n:
        try:
            end, head, _ = _plain(content, at)
            if strict and not head.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no block digest in a damaged member")
        except Damaged as e:
            hole = hole or (at, str(e))
            at = content.find(b"WARC/", at + 1)
            at = n if at < 0 else at
            continue
        if hole:
            holes.append((hole[0], at, hole[1]))
            hole = None
        begins.append(at)
        at = end
    if hole:
        holes.append((hole[0], n, hole[1]))
    return begins, holes


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, bytes]]:
    """('record', begin, end, headers, block) and ('gap', begin, end, reason, b'') in order."""
    at, n = 0, len(data)
    gap: tuple[int, str] | None = None
    #: what came out of the damaged member that the gap begins with, and where it failed
    held: tuple[bytes, list[int], int] = b"", [], 0

    def close(end: int):
        nonlocal gap, held
        for k in held[1]:
            yield "record", gap[0], end, *_plain(held[0], k)[1:]
        if gap:
            yield "gap", gap[0], end, gap[1], b""
        gap, held = None, (b"", [], 0)

    while at < n:
        if data.startswith(b"\x1f\x8b\x08", at):
            end, content, failure = _inflate(data, at)
            begins, holes = _spans(content, failure is not None)
            places = "; ".join(f"{why} (bytes {a} to {b} of the content)" for a, b, why in holes)
            if failure is None and (begins or not content):
                yield from close(at)
                for k in begins:
                    yield "record", at, end, *_plain(content, k)[1:]
                if holes:
                    yield "gap", at, end, places, b""
                at = end
                continue
            if failure is None:  # whole, but nothing in it is a record
                gap, at = gap or (at, holes[0][2]), end
                continue
            if begins and (len(begins) > 1 or holes or "cut" in failure):
                yield from close(at)
                gap, held = (at, "; ".join(filter(None, (failure, places)))), (content, begins, end)
            else:
                gap = gap or (at, failure)
        else:
            try:
                end, head, block = _plain(data, at)
                # a member may hold its records uncompressed: those are told already
                if at >= held[2] or all(_plain(held[0], k)[2] != block for k in held[1]):
                    yield from close(at)
                    yield "record", at, end, head, block
                    at = end
                    continue
            except Damaged as e:
                gap = gap or (at, str(e))
        nexts = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/", at + 1)) if x >= 0]
        at = min(nexts, default=n)
    yield from close(n)


_LENGTH = re.compile(rb"\r\nContent-Length:\s*(\d+)", re.I)
COLUMNS = ("kind string, archive string, begin bigint, end bigint, reason string, record_id string, record_type string, "
           "target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")


def _row(item, archive: str, with_payload: bool) -> dict:
    kind, begin, end, head, block = item
    row = dict.fromkeys((c.split()[0] for c in COLUMNS.split(", ")), None)
    row |= {"kind": kind, "archive": archive, "begin": begin, "end": end}
    if kind == "gap":
        return row | {"reason": head}
    http = head.get("content-type", "").startswith("application/http")
    cut = block.find(b"\r\n\r\n") + 4 if http else 0
    payload = block[cut:]
    kinds = head.get("warc-type")
    if kinds == "revisit":
        told = _LENGTH.search(block[:cut])
        row |= {"payload_bytes": int(told[1]) if told else None,
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    else:
        digest = sha1_base32(payload)
        want = head.get("warc-payload-digest", "")
        if want.startswith("sha1:") and want[5:] != digest:
            return row | {"kind": "gap", "reason": "payload digest differs"}
        row |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if with_payload else None}
    return row | {"record_id": head.get("warc-record-id", "").strip("<>") or None, "record_type": kinds,
                  "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None}


def read(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 256) -> DataFrame:
    """Records and gaps (``kind``) of all archives below ``path``, compressed or not.
    A task holds one archive (up to 2 GB) and a few hundred records at a time."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "content"))
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                        for c in COLUMNS.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1)):
                rows = []
                for item in salvage(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append(_row(item, archive.as_py(), with_payload))
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(parse, COLUMNS)


def records(found: DataFrame) -> DataFrame:
    """The records of ``read``."""
    return found.where("kind = 'record'").drop("kind", "reason")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined byte ranges of ``read``: archive, begin, end, reason."""
    return found.where("kind = 'gap'").select("archive", "begin", "end", "reason")


def page_number(urn: str) -> "F.Column":
    """page_id of a record name as the writer makes them; null if it has none."""
    digits = F.regexp_extract(F.col(urn), r"^urn:x-page:(-?\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))
