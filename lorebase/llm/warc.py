"""Operator 5: WARC archives, written with one gzip member per record and read by byte ranges.

Writing goes through Spark's text writer, so archives land with its commit protocol on whatever file system holds
the folder and a lost executor leaves no partial file. That writer ends each row with a separator of one byte; the
last byte of a gzip member is the high byte of the content's length, which is 0 below 16 MiB, and that 0 is used as
the separator. A larger record is followed by a small metadata record to restore this.

Reading cuts files into byte ranges at the gzip magic 1f 8b 08: a task gets the candidates that begin inside its
range and owns the records among them. A candidate is a member if it inflates from its start to a whole WARC record.
The magic can also occur within a member, by chance or because a payload holds gzip members itself; so an open member
takes all further candidates until its own stream ends. If it fails instead, or the file ends before it does, its first
candidate was no member or was cut off, and the ones behind it are looked at anew. A member that is still open at the end
of a range is carried, with its candidates, into the next one, which is then decoded again from there. Members are inflated piece by piece; without payloads only their digests are
kept. A record whose length or headers are wrong is skipped, and so are truncated and foreign data.

A null html is an empty payload. Equal payloads: the smallest page_id is the response, the others are revisits that
name it, also for empty payloads. Rows with a null page_id are written as responses of their own and read back with
page_id null. Extra columns, whatever their names, are ignored; an empty table gives no records. A payload beyond 2 GiB
fits no row: it is read back as null, with its digest and length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, new_path, save

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
#: Bytes inflated at a time; longest headers; longest payload of a row.
STEP, HEAD_LIMIT, PAYLOAD_LIMIT = 1 << 20, 1 << 20, (1 << 31) - (1 << 16)


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    return gzip.compress(record, 6, mtime=0)


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("value", pa.binary())])
    for b in it:
        for page, url, payload, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            payload = payload or b""
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            revisit = first is not None and page is not None and first != page
            uri = "".join((url or "").split()) or "urn:lorebase:unknown"
            headers = [
                ("WARC-Record-ID", f"<urn:lorebase:page:{'' if page is None else page}>"),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", uri),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("X-Payload-Length", str(len(payload))),
                ("Content-Type", "application/http; msgtype=response"),
            ]
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            if revisit:
                headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:lorebase:page:{first}>")]
                member = _member(_record("revisit", headers, http))
            else:
                member = _member(_record("response", headers, http + payload))
            if member[-1]:
                note = [("WARC-Record-ID", "<urn:lorebase:note>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                member += _member(_record("metadata", note, b"note: large record before\r\n"))
            yield batch(schema, [member[:-1]])


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Archive pages(page_id, url, html) under path; payloads of at least min_revisit_bytes are stored once.

    Copies are found on (digest, page_id) alone. The smallest page_id of a digest comes from map-side minima, and
    the join back is keyed by page_id, so one payload with a third of all pages makes no hot task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.where("page_id is not null").where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", F.sha1("payload").alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    copies = save(keyed.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", "first"), "copies")
    # a repeated page_id may have other payloads: the digest decides too
    tagged = rows.withColumn("digest", F.sha1("payload")).join(copies.distinct(), ["page_id", "digest"], "left").select("page_id", "url", "payload", "first")
    members = map_arrow(tagged, _encode, "value binary")
    members.select(F.expr("cast(value as string)").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def _as_bytes(spark: SparkSession) -> dict[str, str]:
    """Options by which files named *.gz are read as they are and in ranges.

    Hadoop looks up a file's codec by the last registered suffix before its name, both read backwards; with this one
    registered, which no file has, a *.gz name doesn't meet gzip's own.
    """
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: "!.gz"}


class NoRecordError(Exception):
    """The candidate is no gzip member, or holds no WARC record."""


class Member:
    """A member that is inflated as its bytes come in."""

    def __init__(self, with_payload: bool):
        self.z, self.sha, self.with_payload = zlib.decompressobj(wbits=31), hashlib.sha1(), with_payload
        self.head, self.headers, self.left, self.in_http, self.length, self.parts = b"", None, 0, False, 0, []

    def feed(self, data: bytes) -> None:
        while not self.z.eof:
            try:
                out = self.z.decompress(data, STEP)
            except zlib.error as e:
                raise NoRecordError from e
            data = self.z.unconsumed_tail
            if out:
                self._take(out)
            elif not data:
                return

    def _take(self, out: bytes) -> None:
        if self.headers is None:
            self.head += out
            head, sep, out = self.head.partition(b"\r\n\r\n")
            if not b"WARC/1.".startswith(head[:7]) or len(head) > HEAD_LIMIT:
                raise NoRecordError
            if not sep:
                return
            self.headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
            length = self.headers.get("Content-Length", "").strip()
            if not (length.isascii() and length.isdigit()):
                raise NoRecordError
            self.left, self.head, self.in_http = int(length), b"", self.headers.get("Content-Type", "").startswith("application/http")
        out = out[: self.left]
        self.left -= len(out)
        if self.in_http:
            at = max(0, len(self.head) - 3)
            self.head += out
            end = self.head.find(b"\r\n\r\n", at)
            if end < 0:
                return
            out, self.head, self.in_http = self.head[end + 4 :], b"", False
        self.sha.update(out)
        self.length += len(out)
        if self.with_payload and self.length <= PAYLOAD_LIMIT:
            self.parts.append(out)

    @property
    def ended(self) -> bool:
        return self.z.eof

    def record(self) -> tuple | None:
        """type, id, uri, digest, payload_length, refers_to, payload; None if it isn't whole."""
        h = self.headers
        if h is None or self.left:
            return None
        kind, digest, length = h.get("WARC-Type", ""), h.get("WARC-Payload-Digest", ""), h.get("X-Payload-Length", "")
        if kind != "revisit":  # what was stored speaks for itself
            digest, length = base64.b32encode(self.sha.digest()).decode(), self.length
        else:
            length = int(length) if length.isascii() and length.isdigit() else None
        payload = b"".join(self.parts) if self.with_payload and self.length <= PAYLOAD_LIMIT else None
        return kind, h.get("WARC-Record-ID", "").strip("<>"), h.get("WARC-Target-URI"), digest.rpartition(":")[2], length, (h.get("WARC-Refers-To") or "").strip("<>") or None, payload


def decode_pieces(pieces: Iterator[bytes], with_payload: bool = True, last: bool = False) -> Iterator[tuple[str, tuple | bytes]]:
    """From the candidates of a range, in order: ('record', fields), and at the end ('open', its bytes but the magic).

    last: the file ends here, so a member that is still open then was cut off, and the candidates behind it are looked at.
    """
    again: deque[bytes] = deque()
    pieces = iter(pieces)
    member, held = None, []
    while True:
        piece = again.popleft() if again else next(pieces, None)
        if piece is None:
            if member is None or not last:
                break
            again.extend(held[1:])
            member = None
            continue
        if member is None:
            if not piece:  # before a file's first magic, or magic upon magic: no member begins so
                continue
            member, held = Member(with_payload), []
        held.append(piece)
        try:
            member.feed(MAGIC + piece)
        except NoRecordError:
            again.extendleft(reversed(held[1:]))
            member = None
            continue
        if member.ended:
            if record := member.record():
                yield "record", record
            member = None
    if member is not None:
        yield "open", MAGIC.join(held)


SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("raw", pa.binary())])
ROW = "file string, start long, kind string, type string, id string, uri string, digest string, payload_length long, refers_to string, payload binary, raw binary"


def _decode(with_payload: bool):
    """The records of ranges (file, start, last, value), and for each range a row 'range', with raw if a member is open at its end."""

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, bytes]]:
        for b in it:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for (file, start, last), rows in groupby(ranges(it), key=lambda r: r[:3]):
            out, size, open_ = [], 0, None
            for kind, what in decode_pieces((r[3] for r in rows), with_payload, last):
                if kind == "open":
                    open_ = what
                    continue
                out.append((file, start, kind, *what, None))
                size += len(what[-1] or b"")
                if len(out) >= 500 or size > 1 << 22:
                    yield batch(SCHEMA, *map(list, zip(*out, strict=True)))
                    out, size = [], 0
            out.append((file, start, "range", *[None] * 7, open_))
            yield batch(SCHEMA, *map(list, zip(*out, strict=True)))

    return run


def _decode_again(with_payload: bool):
    """The rows of one range, with the candidates of the open member before it as its first pieces (at = -1)."""
    run_all = _decode(with_payload)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        rows = zip(*(table.column(c).to_pylist() for c in ("file", "start", "last", "value", "at")), strict=True)
        apart = [(file, start, last, piece) for file, start, last, value, at in rows for piece in (value.split(MAGIC) if at < 0 else [value])]
        last = any(r[2] for r in apart)
        columns = [pa.array([r[0] for r in apart]), pa.array([r[1] for r in apart]), pa.array([last] * len(apart)), pa.array([r[3] for r in apart], pa.large_binary())]
        given = pa.RecordBatch.from_arrays(columns, names=["file", "start", "last", "value"])
        return pa.Table.from_batches(list(run_all(iter([given]))), schema=SCHEMA)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records under path: type, id, uri, digest, payload_length, refers_to, payload (null unless asked for).

    Ranges are decoded once, in one map. Those behind an open member, which are rare, are decoded again: only their files
    are read once more, and only their rows are written.
    """
    # ISO-8859-1 makes the separator exactly the three bytes of the magic; the reader splits files at any byte
    raw = spark.read.options(**_as_bytes(spark)).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin1")).text(path)
    at = lambda c: F.col(f"_metadata.{c}")
    last = at("file_block_start") + at("file_block_length") >= at("file_size")
    pieces = raw.select(at("file_path").alias("file"), at("file_block_start").alias("start"), last.alias("last"), F.expr("cast(value as binary)").alias("value"))
    found = _in_even_ranges(spark, lambda: save(map_arrow(pieces, _decode(with_payload), ROW), "records"))
    records = found.where("kind = 'record'")
    ends = found.where("kind = 'range'").select("file", "start", "raw")
    while True:
        by = Window.partitionBy("file").orderBy("start")
        near = ends.select("file", "start", "raw", F.lead("start").over(by).alias("next"), F.lag(F.col("raw").isNotNull()).over(by).alias("after_open"))
        # of open members in neighbouring ranges the first decides about the others; behind the last candidate stands nothing more
        open_ = near.where("raw is not null and not coalesce(after_open, false)").select("file", F.col("start").alias("from"), F.coalesce("next", "start").alias("start"), F.col("next").isNull().alias("alone"), "raw")
        if open_.isEmpty():
            return records.select("type", "id", "uri", "digest", "payload_length", "refers_to", "payload")
        open_ = save(open_, "open")
        # names of the files with an open member alone; Spark lists and reads only these
        files = [r.file for r in open_.where("not alone").select("file").distinct().collect()]
        ranges = open_.where("not alone").select("file", "start")
        asked = pieces.where(F.col("file").isin(files)).withColumn("at", F.monotonically_increasing_id()).join(ranges, ["file", "start"], "left_semi")
        carried = open_.select("file", "start", F.col("alone").alias("last"), F.col("raw").alias("value"), F.lit(-1).cast("long").alias("at"))
        again = asked.unionByName(carried).groupBy("file", "start").applyInArrow(_decode_again(with_payload), ROW)
        fresh = _in_even_ranges(spark, lambda again=again: save(again, "fresh"))
        records = records.join(ranges, ["file", "start"], "left_anti").select(*found.columns).unionByName(fresh.where("kind = 'record'"))
        done = open_.select("file", F.col("from").alias("start"), F.lit(True).alias("done"))
        kept = ends.join(ranges, ["file", "start"], "left_anti").join(done, ["file", "start"], "left")
        kept = kept.select("file", "start", F.when(F.col("done").isNull(), F.col("raw")).alias("raw"))
        ends = save(kept.unionByName(fresh.where("kind = 'range'").select("file", "start", "raw").join(ranges, ["file", "start"], "left_semi")), "ends")


def _in_even_ranges(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """read(), with files cut at multiples of spark.sql.files.maxPartitionBytes, whichever files are read."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "1")
    try:
        return read()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def page_records(records: DataFrame) -> DataFrame:
    page = lambda c: F.regexp_extract(c, "^urn:lorebase:page:(-?[0-9]+)$", 1).try_cast("long")
    return records.where(F.col("type").isin("response", "revisit")).select(
        page(F.col("id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(read_warc(spark, path, with_payload=False))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(hex, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
