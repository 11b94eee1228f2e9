"""WARC archives: written by Spark's text sink in files of bounded size, read back as streams, assembled into captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise
from .skew import hot_keys, salted_join

END = "\r\n\r\n"
FILE_BYTES = 128 << 20
"""Bytes of records, as stored, after which a file ends; an archive is read whole by one task."""
CHUNK = 1 << 20
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string,"
    " content_type string, payload_digest string, payload_bytes long, computed_digest string, fields map<string,string>,"
    " payload binary"
)


def base32_of_sha1(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in 40 hex digits."""
    out = []
    for g in range(8):  # 5 hex digits are 4 base32 digits
        v = F.conv(F.substring(hexed, 1 + 5 * g, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, an empty line and the block; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_revisit_bytes: int = 0,
    compression: str = "gzip",
    files: int | None = None,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write a request, a response or revisit and a metadata record for every row of ``pages`` under ``path``.

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the smallest id is a response, and the others revisit it without
    a payload; rows that repeat that id with that payload are responses too, and if no row of a group has an
    id, all are responses. Every row has three records of its own: rows that repeat another in id, url and payload
    are numbered. A null id is left out of the metadata and a null url out of the headers. Line breaks in a url become blanks. An empty
    table writes an archive without records. A file ends after ``file_bytes`` stored bytes, so it has less than
    that and one record more.

    With ``gzip`` every record, with the CR LF CR LF that ends it, is a gzip member of its own; else (``none``) records
    are plain. The files go through Spark's text sink, whose line separator is CR LF CR LF between plain records and
    an empty gzip member between others: so Spark's committer puts them on any file system that it can write, and a
    task that is run again leaves no second copy.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    page, url = F.col(id_col).cast("string"), F.regexp_replace(F.col(url_col), r"[\r\n]", " ")
    digest, known = F.sha1(body.cast("binary")), lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    rows = pages.select(
        page.alias("page"),
        F.col(id_col).alias("id"),
        url.alias("url"),
        body.alias("body"),
        digest.alias("digest"),
        F.md5(F.concat_ws("|", known(page), digest, known(url))).alias("key"),
    )
    able = (F.octet_length("body") >= min_revisit_bytes) & F.col("id").isNotNull()
    firsts = (
        rows.groupBy("digest")
        .agg(F.min(F.when(able, F.struct("id", "key"))).alias("origin"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    light = rows.select("id", "key", "digest")
    met = salted_join(light, firsts.drop("n"), ["digest"], hot_keys(firsts, ["digest"], "n"), "key")
    first = F.when(~F.col("id").eqNullSafe(F.col("origin.id")), F.col("origin.key"))
    marks = met.groupBy("key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    marks = materialise(marks.where("first is not null or copies > 1"), "marks")
    repeats = marks.where("copies > 1")
    marked = rows.join(marks, "key", "left").withColumn("copy", F.lit(0).cast("long"))
    if not repeats.isEmpty():
        placed = rows.withColumn("nth", F.monotonically_increasing_id())
        met = salted_join(placed, repeats, ["key"], hot_keys(repeats, ["key"], "copies"), "nth").drop("nth")
        same = [F.first(c).alias(c) for c in met.columns if c != "key"]
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
        again = met.groupBy("key").agg(*same).select("*", copy)
        marked = marked.where("coalesce(copies, 1) = 1").unionByName(again)
    again = F.col("first").isNotNull()
    main_id = _uuid(F.col("key"), F.col("copy").cast("string"), F.lit("response"))
    origin = _uuid(F.col("first"), F.lit("0"), F.lit("response"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END), F.when(again, F.lit("")).otherwise(F.col("body")))
    main = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", main_id),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_sha1(F.col("digest")))),
            ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(again, origin)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    side = lambda kind, mime, block: _record(
        kind,
        [
            ("WARC-Record-ID", _uuid(main_id, F.lit(kind))),
            *common,
            ("WARC-Concurrent-To", main_id),
            ("Content-Type", F.lit(mime)),
        ],
        block,
    )
    request = side("request", "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END)))
    meta = side("metadata", "application/warc-fields", F.when(F.col("page").isNull(), F.lit("")).otherwise(F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n"))))
    out = marked.select(F.explode(F.array(request, main, meta)).alias("value"))
    if files:
        out = out.repartition(files)
    packed = compression == "gzip"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0
        for b in batches:
            data, part = [], []
            for value in b["value"]:
                raw = value.encode()
                data.append(gzip.compress(raw + END.encode(), 6, mtime=0) if packed else raw)
                part.append(size // file_bytes)
                size += len(data[-1])
            yield pd.DataFrame({"value": data, "part": part})

    stored = out.mapInPandas(number, "value binary, part long").withColumn("value", F.col("value").cast("string"))
    sink = stored.write.partitionBy("part").option("compression", "none").option("encoding", "ISO-8859-1")
    sink.option("lineSep", EMPTY_MEMBER.decode("latin-1") if packed else END).text(path)


class _Stream:
    """The bytes of an archive, plain or gzip with one or many members, of which a record or so is held at a time."""

    def __init__(self, data: bytes) -> None:
        self.parts, self.held = self._unpacked(data) if data[:2] == b"\x1f\x8b" else self._slices(data), bytearray()

    @staticmethod
    def _slices(data: bytes) -> Iterator[bytes]:
        view = memoryview(data)
        for k in range(0, len(data), CHUNK):
            yield bytes(view[k : k + CHUNK])

    @staticmethod
    def _unpacked(data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data) and data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            while not member.eof:
                if at >= len(data):
                    raise ValueError("a gzip member without an end")
                part = data[at : at + CHUNK]
                at += len(part)
                yield member.decompress(part, CHUNK)
                while member.unconsumed_tail and not member.eof:
                    yield member.decompress(member.unconsumed_tail, CHUNK)
            at -= len(member.unused_data)

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held += part
        return True

    def find(self, mark: bytes) -> int:
        """Where ``mark`` begins in what is held, which grows until it is there; -1 for nowhere."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark))
            if not self.more():
                return -1
        return at

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parse_records(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records of an archive (gzip, one or many members, or plain), one after the other by their declared lengths.

    The archive is unpacked as it is read, so that memory holds one record, not the whole. What lies between
    records is skipped; one that is shorter than it says raises.
    """
    stream = _Stream(data)
    while (start := stream.find(b"WARC/")) >= 0:
        stream.take(start)
        stop = stream.find(b"\r\n\r\n")
        if stop < 0:
            raise ValueError("a record without an end of its headers")
        head = {}
        for line in stream.take(stop + 4).decode("utf-8", "replace").split("\r\n")[1:-2]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError("a record shorter than its Content-Length")
        mime = head.get("content-type", "")
        fields, payload = {}, block
        if mime.startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            payload = block[cut + 4 :] if cut >= 0 else b""
        elif mime.startswith("application/warc-fields"):
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
            fields = {k.strip(): v.strip() for k, _, v in pairs}
        yield {
            "record_type": head.get("warc-type"),
            "record_id": head.get("warc-record-id"),
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "warc_date": head.get("warc-date"),
            "content_type": mime or None,
            "payload_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
            "payload_bytes": len(payload),
            "computed_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "fields": fields,
            "payload": payload if with_payload else None,
        }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``. An archive's stored bytes are read whole by one task (2 GB at
    most, a limit of Spark's reader) and unpacked record by record."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for r in parse_records(bytes(data), with_payload):
                    rows.append(r)
                    held += 500 + (r["payload_bytes"] if with_payload else 0)
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and metadata records concurrent to it.

    Request and metadata are joined on WARC-Concurrent-To = WARC-Record-ID of the response or revisit. A
    capture without one of them has null there; of several the one with the smallest record id is taken. Repeats
    of a record id are one record. A revisit also gets its response's payload_bytes and metadata (``origin``).
    """
    columns = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "payload_bytes", "computed_digest", "payload"]
    main = records.where(F.col("record_type").isin("response", "revisit")).dropDuplicates(["record_id"])
    main = main.select(F.col("record_id").alias("capture_id"), F.struct(*columns).alias("main"))

    def side(kind: str) -> DataFrame:
        of_kind = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        one = F.struct("record_id", "target_uri", "content_type", "fields")
        return of_kind.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(one, "record_id").alias(kind))

    captures = main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    origin = captures.where(F.col("main.record_type") == "response").select(
        F.col("capture_id").alias("refers_to"),
        F.struct(F.col("main.payload_bytes"), F.col("main.computed_digest"), F.col("metadata.fields")).alias("origin"),
    )
    captures = captures.withColumn("refers_to", F.when(F.col("main.record_type") == "revisit", F.col("main.refers_to")))
    counts = records.where("record_type = 'revisit' and refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(captures, origin, ["refers_to"], hot_keys(counts, ["refers_to"], "n"), "capture_id", "left")
    return joined.select("capture_id", F.col("main").alias("capture"), "request", "metadata", "origin")
