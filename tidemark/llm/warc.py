"""WARC archives: writing with revisit records, and a reader that salvages what it can."""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import fresh, shared_path

LEAST_REVISIT = 1000
#: Records of an archive file, bytes of one (by its largest payload), and groups of copies that are
#: broadcast (60 bytes each), at most.
RECORDS_PER_FILE, FILE_BYTES = 2000, 128 << 20
BROADCAST_GROUPS = 500_000
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "file string, start bigint, stop bigint, problem string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, inner_start bigint, inner_stop bigint"


def _header(name: str, value: Column) -> Column:
    """One header line; control characters and spaces of the value are percent-encoded as %20; none where it is null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n")))


def with_revisits(pages: DataFrame, *, id_column: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """Add _digest, _bytes, _refers (with underscores behind them where ``pages`` has such columns): of
    pages with equal payloads of ``least`` bytes or more, all but those with the largest id refer to it.
    Groups are counts by digest; only groups of two or more are joined back, by broadcast while they
    are few."""
    digest, size, refers, group, keep, n = fresh(pages, "_digest", "_bytes", "_refers", "_group", "_keep", "_n")
    html = F.coalesce("html", F.lit(""))
    rows = pages.withColumn(digest, F.sha1(html.cast("binary"))).withColumn(size, F.octet_length(html).cast("long"))
    groups = rows.filter(F.col(size) >= least).groupBy(digest).agg(F.max(id_column).alias(keep), F.count("*").alias(n)).filter(F.col(n) > 1).select(F.col(digest).alias(group), keep)
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    found = rows.join(groups, (F.col(digest) == F.col(group)) & (F.col(size) >= least), "left")
    other = F.col(id_column).isNull() | (F.col(id_column) != F.col(keep))
    return found.withColumn(refers, F.when(other, F.col(keep))).drop(group, keep)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which write_warc()'s separator puts back: a zero, as in the
    length of anything below 16 MB. Longer records are followed by an empty member."""
    blank = gzip.compress(b"", mtime=0)
    for batch in batches:
        out = []
        for value in batch.column(0):
            member = gzip.compress(value.as_py(), mtime=0)
            out.append((member + blank if member[-1] else member)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, *, id_column: str = "page_id", least: int = LEAST_REVISIT, date: str = DATE, compression: str = "none") -> None:
    """Write a record per page to WARC/1.1 files under ``path``, plain or with ``compression="gzip"``.

    A record is one line of Spark's text writer, whose line separator ends the record: the files come by
    the writer's commit protocol, so a lost executor leaves no half archive. In gzip files each record
    is a member of its own.
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression is none or gzip, not {compression}")
    chosen = pages.select(F.col(id_column).alias("page_id"), "url", "html")
    rows = with_revisits(chosen, least=least)
    revisit = F.col("_refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:no-page>"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _header("WARC-Refers-To", urn(F.col("_refers"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _header("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
    )
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES // (largest + 1024)))
    out, end = rows.select(record.alias("value")), "\r\n\r\n"
    if compression == "gzip":
        # The text writer puts out the bytes of a string as they are.
        whole = out.select(F.concat("value", F.lit(end)).cast("binary").alias("value"))
        out, end = whole.mapInArrow(_members, "value binary").select(F.col("value").cast("string")), "\0"
    out.write.option("lineSep", end).option("maxRecordsPerFile", per_file).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"


#: Digests that can be checked, and their length in bytes.
_DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def digest_of(field: str) -> tuple[str, str]:
    """(kind, lower-case hex) of what a digest field tells in hex or base32; empty if none that can be checked."""
    kind, _, value = field.partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip()
    if (size := _DIGESTS.get(kind)) is None:
        return "", ""
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * size}}}", value):
        return kind, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (binascii.Error, ValueError):
        return "", ""
    return (kind, raw.hex()) if len(raw) == size else ("", "")


def _fits(told: tuple[str, str], data: bytes) -> bool:
    return not told[0] or hashlib.new(told[0], data).hexdigest() == told[1]


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, where the next one should start, problem) of the record whose version line is at ``at``.

    Checked are the version line, the named fields (folded lines are joined), the length, the separator
    that follows, the block's digest where it is told and, of records that carry their payload as it is
    (no revisits, no transfer encoding), the payload's: of HTTP blocks what follows their header,
    else the block. A record whose frame holds but whose payload fails is quarantined alone; where the
    frame itself fails, the next place is only one byte on. ``sure``: a digest was told and fits.
    """
    if not (m := _VERSION.match(data, at)):
        return None, at + 1, "no version line"
    stop = data.find(_END, m.end() - 2)
    if stop < 0:
        return None, at + 1, "header without end"
    if _VERSION.search(data, m.end(), stop):
        return None, at + 1, "another version line in the header"
    if _CONTROL.search(data, m.end(), stop):
        return None, at + 1, "control characters in the header"
    fields = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[m.end() : stop]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or b"\r" in line or b"\n" in line:
            return None, at + 1, "broken header"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or not fields.keys() >= {"warc-type", "warc-record-id"}:
        return None, at + 1, "header lacks a field"
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != _END:
        return None, at + 1, "length does not fit"
    block = data[begin:end]
    head, cut, payload = block.partition(_END) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    told, of_block = (digest_of(fields.get(f"warc-{x}-digest", "")) for x in ("payload", "block"))
    if not _fits(of_block, block):
        return None, end + 4, "block digest does not fit"
    whole = fields["warc-type"] not in ("revisit", "continuation") and not re.search(rb"(?im)^transfer-encoding:", head)
    if whole and not _fits(told, payload):
        return None, end + 4, "payload digest does not fit"
    record = {"fields": fields, "http": head if cut else b"", "payload": payload, "digest": hashlib.sha1(payload).hexdigest(), "told": told[1] if told[0] == "sha1" else None, "sure": bool(of_block[0] or whole and told[0])}
    return record, end + 4, ""


def salvage_plain(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, stop, record or None for a quarantined gap, problem), covering all of ``data``."""
    at, gap, why = 0, None, ""
    while at < len(data):
        record, after, problem = parse_record(data, at)
        if record is None:
            if gap is None:
                gap, why = at, problem
            m = _VERSION.search(data, after)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield gap, at, None, why
            gap = None
        yield at, after, record, ""
        at = after
    if gap is not None:
        yield gap, len(data), None, why


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """(plain bytes, where the gzip member that begins at ``at`` ends, problem). Of a member that is cut off
    or does not unpack all bytes ahead of the fault are given; where it ends is then not known (0)."""
    unpack, view, out, pos = zlib.decompressobj(31), memoryview(data), [], at
    while pos < len(data) and not unpack.eof:
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[pos : pos + step]))
        except zlib.error as e:
            if step > 1:
                unpack, step = before, step // 16
                continue
            return b"".join(out), 0, str(e)[:60]
        pos += step
    if not unpack.eof:
        return b"".join(out), 0, "member cut off"
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data), ""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str, int | None, int | None]]:
    """(start, stop, record or None for a quarantined gap, problem, inner start, inner stop) of plain archives
    and of those in gzip members, one for each record or for many.

    start and stop are bytes of the file, and together cover it. In a member, inner start and stop are
    bytes of what it unpacks to, and start and stop those of the member for all that it holds,
    quarantined stretches too. Where a member does not unpack, the search goes on at the next magic number that
    does, and what lies between is a gap; of what the broken member gave, records whose own digest
    is told and fits are kept, with the gap as their place.
    """
    if not data.startswith(_MAGIC) and (_VERSION.search(data) or _MAGIC not in data):
        for part in salvage_plain(data):
            yield *part, None, None
        return
    at, gap, why, saved = 0, None, "", []
    while at < len(data):
        after, problem, parts = 0, "no gzip member", []
        if data.startswith(_MAGIC, at):
            plain, after, problem = _member(data, at)
            parts = list(salvage_plain(plain))
        if after:
            if gap is not None:
                yield from _closed_gap(gap, at, why, saved)
                gap, saved = None, []
            for start, stop, record, fault in parts:  # none in the empty member behind a long record
                yield at, after, record, fault, start, stop
            at = after
            continue
        if gap is None:
            gap, why = at, problem
        saved += [p for p in parts if p[2] is not None and p[2]["sure"]]
        at = data.find(_MAGIC, at + 1)
        at = len(data) if at < 0 else at
    if gap is not None:
        yield from _closed_gap(gap, len(data), why, saved)


def _closed_gap(start: int, stop: int, why: str, saved: list) -> Iterator[tuple]:
    yield start, stop, None, why, None, None
    for inner_start, inner_stop, record, _ in saved:
        yield start, stop, record, "", inner_start, inner_stop


def _text(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<").removesuffix(">")


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """A row per record and per quarantined gap of the archives under ``path`` (see RECORD_SCHEMA).

    ``problem`` is null for records; of a gap only the file, its places and problem are set; the inner places are those of salvage(). payload_bytes
    and payload_digest (bare SHA-1) are those of the full payload: measured where the record carries
    it, told by its headers where it is a revisit. An archive is one row of Spark's binary source.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("inner_start", pa.int64()), ("inner_stop", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for start, stop, record, problem, inner_start, inner_stop in salvage(batch.column(1)[i].as_py()):
                    row = {"file": name, "start": start, "stop": stop, "problem": problem or None, "inner_start": inner_start, "inner_stop": inner_stop}
                    if record:
                        fields = record["fields"]
                        revisit = fields["warc-type"] == "revisit"
                        length = re.search(rb"(?im)^content-length:\s*(\d+)", record["http"])
                        row |= {
                            "record_type": fields["warc-type"],
                            "record_id": _text(fields.get("warc-record-id")),
                            "target_uri": fields.get("warc-target-uri"),
                            "refers_to": _text(fields.get("warc-refers-to")),
                            "payload_bytes": (int(length[1]) if length else None) if revisit else len(record["payload"]),
                            "payload_digest": record["told"] if revisit else record["digest"],
                            "payload": record["payload"] if payload and not revisit else None,
                        }
                        size += len(record["payload"])
                    rows.append(row)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(read, RECORD_SCHEMA)


def archived_pages(pages: DataFrame, path: str | None = None, *, id_column: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """Write the pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Ids are whole numbers or texts and come back as the type they have. Null html counts as empty and a
    null url has no target line; a null page_id is never referred to unless its group has no other;
    rows that repeat the largest page_id of a group are all responses; very long payloads make smaller
    files (one payload must fit Spark's two gigabytes a row); an empty table gives no rows; other
    columns are not archived, so none can clash.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_column].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"{id_column} is {kind.simpleString()}: whole numbers or texts can name records")
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, id_column=id_column, least=least)
    records = read_warc(spark, path, payload=False).filter("problem IS NULL")
    named = lambda c: F.when(F.col(c).startswith("urn:page:"), F.url_decode(F.substring(c, 10, 1 << 30))).cast(kind)
    return records.select(named("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))
