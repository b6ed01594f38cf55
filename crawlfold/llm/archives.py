"""Legacy archive converter: ARC records to WARC.

``parse_arc`` reads ARC files of version 1 and 2 by their own header lines and
declared lengths; ``warc_record`` synthesises the equivalent WARC record
(identifier, date, type, digests). ``convert_archives`` does both for a folder
of ARC files, plain or gzipped, a file a row of Spark; ``write_pages`` makes such
files of a table of pages. Archives are rows of bytes of a bounded size, and
``write_archives`` stores each as a gzipped file in the shared folder through
Spark's text writer, which writes the bytes as they are. ``read_archives`` parses
WARC files by declared lengths and takes sizes and digests from the payloads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlfold.llm.staging import drop_path, shared_path, stage
from crawlfold.session import ship_package

# FIXED VALUES: field lists of the two ARC versions' header lines
ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
CRLF = b"\r\n"
IDENTIFIERS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:crawlfold:archives")
ARCHIVE_BYTES = 32 << 20  # bytes of records in an archive, before compression; a larger record has its own
GZIP_LEVEL = "BEST_SPEED"  # Hadoop's zlib.compress.level; at DEFAULT_COMPRESSION the whole query takes 1.6 times the CPU
SOURCE_HEADER = b"X-Archive-Source-ID: "


class ArcError(ValueError):
    """A header line or a declared length that does not hold."""


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes = field(repr=False)
    offset: int = 0


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of ``(url, ip, date14, mime, block)`` records."""
    names = ARC_V1 if version == 1 else ARC_V2
    about = f"{version} 0 crawlfold\n{names}\n".encode()
    out = io.BytesIO()

    def line(url, ip, date, mime, length):
        own = [url, ip, date, mime] if version == 1 else [url, ip, date, mime, "200", "-", "-", str(out.tell()), name]
        # spaces part the fields, a line feed ends them
        safe = [x.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09") or "-" for x in own]
        return " ".join([*safe, str(length)]).encode() + b"\n"

    out.write(line(f"filedesc://{name}", "0.0.0.0", records[0][2] if records else "19960101000000", "text/plain", len(about)) + about)
    for url, ip, date, mime, block in records:
        out.write(b"\n" + line(url, ip, date, mime, len(block)) + block)
    return out.getvalue()


def parse_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block. Blank lines between
    records are skipped; anything else that breaks the format is an ArcError."""
    names, version, end = None, 0, 0
    while line := stream.readline():
        start, end = end, end + len(line)
        if line in (b"\n", CRLF):
            continue
        columns = names or ARC_V1.split()
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(columns) - 1)
        if names is None and not parts[0].startswith("filedesc://"):
            raise ArcError("no version block")
        if names is None and len(parts) != len(columns):  # a version 2 file states itself in ten fields
            columns = ARC_V2.split()
            parts = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(columns) - 1)
        if len(parts) != len(columns) or not parts[-1].isdigit():
            raise ArcError(f"header line {line[:80]!r}")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ArcError(f"declared length {length}, found {len(block)}")
        end += length
        if names is None:
            first, _, rest = block.decode("utf-8", "replace").partition("\n")
            version, names = int(first.split(" ")[0]), rest.split("\n")[0].split(" ")
            if version not in (1, 2):
                raise ArcError(f"version {version}")
            continue
        yield ArcRecord(version, dict(zip(names, parts)), block, start)


def http_response(payload: bytes, mime: str = "text/html", source: int | None = None) -> bytes:
    """A response with ``payload``; ``source`` is the id of the row it was made of."""
    own = b"" if source is None else SOURCE_HEADER + str(source).encode() + CRLF
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n".encode() + own + CRLF + payload


def http_parts(block: bytes) -> tuple[bytes, bytes, bool]:
    """Head with its empty line, payload, and whether the block is an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if block.startswith(b"HTTP/") and gap:
        return head + gap, payload, True
    return b"", block, False


def source_number(head: bytes) -> int | None:
    """The id that ``http_response`` put into the head, if any."""
    for line in head.split(CRLF):
        value = line.removeprefix(SOURCE_HEADER)
        if value is not line and value.removeprefix(b"-").isdigit() and -2 ** 63 <= int(value) < 2 ** 63:
            return int(value)
    return None


def record_id(source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDENTIFIERS, source)}>"


def warc_date(date14: str) -> str:
    d = (date14 + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: ArcRecord, source_id, refers_to=None) -> bytes:
    """The WARC record of an ARC record, without its last CRLF.

    A block that starts with an HTTP status line is a response (its payload is
    the entity), or a revisit of ``refers_to`` with the HTTP head alone; any other
    block is a resource, its own payload.
    """
    head, payload, http = http_parts(arc.block)
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = head if kind == "revisit" else arc.block
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(f'{source_id}')}",
        f"WARC-Date: {warc_date(arc.fields['Archive-date'])}", f"WARC-Target-URI: {arc.fields['URL']}",
        f"WARC-IP-Address: {arc.fields['IP-address']}",
        f"Content-Type: {'application/http; msgtype=response' if http else arc.fields['Content-type']}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Source-ID: {'' if source_id is None else source_id}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(f'{refers_to}')}", f"X-Refers-To-Source-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each WARC record, by declared lengths."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.rstrip(b"\r\n").decode("utf-8").partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the last record is cut short")
        yield headers, block


def _archives(batches, record, join, archive_bytes):
    """Rows of bytes, each ``join(records, number)`` of as many consecutive
    records as ``archive_bytes`` hold. ``record(row)`` gives a record and its size."""
    number, held, size = TaskContext.get().partitionId(), [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([join(held, number)], pa.binary())], names=["value"])

    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            one, n = record([c[i].as_py() for c in columns])
            if held and size + n > archive_bytes:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(one)
            size += n
    if held:
        yield row()


def _pages(date14: str, archive_bytes: int):
    def record(row):
        source, url, html = row
        block = http_response((html or "").encode(), source=source)
        return (url or "", "0.0.0.0", date14, "text/html", block), len(block)

    def run(batches):  # both versions occur
        yield from _archives(batches, record, lambda records, number: arc_file(records, 1 + number % 2, f"pages-{number}.arc"), archive_bytes)
    return run


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                date14: str = "20200101000000", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files of a record per row of ``pages``. The id stands in the HTTP head,
    which a null id leaves out; null html and null url are empty; other columns are not read."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    write_archives(rows.mapInArrow(_pages(date14, archive_bytes), "value binary"), path, "\n")


RECORD = ("source string, number bigint, digest string, payload_bytes bigint, version int, fields map<string,string>, block binary")


def _opened(content: bytes):
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _records(blocks: bool):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    kinds = kinds if blocks else kinds[:4]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
            "source", "number", "digest", "payload_bytes", "version", "fields", "block"][:len(kinds)])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name, rows, size = path.as_py().rsplit("/", 1)[-1], [], 0
                with _opened(content.as_py()) as stream:
                    for r in parse_arc(stream):
                        head, payload, _ = http_parts(r.block)
                        number = source_number(head)
                        source = f"{name}@{r.offset}" if number is None else str(number)
                        rows.append((source, number, sha1_base32(payload), len(payload), r.version, list(r.fields.items()), r.block)[:len(kinds)])
                        size += len(r.block) if blocks else 256
                        if size > ARCHIVE_BYTES // 4:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)
    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arcs(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row per record of the ARC files (plain or gzipped) below ``path``:
    ``source`` (the id in its HTTP head, or else file and offset), ``number`` (that
    id or null), digest and size of its payload, and with ``blocks`` its version,
    header fields and block."""
    ship_package(spark)
    return _files(spark, path).mapInArrow(_records(blocks), RECORD if blocks else RECORD.split(", version")[0])


def _warcs(archive_bytes: int):
    def record(row):
        source, refers, version, fields, block = row
        one = warc_record(ArcRecord(version, dict(fields), block), source, refers)
        return one, len(one)

    def run(batches):
        yield from _archives(batches, record, lambda records, number: CRLF.join(records), archive_bytes)
    return run


def convert_archives(spark: SparkSession, path: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The WARC archives (a row of bytes each) of the ARC files below ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes``, that with the
    smallest id is the response (or resource) and the others revisit it; records
    that repeat that id are responses too. Records without an id come after all
    others, by file and offset. The digests that occur twice are a table of their
    own, so the join can be broadcast by its measured size, or else splits hot digests.
    """
    order = F.struct(F.col("number").isNull().alias("anonymous"), "number", "source")
    seen = read_arcs(spark, path, blocks=False).filter(F.col("payload_bytes") >= min_revisit_bytes)
    firsts = seen.groupBy("digest").agg(F.min(order)["source"].alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stage(firsts.filter("n > 1").select("digest", "first"), "payload-firsts")
    again = (F.col("payload_bytes") >= min_revisit_bytes) & (F.col("first") != F.col("source"))
    joined = read_arcs(spark, path).join(firsts, "digest", "left")
    rows = joined.select("source", F.when(again, F.col("first")).alias("refers"), "version", "fields", "block")
    return rows.mapInArrow(_warcs(archive_bytes), "value binary")


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit_bytes: int = 0, date14: str = "20200101000000") -> DataFrame:
    """``convert_archives`` of ARC files of ``pages``, which stay in the shared
    folder until ``staging.release``."""
    spark = pages.sparkSession
    path = shared_path(spark, "arc")
    write_pages(pages, path, id_col, url_col, html_col, date14)
    return convert_archives(spark, path, min_revisit_bytes)


def write_archives(archives: DataFrame, path: str, end: str = "\r\n", level: str = GZIP_LEVEL) -> None:
    """A gzipped file for each row of bytes, which ``end`` closes. ``level`` is a
    name of Hadoop's zlib levels."""
    files = archives.select(F.col("value").cast("string"))  # a cast keeps the bytes, UTF-8 or not
    files = files.write.option("lineSep", end).option("maxRecordsPerFile", 1)
    files.option("compression", "gzip").option("zlib.compress.level", level).text(path)


READ = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, "
        "warc_date string, record_id string, refers_id string")


def _read(batches):
    def number(x):
        return int(x) if x and x.removeprefix("-").isdigit() else None

    names = [c.split(" ")[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            with _opened(content.as_py()) as stream:
                for h, block in parse_warc(stream):
                    if h["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
                        raise ValueError(f"block digest of {h['WARC-Record-ID']}")
                    stated, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if h["WARC-Type"] != "revisit":
                        payload = http_parts(block)[1] if h["Content-Type"].startswith("application/http") else block
                        size = len(payload)
                        if stated != sha1_base32(payload):
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                    rows.append((number(h["X-Source-ID"]), size, stated, h["WARC-Type"], number(h.get("X-Refers-To-Source-ID")),
                                 h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"], h.get("WARC-Refers-To")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``. Sizes are counted and digests made
    from the payloads in the blocks; a revisit has its response's, found by
    record id and digest. A record whose digests do not hold, or a revisit whose
    response is not there, is an error."""
    ship_package(spark)
    rows = stage(_files(spark, path).mapInArrow(_read, READ), "warc-records")
    # responses that others revisit: a row each, so the join is broadcast by its size or splits hot ones
    visited = rows.filter(F.col("refers_id").isNotNull()).select(F.col("refers_id").alias("record_id")).distinct()
    own = rows.filter(F.col("refers_id").isNull()).join(visited, "record_id", "left_semi")
    own = own.groupBy(F.col("record_id").alias("refers_id"), "payload_digest").agg(F.max("payload_bytes").alias("response_bytes"))
    out = rows.join(stage(own, "warc-visited"), ["refers_id", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("bigint")
    size = F.coalesce("payload_bytes", "response_bytes", lost)
    return out.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri", "warc_date")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as ARC files, converted, written and read back."""
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs)
    write_archives(convert_archives(spark, arcs), warcs)
    drop_path(spark, arcs)
    return read_archives(spark, warcs)


# base32 of a SHA-1 (160 bits): 32 groups of 5 bits
SQL = """
WITH p AS (SELECT page_id, coalesce(nullif(url, ''), '-') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i:
         right('000' || bin(('0x' || substr(hex, i::INT + 1, 1))::INT), 4)), '') AS b FROM d),
named AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          list_sum(list_transform(range(0, 5), lambda k: substr(b, (5 * i + k)::INT + 1, 1)::INT * (1 << (4 - k)::INT)))::INT + 1, 1)), '') AS payload_digest,
          min(page_id) OVER (PARTITION BY hex) AS first_id FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       replace(replace(replace(replace(url, ' ', '%20'), chr(10), '%0A'), chr(13), '%0D'), chr(9), '%09') AS target_uri,
       '2020-01-01T00:00:00Z' AS warc_date FROM named
"""
