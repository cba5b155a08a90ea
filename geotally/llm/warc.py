"""WARC archives: writing, reading and revisit resolution.

Archives are written with Spark's text writer, so they go through its commit protocol to any
store that Spark can write: a row is one or more records, whose last line end is the writer's
line separator (CRLF), so that archives are bounded in bytes.  They are read as binary files, inflated piece by piece (any number of gzip
members, or none) and cut at their Content-Length.

Revisit resolution shuffles headers only (place, id, digest, size), takes the newest record of
each payload digest as the original with partial maxima and joins the revisits to it.  The
decisions are gathered by archive, and each archive, as it lies there compressed, is joined to
its own, so that no payload is shuffled by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import cut

# Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of an archive before compression, about: so many rows of so many bytes.  A larger record
#: is a row of its own.
FILE_BYTES, ROWS_PER_FILE = 64 << 20, 16

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 (20 bits, so 5 hex digits, are 4 base-32 digits)."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    # A line end in a value would end the header.
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", "  "), F.lit("\r\n")), F.lit(""))


def record(df: DataFrame) -> Column:
    """Text of a record, from the columns record_id, record_type, uri, date, content_type,
    payload, payload_digest, payload_bytes and refers_to.

    A null date is the current one, a null id a random one; other null values have no line.  A
    revisit has no payload.
    """
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = df["record_type"] == "revisit"
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", df["record_type"]),
        _line("WARC-Record-ID", F.coalesce(urn(df["record_id"]), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", F.coalesce(df["date"], now)),
        _line("WARC-Target-URI", df["uri"]),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), df["payload_digest"])),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, urn(df["refers_to"]))),
        _line("Content-Type", df["content_type"]),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(df["payload_bytes"].cast("string")),
        F.lit("\r\n\r\n"),
        F.when(revisit, F.lit("")).otherwise(df["payload"].cast("string")),
        F.lit("\r\n"),
    )


def write_archives(records: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Write records (see ``record``) to gzip archives of about ``file_bytes`` bytes at most (before
    compression).  An archive is one gzip member with many records.  Without records nothing
    but the folder is written.
    """
    most = max(1, file_bytes // ROWS_PER_FILE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary())], ["value"])

    packed = records.select(record(records).cast("binary").alias("value")).mapInArrow(pack, "value binary")
    (
        packed.select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .text(path)
    )


def inflate(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, all its gzip members one after the other, in bounded pieces."""
    data, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(data), piece):
            yield bytes(data[at : at + piece])
        return
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if member.unconsumed_tail:
                block = member.unconsumed_tail
            elif at < len(data):
                block, at = bytes(data[at : at + 65536]), min(at + 65536, len(data))
            else:
                raise ValueError("the archive ends within a gzip member")
            if out := member.decompress(block, piece):
                yield out
        at -= len(member.unused_data)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive.

    A record that states no length (or none that is a number) ends where the next record begins, or with
    the archive.  Raises ValueError where something else than a record begins, or an archive ends
    within one.
    """
    source, held = inflate(content), bytearray()

    def more() -> bool:
        part = next(source, None)
        held.extend(part or b"")
        return part is not None

    while held or more():
        end = -1
        while (end := held.find(b"\r\n\r\n", max(0, end))) < 0:
            end = len(held) - 3
            if not more():
                raise ValueError("the archive ends within a header")
        lines = held[:end].decode(errors="replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        if head.get("content-length", "").isascii() and head.get("content-length", "").isdigit():
            stop = start + int(head["content-length"])
        else:
            while (stop := held.find(b"\r\n\r\nWARC/", start)) < 0 and more():
                pass
            if stop < 0:
                stop = len(held) - 4 if held.endswith(b"\r\n\r\n") and len(held) >= start + 4 else len(held)
                yield head, bytes(held[start:stop])
                return
        while len(held) < stop + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        yield head, bytes(held[start:stop])
        del held[: stop + 4]


#: Columns of records as read, and those of ``read_archives`` before them: the archive, the
#: record's number there and the digest that its header states.
RECORD_SCHEMA = "record_id long, record_type string, uri string, date string, content_type string, payload_digest string, payload_bytes long, refers_to long"
READ_SCHEMA = "file string, at int, stated string, " + RECORD_SCHEMA
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], schema: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, of about ``most_bytes`` bytes of payload (a row's last value)."""
    names, kinds = zip(*((f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")), strict=True)
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += 200 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


_PAGE_URN = re.compile(r"<urn:page:(-?[0-9]{1,19})>")


def _number(urn: str | None) -> int | None:
    """The number of a page's id (other ids, and numbers beyond 64 bits: none)."""
    found = _PAGE_URN.fullmatch(urn or "")
    number = int(found[1]) if found else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record (``READ_SCHEMA``, and ``payload`` as bytes), in any number of gzip members.

    Digest and size are taken from the payload itself; a revisit has none: its digest is the
    header's and its size null.  Ids that are no page's numbers, and headers that a record
    lacks, are null.  A folder without archives gives an empty table.
    """
    schema = READ_SCHEMA + ", payload binary" * with_payload

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, (head, block) in enumerate(parse(content.as_py())):
                    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    revisit = head.get("warc-type") == "revisit"
                    digest = stated if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                    row = (
                        file, at, stated, _number(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"),
                        head.get("content-type"), digest, None if revisit else len(block), _number(head.get("warc-refers-to")),
                    )
                    yield (*row, block) if with_payload else row

    return _files(spark, path).mapInArrow(lambda batches: _batches(records(batches), schema), schema)


def page_records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: Column | None = None) -> DataFrame:
    """Response records of a table of pages, payload the html in UTF-8 (null: empty).

    ``date`` (``yyyy-MM-ddTHH:mm:ssZ``, null: the time of writing) is when pages were fetched.  A
    null id or address stays null, repeated rows are records of their own, other columns are
    not read, and an empty table has no records.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(uri_col).alias("uri"),
        (F.lit(None) if date is None else date).cast("string").alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        payload.alias("payload"),
        base32_sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit(None).cast("long").alias("refers_to"),
    )


def _fresh(files: DataFrame) -> DataFrame:
    """Records of archives (``path``, ``content``) under their decisions (``decided``)."""
    schema = RECORD_SCHEMA + ", payload binary"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content, decided in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = {d["at"]: d for d in decided or []}
                for at, (head, block) in enumerate(parse(content.as_py())):
                    kind, refers = head.get("warc-type"), _number(head.get("warc-refers-to"))
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if at in own:
                        digest = own[at]["payload_digest"]
                        if own[at]["original"] is not None:
                            kind, refers, block = "revisit", own[at]["original"], b""
                    yield (
                        _number(head.get("warc-record-id")), kind, head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"),
                        digest, len(block), refers, block,
                    )

    return files.mapInArrow(lambda batches: _batches(records(batches), schema), schema)


def resolve(spark: SparkSession, source: str, target: str, *, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Read the archives under ``source``, write deduplicated ones to ``target``.

    Of the responses with equal payload digest and at least ``min_bytes`` bytes, the one with
    the largest id stays a response and the others become revisits of it, with fresh headers
    and no payload; smaller ones stay responses.  A revisit that the source has refers to that
    original too, if there is one, and stays as it is if not.  Records of other types are
    copied.  A record without an id is copied and never referred to.  Ids are meant to be
    unique; records that repeat the id of an original stay responses.  Digests are those of the
    payloads, whatever the headers say.  Without archives, the target is an empty folder.
    """
    headers = cut(read_archives(spark, source).drop("uri", "date", "content_type"))
    response = (F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)
    # Written first, so that the join below deals both its sides and can split a hot payload.
    originals = cut(
        headers.where("record_type IN ('response', 'revisit')")
        .groupBy(F.col("payload_digest").alias("digest")).agg(F.max(F.when(response, F.col("record_id"))).alias("newest"), F.count("*").alias("n"))
        .where("n > 1 AND newest IS NOT NULL").drop("n")
    )
    revisit = response | (F.col("record_type") == "revisit")
    decided = (
        headers.join(originals, F.col("payload_digest") == F.col("digest"), "left")
        .select("file", "at", "stated", "payload_digest", F.when(revisit & (F.col("record_id") != F.col("newest")), F.col("newest")).alias("original"))
    )
    by_file = (
        decided.where(F.col("original").isNotNull() | ~F.col("payload_digest").eqNullSafe(F.col("stated")))
        .groupBy("file").agg(F.collect_list(F.struct("at", "payload_digest", "original")).alias("decided"))
    )
    files = _files(spark, source).join(by_file.hint("shuffle_hash"), F.col("path") == F.col("file"), "left")
    write_archives(_fresh(files.select("content", "decided")), target, file_bytes=file_bytes)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """Records of deduplicated archives; a revisit has the size of the response it refers to.

    Ids, addresses and types are those of the records (see ``read_archives``); a revisit whose
    original isn't there has a null size.
    """
    rows = cut(read_archives(spark, path).drop("file", "at", "stated", "date", "content_type"))
    sizes = rows.where("record_type = 'response' AND record_id IS NOT NULL").select(
        F.col("record_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes")
    )
    # Each digest and original is one row, so a response that many revisit is no hot key here.
    wanted = rows.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    sizes = cut(sizes.join(wanted, (F.col("of") == F.col("refers_to")) & (F.col("of_digest") == F.col("payload_digest")), "left_semi").distinct())
    joined = rows.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return joined.select(
        "record_id", "uri", "record_type", "payload_digest",
        F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "refers_to",
    )
