"""WARC archives of pages: written with revisit records for copies, read back by a salvage reader.

The reader checks every member and record (gzip trailer, headers, lengths,
digests). Where a check fails it searches for the next gzip member or version
line that holds a valid record, goes on there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.textwork import map_batches, pick
from coppice.operators.lookup import WEIGHT, attach, freeze
from coppice.session import scratch_path

#: Bytes of payload that one archive file holds on average at most; a reader holds a whole file.
FILE_BYTES = 1 << 25
#: Compressed bytes given to the decompressor at once, and payload bytes handed on at once.
CHUNK, HANDED_ON = 1 << 14, 1 << 24
#: The longest header that is looked at.
HEADER_LIMIT = 1 << 20
# Fixed values of the format: an empty gzip member, the start of a member or record, the profile of a revisit.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_COLUMNS = ("archive string, offset long, length long, gap string, warc_type string, record_id string, "
                  "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")


def digest(data) -> str:
    """The upper-case base32 SHA-1 of ``data``."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_name(page_id: str | None) -> str:
    """The record id of a page; a null id has a name without one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(name: str | None) -> str | None:
    """The page id in a record id made by :func:`page_name`."""
    return unquote(name[10:-1]) if name is not None and name.startswith("<urn:page:") else None


def make_record(kind: str, name: str, uri: str, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record with an HTTP block; a revisit has the HTTP header alone, and the digest of the whole payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
              ("WARC-Block-Digest", "sha1:" + digest(block)), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", SAME_PAYLOAD)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _originals(rows: DataFrame, least: int) -> DataFrame:
    """Payloads that stand in more than one row: their SHA-256, row count and largest page id."""
    return (
        rows.where(F.length("payload") >= least)
        .groupBy(_key().alias("key"))
        .agg(F.count(F.lit(1)).alias(WEIGHT), F.max("page_id").alias("last_id"))
        .where(F.col(WEIGHT) > 1)
        .withColumn("shared", F.lit(True))
    )


def _key() -> Column:
    return F.unhex(F.sha2("payload", 256))


def write_archives(pages: DataFrame, path: str, least: int = 0, compressed: bool = True, id_column: str = "page_id",
                   url_column: str = "url", text_column: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row below ``path``, through Spark's text writer.

    Rows of equal payload (the text in UTF-8, null as empty) of at least
    ``least`` bytes are one ``response``, that of the largest id, and
    ``revisit`` records that refer to it; a null id is smaller than any other.
    Rows that also share that id are all ``response``, and so are shorter
    payloads. ``date`` is the capture time of all records. Records are named
    after their page ids, so a repeated id gives a repeated name. A null url is
    written as the record's name; line breaks in one are percent-encoded. With
    ``compressed`` each record is a gzip member of its own, otherwise the files
    are plain. No rows give an empty folder. Other columns are not read.

    Only the digests of payloads that occur more than once are joined back:
    by broadcast while they are few, otherwise by a shuffle in which frequent
    ones are spread.
    """
    rows = pick(pages, page_id=id_column, url=url_column, html=text_column).select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    table = freeze(_originals(rows, least), ["key"])
    key = F.when(F.length("payload") >= least, _key())
    # A hash of the id keeps rows of one payload apart where they are spread, without reading the payload twice.
    typed = attach(rows.withColumn("spread", F.xxhash64("page_id")), table, {"key": key},
                   {"last_id": "last_id", "shared": "shared"})
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    ready = typed.select(F.col("page_id").cast("string"), F.col("url"), "payload", revisit.alias("revisit"),
                         F.col("last_id").cast("string"))

    def work(batch):
        ids, urls, payloads, again, last = (c.to_pylist() for c in batch.columns)
        made, size = [], 0
        for page, url, payload, revisits, original in zip(ids, urls, payloads, again, last):
            name = page_name(page)
            uri = name[1:-1] if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
            record = make_record("revisit" if revisits else "response", name, uri,
                                 page_name(original) if revisits else None, payload, date)
            if compressed:
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                record = packer.compress(record) + packer.flush()
            else:
                record = record[:-2]  # the line separator ends it
            made.append(record)
            size += len(record)
            if size > HANDED_ON:
                yield {"record": pa.array(made, pa.binary())}
                made, size = [], 0
        yield {"record": pa.array(made, pa.binary())}

    mean = rows.agg(F.avg(F.length("payload"))).first()[0] or 0
    # The writer puts a separator behind each record: the end of a plain record, or a gzip member without content.
    separator = EMPTY_MEMBER.decode("latin-1") if compressed else "\r\n"
    writer = map_batches(ready, work, "record binary").select(F.col("record").cast("string")).write
    writer = writer.option("encoding", "ISO-8859-1").option("lineSep", separator)
    writer.option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 512)))).text(path)


class Damaged(ValueError):
    """A record that fails a check; the message is the reason logged for the gap."""


@dataclass(frozen=True)
class Record:
    kind: str
    fields: dict[str, str]
    payload_bytes: int | None
    payload: bytes | None


def _digest_fails(stated: str | None, data) -> bool:
    """Whether a stated SHA-1 digest differs; other algorithms are not checked."""
    name, _, value = (stated or "").partition(":")
    return name.lower() == "sha1" and value.upper() != digest(data)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def read_record(data: bytes, at: int) -> tuple[Record, int]:
    """The checked record that starts at ``at``, and where it ends."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    start = data.find(b"\r\n\r\n", version.end() - 2, at + HEADER_LIMIT)
    if start < 0:
        raise Damaged("no end of header")
    fields = _fields(data[version.end() : start])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise Damaged("no " + min(missing))
    if not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        raise Damaged("content-length is no number")
    first = start + 4
    last = first + int(fields["content-length"])
    if last + 4 > len(data):
        raise Damaged("truncated record")
    if data[last : last + 4] != b"\r\n\r\n":
        raise Damaged("no end of record")
    block = memoryview(data)[first:last]
    if _digest_fails(fields.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    kind, size, payload = fields["warc-type"].lower(), last - first, block
    if fields.get("content-type", "").lower().startswith("application/http"):
        body = data.find(b"\r\n\r\n", first, last)
        payload = memoryview(data)[body + 4 if body >= 0 else last : last]
        size = len(payload)
        if kind == "revisit":
            stated = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})\r\n", data[first : max(body, first) + 2])
            size = int(stated[1]) if stated else None
    if kind != "revisit" and _digest_fails(fields.get("warc-payload-digest"), payload):
        raise Damaged("payload digest differs")
    return Record(kind, fields, size, None if kind == "revisit" else bytes(payload)), last + 4


def unpack_member(data, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that starts at ``at``, and where it ends; its checksum must fit."""
    unpacker, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            chunk = data[end : end + CHUNK]
            if not chunk:
                raise Damaged("truncated member")
            parts.append(unpacker.decompress(chunk))
            end += len(chunk)
    except zlib.error:
        raise Damaged("damaged member") from None
    return b"".join(parts), end - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """Offset, length and record of every valid record, or reason of every gap, in the order of ``data``.

    A member of several records gives each of them with the member's place;
    damage inside a valid member is a gap of that place as well.
    """
    at, lost, reason = 0, -1, ""
    while at < len(data):
        try:
            if data[at : at + 3] == MEMBER:
                content, end = unpack_member(data, at)
                found = list(salvage(content)) if content else []
                if content and not any(isinstance(x, Record) for _, _, x in found):
                    raise Damaged("member without a record")
                found = [(at, end - at, x) for _, _, x in found]
            else:
                record, end = read_record(data, at)
                found = [(at, end - at, record)]
        except Damaged as damage:
            if lost < 0:
                lost, reason = at, str(damage)
            ahead = START.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if lost >= 0:
            yield lost, at - lost, reason
            lost = -1
        yield from found
        at = end
    if lost >= 0:
        yield lost, len(data) - lost, reason


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of all archives below ``path``, plain or compressed, whatever their names.

    One row per record (``gap`` null) or quarantined gap (``gap`` its reason):
    ``archive``, ``offset`` and ``length`` of its bytes, ``warc_type``,
    ``record_id``, ``refers_to``, ``target_uri``, ``payload_digest`` (without
    the algorithm's name), ``payload_bytes`` and, if asked for, ``payload``.
    For a revisit the size is that of the payload it stands for, as its HTTP
    header says, or null. A file is read by one task and held in memory, at
    most 2 GB of it; empty files and folders give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def work(batch):
        names = [f.split()[0] for f in RECORD_COLUMNS.split(", ")]
        for name, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for offset, length, x in salvage(content.as_py() or b""):
                place = (name.as_py(), offset, length)
                if isinstance(x, str):
                    rows.append((*place, x, *[None] * 7))
                    continue
                stated = x.fields.get("warc-payload-digest")
                rows.append((*place, None, x.kind, x.fields["warc-record-id"], x.fields.get("warc-refers-to"),
                             x.fields.get("warc-target-uri"), stated and stated.partition(":")[2], x.payload_bytes,
                             x.payload if payloads else None))
                size += len(rows[-1][-1] or b"")
                if size > HANDED_ON or len(rows) == 10_000:
                    yield _columns(names, rows)
                    rows, size = [], 0
            yield _columns(names, rows)

    return map_batches(files, work, RECORD_COLUMNS)


def _columns(names: list[str], rows: list[tuple]) -> dict:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    columns = zip(*rows) if rows else [()] * len(names)
    return {n: pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, columns)}


def archive_pages(pages: DataFrame, least: int = 0, id_column: str = "page_id", url_column: str = "url",
                  text_column: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back.

    One row per page: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``, as :func:`write_archives` says, taken
    from the records alone.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least, True, id_column, url_column, text_column)
    kind = pick(pages, page_id=id_column).schema["page_id"].dataType
    return page_records(read_archives(spark, path), kind)


def page_records(records: DataFrame, id_type="bigint") -> DataFrame:
    """The page ids and digests in what :func:`read_archives` gives; gaps and records of other kinds are left out."""
    def page(name: str) -> Column:
        inside = F.regexp_extract(name, "^<urn:page:(.*)>$", 1)
        return F.when(F.col(name).startswith("<urn:page:"), F.try_url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))).cast(id_type)

    return records.where(F.col("gap").isNull() & F.col("warc_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"))
