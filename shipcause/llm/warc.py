"""Legacy web archives: write ARC, convert ARC to WARC, read WARC.

ARC files start with a version block. Version 1 header lines have five fields, version 2 lines ten; the block
itself names them, and the last one declares the length of what follows. The converter makes WARC/1.1
records of it: identifiers from page and digest, ISO timestamps from 14-digit dates, types from the version
block and the media type, digests from the payload. Payloads that occurred before become revisits.

Files are written by Spark's text sink, whose line separator is the separator of records, compressed with
gzip. Reading streams through one file at a time, record by record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import kept, ship_package, table
from shipcause.sources.store import new_folder

#: Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length",
    ],
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads shorter than this are stored each time.
REVISIT_BYTES = 100
RECORDS_PER_BATCH = 256
#: Up to so many revisits (100 bytes each) are broadcast; beyond, records are joined to them by shuffling.
BROADCAST_REVISITS = 200_000

CRLF = "\r\n"


# ---- ARC ------------------------------------------------------------------------


def write_arc(pages: DataFrame, path: str) -> str:
    """``pages`` (``page_id``, ``url``, ``html``) as ARC files, one per partition, half of them of each version.

    The content of a record is the HTTP response; its head carries the page id, and no id where that is NULL.
    NULL html is an empty payload. White space in an URL is written as %20, a missing URL as urn:page:unknown.
    """
    body = F.coalesce("html", F.lit(""))
    has_id = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF), has_id, F.lit(CRLF), body,
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    url = F.when(url == "", F.lit("urn:page:unknown")).otherwise(url)
    date = F.date_format(F.timestamp_seconds(F.lit(946_684_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**8))), "yyyyMMddHHmmss")
    rows = pages.select(
        url.alias("url"), date.alias("date"), block.alias("block"),
        (F.spark_partition_id() % 2 + 1).alias("version"), F.monotonically_increasing_id().alias("row"),
    )
    length = F.octet_length("block").cast("string")
    line = F.when(F.col("version") == 1, F.concat_ws(" ", "url", F.lit("0.0.0.0"), "date", F.lit("text/html"), length)).otherwise(
        F.concat_ws(" ", "url", F.lit("0.0.0.0"), "date", F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-"), length)
    )
    opening = F.when(F.col("version") == 1, F.lit(_version_block(1))).otherwise(F.lit(_version_block(2)))
    first = F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, so of its file
    record = F.concat(F.when(first, F.concat(opening, F.lit("\n"))).otherwise(F.lit("")), line, F.lit("\n"), "block")
    rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


def _version_block(version: int) -> str:
    names = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 shipcause\n{names}\n"
    return f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain {len(body)}\n{body}"


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """Version, header fields, content and whether that is cut short, for each record of an ARC stream.

    The field names are those of the last version block read, so files that were joined parse as well.
    """
    version, names = 1, ARC_FIELDS[1]
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").split()
        if not (values[-1].isascii() and values[-1].isdigit()):
            raise ValueError(f"no length at the end of an ARC header line: {line[:200]!r}")
        content = stream.read(int(values[-1]))
        cut = len(content) < int(values[-1])
        if values[0].startswith("filedesc:"):
            about = content.decode("utf-8", "replace").split("\n")
            version, names = int(about[0].split()[0]), about[1].split()
            yield version, dict(zip(ARC_FIELDS[1], values, strict=False)), content, cut
        else:
            # an URL may hold spaces in old files: all but the last fields belong to it
            extra = len(values) - len(names)
            yield version, dict(zip(names, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=False)), content, cut


BLANK_LINE = re.compile(rb"\r?\n\r?\n")
PAGE_NUMBER = re.compile("-?[0-9]{1,19}")


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields by lower-case name, and body of an HTTP response.

    Lines of the head end with CR LF, or with LF alone as in many old archives.
    """
    if block.startswith(b"HTTP/"):
        blank = BLANK_LINE.search(block)
        end = blank.end() if blank else 0
    else:
        end = block.find(b"\r\n\r\n") + 4 if b"\r\n\r\n" in block else 0
    head = block[:end]
    pairs = [x.rstrip("\r").partition(":") for x in head.decode("utf-8", "replace").split("\n")[1:] if x.strip("\r")]
    return head, {k.strip().lower(): v.strip() for k, _, v in pairs}, block[end:]


def page_number(text: str) -> int | None:
    """A 64-bit number written in ASCII digits, else None."""
    number = int(text) if PAGE_NUMBER.fullmatch(text) else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def iso_date(digits: str) -> str:
    """``20240131235959`` as ``2024-01-31T23:59:59Z``; shorter or broken dates are filled up from 1970-01-01."""
    digits = re.sub(r"\D", "", digits)[:14]
    d = digits + "19700101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def _files(spark: SparkSession, path: str, read: Callable[[io.BufferedIOBase], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``read`` makes of the files below ``path``."""
    ship_package(spark)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if bytes(content[:2]) == b"\x1f\x8b" else raw
                rows = []
                for row in read(stream):
                    rows.append(row)
                    if len(rows) == RECORDS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the ARC files below ``path`` as what a WARC record needs; without payloads a few bytes each."""

    def rows(stream: io.BufferedIOBase) -> Iterator[dict]:
        for version, fields, content, cut in arc_records(stream):
            kind = "warcinfo" if fields["URL"].startswith("filedesc:") else "response"
            head, http, body = http_parts(content) if kind == "response" else (b"", {}, content)
            yield {
                "kind": kind, "arc_version": version, "page_id": page_number(http.get("x-page-id", "")),
                "url": fields["URL"], "ip": fields["IP-address"], "date": iso_date(fields["Archive-date"]),
                "mime": fields["Content-type"], "cut": cut, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(),
                **({"head": head, "payload": body} if payloads else {}),
            }

    schema = (
        "kind string, arc_version int, page_id bigint, url string, ip string, date string, mime string, cut boolean, "
        "payload_bytes bigint, payload_digest string"
    )
    return _files(spark, path, rows, schema + (", head binary, payload binary" if payloads else ""))


# ---- WARC -----------------------------------------------------------------------


def record_id(page_id: Column, digest: Column) -> Column:
    """An identifier that follows from the page and its payload."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def convert(spark: SparkSession, arc: str, warc: str) -> str:
    """The ARC files below ``arc`` as WARC files below ``warc``.

    Of responses with equal payloads of at least 100 bytes the one with the smallest page id keeps it; those
    with a larger id become revisits of it. Records without page id are responses. Which pages are revisits is
    found among digests alone, counted per map task first; payloads are not compared or grouped.
    """
    brief = read_arc(spark, arc, payloads=False).filter(
        (F.col("kind") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    ).select("page_id", "payload_digest")
    firsts = brief.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    revisits = (
        brief.join(firsts.filter("last > refers_to"), "payload_digest")
        .filter("page_id > refers_to")
        .groupBy("page_id", "payload_digest").agg(F.min("refers_to").alias("refers_to"))
    )
    revisits = kept(revisits, "revisits")
    few = revisits.count() <= BROADCAST_REVISITS  # then payloads stay where they are read
    records = read_arc(spark, arc).join(F.broadcast(revisits) if few else revisits, ["page_id", "payload_digest"], "left")
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    again = F.col("refers_to").isNotNull()
    digest = F.col("payload_digest")
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    info = F.col("kind") == "warcinfo"
    media = F.when(info, F.lit("application/warc-fields")).when(F.length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    kind = F.when(again, F.lit("revisit")).when(~info & (F.length("head") == 0), F.lit("resource")).otherwise(F.col("kind"))
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.when(info, F.concat_ws("|", "url", "date", digest)).otherwise(digest))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.when(~info, F.col("url"))),
        field("WARC-IP-Address", F.when(~info, F.col("ip"))),
        field("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha256:"), digest))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        field("WARC-Truncated", F.when(F.col("cut"), F.lit("length"))),
        field("WARC-Profile", F.when(again, F.lit(IDENTICAL))),
        field("WARC-Refers-To", F.when(again, record_id(F.col("refers_to"), digest))),
        field("X-Refers-To-Page-Id", F.col("refers_to")),
        field("Content-Type", media),
        field("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    # a cast from binary keeps the bytes as they are, whatever their charset
    whole = F.concat(text.cast("binary"), block).cast("string")
    records.select(whole.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").text(warc)
    return warc


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name, and block, of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:200]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError(f"{fields.get('warc-record-id')} ends before its declared length")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the WARC files below ``path``.

    Payload size and digest of a response are taken from the payload itself, which must have the digest that
    its header claims; those of a revisit, which has none, from its headers.
    """

    def rows(stream: io.BufferedIOBase) -> Iterator[dict]:
        for fields, block in warc_records(stream):
            if fields["warc-type"] not in ("response", "revisit"):
                continue
            _, http, body = http_parts(block)
            claimed = fields["warc-payload-digest"].removeprefix("sha256:")
            if fields["warc-type"] == "response":
                size, digest = len(body), hashlib.sha256(body).hexdigest()
                if digest != claimed:
                    raise ValueError(f"{fields['warc-record-id']}: the payload is not the one that was written")
            else:
                size, digest = int(http["content-length"]), claimed
            yield {
                "page_id": int(http["x-page-id"]) if "x-page-id" in http else None, "payload_bytes": size, "payload_digest": digest,
                "record_type": fields["warc-type"], "refers_to": int(r) if (r := fields.get("x-refers-to-page-id")) else None,
                "warc_record_id": fields["warc-record-id"], "warc_date": fields["warc-date"],
            }

    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "warc_record_id string, warc_date string"
    )
    return _files(spark, path, rows, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """``pages`` written as ARC, converted to WARC and read back: one row per page.

    Repeated rows stay, an empty table gives no rows, columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, new_folder(spark, "arc"))
    return read_warc(spark, convert(spark, arc, new_folder(spark, "warc")))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first_id from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when page_id > first_id then 'revisit' else 'response' end record_type,
       case when page_id > first_id then first_id end refers_to
from p left join f on f.payload_digest = p.payload_digest
"""
