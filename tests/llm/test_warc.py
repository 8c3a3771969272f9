import gzip
import io

import pytest
from pyspark.sql import functions as F

from shipcause.llm import warc as warc_module
from shipcause.llm.warc import arc_records, archive_pages, convert, http_parts, iso_date, page_number, read_arc, warc_records, write_arc
from shipcause.sources.store import new_folder

V1 = (
    b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"\nhttp://a.org/x y 1.2.3.4 20010203040507 text/html 12\nHTTP/1.0 200\n"
    b"\nhttp://b.org/ 1.2.3.5 200102 text/plain 5\nhello\n"
)


def test_version_1_lines_and_lengths():
    body = V1[V1.index(b"1 0 Org") : V1.index(b"\nhttp://a")]
    data = V1.replace(b" 76\n", b" %d\n" % len(body), 1)
    rows = list(arc_records(io.BytesIO(data)))
    assert [(v, f["URL"], c, cut) for v, f, c, cut in rows[1:]] == [
        (1, "http://a.org/x y", b"HTTP/1.0 200", False), (1, "http://b.org/", b"hello", False),
    ]
    assert iso_date(rows[1][1]["Archive-date"]) == "2001-02-03T04:05:07Z"
    assert iso_date("200102") == "2001-02-01T00:00:00Z"


def test_cut_and_broken_files():
    rows = list(arc_records(io.BytesIO(b"http://a.org/ 1.2.3.4 20010203040507 text/html 100\nshort")))
    assert rows[0][2:] == (b"short", True)
    with pytest.raises(ValueError, match="no length"):
        list(arc_records(io.BytesIO(b"http://a.org/ and no number\n")))
    assert http_parts(b"no head") == (b"", {}, b"no head")


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_round_trip_of_odd_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc_module, "BROADCAST_REVISITS", broadcast)
    long = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [
        (3, "http://a/", long), (1, "http://b/ c", long), (2, None, long), (4, "", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
        (8, "é", "é🎉" * 60), (None, "n", "é🎉" * 60), (9, "u", "é🎉" * 60), (1, "http://b/ c", long), (10, "u", "y" * 100), (11, "u", "y" * 100),
        (12, "u", "z" * 99), (13, "u", "z" * 99),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in archive_pages(pages).collect())
    refers = {3: 1, 2: 1, 9: 8, 11: 10}
    want = sorted(
        (str(i), len((h or "").encode()), "revisit" if i in refers else "response", str(refers.get(i))) for i, _, h in rows
    )
    assert got == want
    assert archive_pages(pages.limit(0)).collect() == []


def test_files_are_archives_of_both_versions(spark, tmp_path):
    pages = spark.range(6).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.lit("same"), 50).alias("html"))
    arc = write_arc(pages.repartition(2), new_folder(spark, "arc"))
    kinds = read_arc(spark, arc).groupBy("arc_version", "kind").count().collect()
    assert {(r.arc_version, r.kind) for r in kinds} == {(1, "warcinfo"), (2, "warcinfo"), (1, "response"), (2, "response")}
    warc = convert(spark, arc, new_folder(spark, "warc"))
    found = []
    for row in spark.read.format("binaryFile").load(warc).collect():
        found.extend(warc_records(io.BytesIO(gzip.decompress(row.content))))
    types = sorted(f["warc-type"] for f, _ in found)
    assert types == ["response"] + ["revisit"] * 5 + ["warcinfo"] * 2
    first = next(f for f, _ in found if f["warc-type"] == "response")
    assert all(f["warc-refers-to"] == first["warc-record-id"] for f, _ in found if f["warc-type"] == "revisit")
    assert len({f["warc-record-id"] for f, _ in found}) == len(found)


def test_heads_of_old_archives():
    fields = {"content-type": "text/html", "x-page-id": "7"}
    for end in (b"\r\n", b"\n"):
        head = end.join([b"HTTP/1.0 200 OK", b"Content-Type: text/html", b"X-Page-Id: 7", b"", b""])
        assert http_parts(head + b"<html>\r\n\r\nx") == (head, fields, b"<html>\r\n\r\nx")
    assert http_parts(b"HTTP/1.0 200 OK\nno end") == (b"", {}, b"HTTP/1.0 200 OK\nno end")
    assert http_parts(b"<html>\n\n<p>") == (b"", {}, b"<html>\n\n<p>")
    assert http_parts(b"HTTP/1.0 200 OK\n\n") == (b"HTTP/1.0 200 OK\n\n", {}, b"")


def test_page_numbers():
    assert [page_number(t) for t in ("7", "-7", str(2**63 - 1), str(2**63), "²", "", "--7", "7" * 4000)] == [7, -7, 2**63 - 1, None, None, None, None, None]
