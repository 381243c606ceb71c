"""WARC archives: any cut into ranges gives every record once."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statepath.llm import warc
from statepath.llm.common import shared_files
from statepath.storage import new_path

PAGES = [
    (1, "http://a/", "same"), (2, None, "same"), (2, "http://b/", "same"), (3, "a b\n", None),
    (4, "c", ""), (None, "d", "same"), (None, "e", "alone"), (7, "f", "alone"),
    (8, "g", "y\r\n\r\nWARC/1.1\r\n\r\n"), (9, "h", "ü" * 300_000),
]


def frame(spark, rows):
    rows = [(*r, "clash") for r in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("range_bytes", [40, 500, 1 << 20])
def test_round_trip(spark, range_bytes):
    rows = PAGES + [(i, "z", chr(200 + i % 50) * (i * 37 % 3000)) for i in range(20, 120)]
    found = warc.round_trip(frame(spark, rows), range_bytes)
    found = found.withColumn("page_id", warc.row_of("record_id")).withColumn("original", warc.row_of("refers_to"))
    best = {}
    for i, _, html in rows:
        known = best.get(html or "")
        best[html or ""] = max(x for x in (i, known, -1) if x is not None)
    expected = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = best[html or ""] not in (i, -1)
        payload = None if revisit else body
        digest = warc.payload_digest(body)
        expected.append((i, "revisit" if revisit else "response", digest, len(body), payload, best[html or ""] if revisit else None))
    got = [
        (r.page_id, r.record_type, r.payload_digest, r.payload_length, r.payload and bytes(r.payload) if r.payload else r.payload, r.original)
        for r in found.collect()
    ]
    tidy = lambda x: sorted((str(a), b, c, d, bytes(e) if e is not None else None, f) for a, b, c, d, e, f in x)
    assert tidy(got) == tidy(expected)


def test_archives_are_gzip_members_and_lost_attempts_are_not_read(spark):
    path = new_path(spark)
    archives = warc.write_archives(frame(spark, PAGES), path, archive_bytes=200)
    listed = archives.collect()
    assert sum(r.n_records for r in listed) == len(PAGES) and len(listed) > 3
    files, root = shared_files(path)
    with files.open_output_stream(f"{root}/lost-attempt.warc.gz", compression=None) as stream:
        stream.write(warc.member(99, "x", b"never reported", "D", None, "1970-01-01T00:00:00Z"))
    for row in listed:
        with files.open_input_file(f"{root}/{row.file}") as source:
            content = gzip.decompress(source.read())
        assert content.count(b"WARC-Record-ID") == row.n_records
    assert warc.read_archives(spark, path, archives).count() == len(PAGES)


def test_magic_that_is_no_member_is_passed_over(spark):
    member = warc.member(5, None, b"payload", warc.payload_digest(b"payload"), None, "1970-01-01T00:00:00Z")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = packer.compress(b"no record") + packer.flush()
    data = member + warc.MAGIC + b"junk" + member + other + member + warc.MAGIC
    path = new_path(spark)
    files, root = shared_files(path)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/x.warc.gz", compression=None) as stream:
        stream.write(data)
    archives = spark.createDataFrame([("x.warc.gz", len(data))], "file string, n_bytes long")
    assert warc.read_archives(spark, path, archives).count() == 3


def test_a_damaged_payload_is_an_error():
    content = warc.member(5, None, b"payload", "WRONG", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.decompress(content))


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_headers_of_any_length(spark):
    random = np.random.default_rng(2)
    address = "".join(map(chr, random.integers(97, 123, 90_000)))
    pages = [(1, "short", "one"), (2, address, "two"), (3, " " * 30_000, "three"), (4, address[::-1], "four")]
    for range_bytes in (1 << 14, 1 << 16, 1 << 23):
        found = warc.round_trip(frame(spark, pages).coalesce(1), range_bytes=range_bytes)
        uris = {r.record_id: r.target_uri for r in found.select("record_id", "target_uri").collect()}
        assert uris == {f"urn:page:{i}": u.replace(" ", "%20") for i, u, _ in pages}


def test_a_lost_record_is_an_error(spark):
    path = new_path(spark)
    archives = warc.write_archives(frame(spark, PAGES), path)
    more = archives.withColumn("starts", F.concat("starts", F.array(F.col("n_bytes") - 1)))
    with pytest.raises(Exception, match="records read"):
        warc.read_archives(spark, path, more).count()
