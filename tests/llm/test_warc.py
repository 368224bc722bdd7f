"""Archives: round trips, and magic inside payloads."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from shoptrail.llm import queries, warc
from tests.llm.helpers import SF_DIR, load

PAGE = "page_id long, url string, html string"


def plain(rows, least=100):
    first = {}
    for page_id, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and page_id is not None:
            first[raw] = min(page_id, first.get(raw, page_id))
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        own = first.get(raw)
        again = own is not None and own != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(),
                    "revisit" if again else "response", own if again else None))
    return sorted(out, key=repr)


def result(df):
    picked = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def test_query_equals_plain_version(spark):
    rows = [(r.page_id, r.html) for r in load(spark, "pages").collect()]
    assert result(queries.op6_warc(spark, SF_DIR)) == plain(rows)


def fake(length):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {length}\r\n\r\n"


def test_edge_pages(spark, tmp_path):
    long = "é" * 400_000
    body = "same payload " * 10
    pages = [
        (1, "u", None), (2, None, ""), (3, "a\r\nContent-Length: 1", "x"), (4, "u", "x"),
        (5, "u", body), (6, "u", body), (6, "v", body), (5, "u", body), (None, "u", body),
        (7, "u", fake(3) + "abc\r\n\r\n" + fake(0) + "\r\n\r\n" + "end " * 30),
        (8, "u", "WARC/1.1\r\n" * 40), (9, "u", "WARC/WARC/1.1\r\n\r\n\r\nWARC/1.1\r"),
        (10, "u", long), (-3, "u", fake(10**12)), (11, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n12345"),
        (12, "u", "WARC/1.1\r\n" * 40), (13, "u", "\r\n\r\n"), (14, "u", "\x00\x1c "),
    ]
    df = spark.createDataFrame(pages, PAGE).repartition(3).withColumn("digest", F.lit(1))
    want = plain([(p, h) for p, _, h in pages])
    for how in ("gzip", "none"):
        path = str(tmp_path / how)
        warc.write_archive(df, path, compression=how)
        got = warc.read_archive(spark, path)
        assert result(got) == want
        assert got.where("NOT intact").count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:  # records that span the pieces of a file
        assert result(warc.read_archive(spark, path)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    empty = str(tmp_path / "empty")
    warc.write_archive(df.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "plain")
    rows = [(1, "http://a", "hello"), (2, "http://b", "")]
    warc.write_archive(spark.createDataFrame(rows, PAGE).coalesce(1), path, compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "plain").glob("part-*")))
    at, by_url = 0, {url: html for _, url, html in rows}
    for _ in rows:
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
        html = by_url.pop(re.search(rb"WARC-Target-URI: (\S*)", head)[1].decode())
        assert rest[: len(html) + 4] == html.encode() + b"\r\n\r\n"
        at += len(head) + 4 + len(html) + 4
    assert at == len(raw)


def test_pointer_jumping():
    rng = np.random.default_rng(0)
    for _ in range(50):
        starts = np.unique(rng.integers(0, 200, 60))
        starts[0] = 0
        following = starts + rng.integers(1, 9, len(starts))
        want, at = set(), 0
        known = dict(zip(starts.tolist(), following.tolist(), strict=True))
        while at in known:
            want.add(at)
            at = known[at]
        assert set(starts[warc.reachable(starts, following)].tolist()) == want
