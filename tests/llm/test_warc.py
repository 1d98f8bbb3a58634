"""WARC writing and reading: round trips, revisits, and archives that are broken on purpose."""

import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import warc


def record(block, **more):
    label = warc.digest_label(hashlib.sha1(block).hexdigest())
    return warc.encode_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Digest": label} | more, block)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.sampled_from([1, 7, 1 << 16]))
def test_round_trip(blocks, size):
    old, warc.READ_BYTES = warc.READ_BYTES, size
    try:
        got = list(warc.read_records(io.BytesIO(b"".join(map(record, blocks)))))
    finally:
        warc.READ_BYTES = old
    assert [r.block for r in got] == blocks


def test_one_gzip_member_per_record():
    data = record(b"a" * 50) + record(b"b")
    z = zlib.decompressobj(31)
    z.decompress(data)
    assert z.eof and z.unused_data == record(b"b") and gzip.decompress(data).count(b"WARC/1.1") == 2


@pytest.mark.parametrize("data", [record(b"abc")[:-5], record(b"abc", **{"WARC-Payload-Digest": warc.digest_label("00" * 20)}), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"nothing"), gzip.compress(b"WARC/1.1\r\n\r\nabc\r\n\r\n"), b"not gzip"])
def test_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


@pytest.mark.parametrize("data", [gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: -1\r\n\r\n\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nx"), gzip.compress(b"x" * (1 << 20))])
def test_broken_framing(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_long_record_passes_in_pieces():
    block, after = b"0123456789abcdef" * (1 << 20), b"next"
    data = io.BytesIO(record(block) + record(after))
    got, longest = [], 0
    for headers, pieces in warc.streamed_records(data):
        n = 0
        for piece in warc.verified(headers, pieces):
            n, longest = n + len(piece), max(longest, len(piece))
        got.append(n)
    assert got == [len(block), len(after)] and longest <= 4 * warc.READ_BYTES
    data.seek(0)
    assert [h["Content-Length"] for h, _ in warc.streamed_records(data)] == [str(len(block)), "4"]  # blocks left unread


def test_payloads_on_request(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a" * 2000), (2, "a" * 2000), (3, None)], "page_id long, html string").withColumn("url", warc.F.lit(None).cast("string"))
    archives = warc.write_archives(warc.plan_records(pages), f"{tmp_path}/w")
    whole = {r.page_id: (r.payload, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, archives).collect()}
    bare = {r.page_id: (r.payload, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, archives, payload=False).collect()}
    assert {k: bytes(v[0]) for k, v in whole.items()} == {1: b"", 2: b"a" * 2000, 3: b""}
    assert {k: v[1:] for k, v in whole.items()} == {k: v[1:] for k, v in bare.items()} and all(v[0] is None for v in bare.values())


def brute(rows, least=1000):
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == payload and p is not None]
        top = max(same, default=None)
        revisit = len(payload) >= least and top is not None and page != top
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_query(spark, tmp_path):
    long, other = "é" * 700, "x" * 1000
    rows = [(1, long), (5, long), (3, long), (5, long), (None, long), (7, other), (8, other[:-1]), (9, other[:-1]), (10, None), (11, ""), (12, "<p>\r\n\r\nWARC/1.1</p>\r\n\r\n"), (None, None), (13, "z" * 300_000)]
    spark.createDataFrame([(p, h, None if p == 7 else f"http://a b/{p}\n", "x", 1) for p, h in rows], "page_id long, html string, url string, record_type string, payload_bytes int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.op1_warc(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, html string, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).collect() == []
