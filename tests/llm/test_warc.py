"""WARC round trips and split independence."""

import base64
import gzip
import hashlib
import io

import pytest

from vigil.llm.common import scratch
from vigil.llm.warc import decode_record, encode_record, list_archives, mark_revisits, read_warc, scan_range, write_warc

ROWS = [(3, "http://a/x", "same"), (1, "http://b\r\nX: 1/é ?q=1", "same"), (2, None, None), (7, "u", ""), (5, "u", "é\r\n\r\nWARC/1.0\r\n" * 40),
        (5, "u", "é\r\n\r\nWARC/1.0\r\n" * 40), (None, "n", "same"), (None, "n", "alone"), (9, "z", "x" * 300_000), (1, "v", "same")]


def brute(rows, least=0):
    groups = {}
    for i, u, p in rows:
        groups.setdefault((p or "").encode(), []).append(i)
    out = []
    for raw, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        digest, seen = base64.b32encode(hashlib.sha1(raw).digest()).decode(), False
        for i in ids:
            own = (i == first and not seen) or len(raw) < least
            seen |= i == first
            out.append((i, len(raw), digest, "response" if own else "revisit", None if own else f"<urn:page:{'' if first is None else first}>"))
    return sorted(out, key=str)


def read(spark, folder, **kw):
    return sorted((((int(r.record_id[10:-1]) if r.record_id != "<urn:page:>" else None), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in read_warc(spark, list_archives(spark, folder), **kw).collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, 1, "p") for r in ROWS], "page_id long, url string, html string, path long, payload string").repartition(3)
    folder = scratch(spark, "warc-test")
    manifest = write_warc(df, folder, min_bytes=least).collect()
    assert sum(m.records for m in manifest) == len(ROWS)
    want = brute(ROWS, least)
    assert read(spark, folder) == want
    for split in (100, 1000, 1 << 20):  # records belong to the range they start in, whatever the ranges
        assert read(spark, folder, split_bytes=split, with_payload=False) == want
    payloads = sorted(bytes(r.payload) for r in read_warc(spark, list_archives(spark, folder)).where("record_type = 'response'").collect())
    if least == 10**9:
        assert payloads == sorted((p or "").encode() for _, _, p in ROWS)
    else:
        assert set(payloads) == {(p or "").encode() for _, _, p in ROWS}


def test_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    write_warc(df, f"file://{tmp_path}/a")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("*.warc.gz")))
    assert text.count(b"WARC/1.0\r\nWARC-Type: re") == len(ROWS) and b"\r\nX: 1" not in text.split(b"HTTP/1.1")[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = write_warc(df, scratch(spark, "warc-test"))
    assert manifest.collect() == [] and read_warc(spark, manifest.select("path", "bytes")).collect() == []


def test_scan_skips_false_magic():
    good = [encode_record(i, "u", b"p%d" % i, "00" * 20, None, "d") for i in range(3)]
    decoy = b"\x1f\x8b\x08" + b"junk" + gzip.compress(b"no record") + b"\x1f\x8b"
    data = good[0] + decoy + good[1] + good[2]
    for cut in range(1, len(data), 7):
        got = [decode_record(d)["record_id"] for a, b in ((0, cut), (cut, len(data))) for _, d in scan_range(io.BytesIO(data), a, b)]
        assert got == [f"<urn:page:{i}>" for i in range(3)]
    with pytest.raises(ValueError):
        list(scan_range(io.BytesIO(encode_record(1, "u", bytes(range(256)) * 400, "00" * 20, None, "d")[:-9]), 0, 100))


def test_no_aggregate_between_shuffle_and_join(spark):
    marked = mark_revisits(spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", None)], "page_id long, url string, html string"))
    assert "Aggregate" not in marked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.refers_to) for r in marked.collect()) == [(1, None), (2, "<urn:page:1>"), (3, None)]
