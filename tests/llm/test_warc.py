from __future__ import annotations

import hashlib

import pytest

from crawlgrain.llm import warc

SCHEMA = "page_id long, url string, html string, file string, digest string, n int, at long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def expected(rows):
    last = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            last[raw] = max(last.get(raw, i), i)
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = last.get(raw, i) != i
        out.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[raw] if again else None))
    return out


FAKE = "before WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nafter"
ROWS = [
    (1, "http://a/1", "x" * 1200),
    (2, "http://a/2", "x" * 1200),
    (9, None, "x" * 1200),
    (3, "http://a/3", None),
    (4, "http://a/4\r\nWARC-Type: evil", "é" * 500 + "\r\n\r\n\r\n\r\n"),
    (5, "http://a/5", FAKE),
    (6, "http://a/6", "WARC/1.0\r\n" * 300),
    (7, "http://a/7", FAKE * 40 + "\r\n\r\n"),
    (8, "http://a/8", "short"),
    (10, "http://a/10", "short"),
]


@pytest.mark.parametrize("split", ["64m", "700b", "97b"])
def test_round_trip(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = warc.round_trip(pages(spark, ROWS).repartition(2)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len(got) == len(ROWS)
    assert {(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got} == expected(ROWS)
    assert {x.page_id: x.uri for x in got}[8] == "http://a/8"


def record(i, payload, length=None):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_chains_end_where_records_break(spark, tmp_path):
    good = record(1, b"one") + record(2, b"\xff\xfe two")
    (tmp_path / "whole.warc").write_bytes(good)
    (tmp_path / "cut.warc").write_bytes(record(3, b"three") + record(4, b"cut short")[:-9])
    (tmp_path / "gap.warc").write_bytes(record(5, b"five") + b"junk" + record(6, b"unreached"))
    (tmp_path / "lead.warc").write_bytes(b"junk" + record(7, b"unreached"))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "length.warc").write_bytes(record(8, b"eight") + record(9, b"nine", 3) + record(10, b"ten"))
    got = warc.read(spark, str(tmp_path)).collect()
    ids = {int(x.record_id[10:-1]): x for x in got}
    assert {1, 2, 3, 5, 8} <= {*ids} and not {6, 7, 10} & {*ids}
    assert 4 not in ids and 9 not in ids
    assert ids[2].payload_digest == hashlib.sha1(b"\xff\xfe two").hexdigest() and ids[2].payload_bytes == 6


def test_empty_and_repeated(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
    twice = warc.round_trip(pages(spark, [(1, "u", "y" * 1500), (1, "u", "y" * 1500), (0, "v", "y" * 1500)])).collect()
    assert sorted((x.page_id, x.record_type, x.payload_bytes) for x in twice) == [(0, "revisit", 1500), (1, "response", 1500), (1, "response", 1500)]


def test_stated_digests_are_compared(spark, tmp_path):
    def stated(i, payload, value, kind="response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: {value}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    import base64

    raw = hashlib.sha1(b"one").digest()
    cases = [("sha1:" + raw.hex(), True), ("SHA1:" + raw.hex().upper(), True), ("sha1:" + base64.b32encode(raw).decode(), True), ("sha1:" + "0" * 40, False), ("sha1:" + "A" * 32, False), ("md5:1", None)]
    (tmp_path / "a.warc").write_bytes(b"".join(stated(k, b"one", v) for k, (v, _) in enumerate(cases)) + stated(99, b"", "sha1:" + raw.hex(), "revisit"))
    got = {int(x.record_id[10:-1]): x.digest_ok for x in warc.read(spark, str(tmp_path)).collect()}
    assert got == {k: ok for k, (_, ok) in enumerate(cases)} | {99: None}


def test_many_repeated_digests_and_records_with_magics(spark, monkeypatch):
    """Beyond the bounds of a broadcast and of files by name the results are the same."""
    from crawlgrain.llm import cluster

    rows = [(k, f"u{k}", f"{k % 7}" * 1500) for k in range(60)] + [(100 + k, "v", f"{k} " * 20 + "WARC/1.0\r\n" * (k % 40)) for k in range(120)] + [(None, "w", "0" * 1500)]
    for bound in (cluster.BROADCAST_BYTES, 0):
        monkeypatch.setattr(cluster, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(warc, "_FILES_BY_NAME", 1000 if bound else 0)
        got = warc.round_trip(pages(spark, rows)).collect()
        assert len(got) == len(rows)
        assert {(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got if x.page_id is not None} == {x for x in expected(rows[:-1])}
        assert all(x.digest_ok for x in got if x.record_type == "response")
