import base64
import gzip
import hashlib
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import warc


def test_round_trip(spark):
    rows = [(3, "a", "x"), (1, "b", "x"), (2, "c", "é"), (5, "u\r\nv", None), (4, None, ""), (None, "n", "x"), (1, "b", "x"), (9, "l", "w" * 300000), (-7, "m", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        response = p is None or first[h or ""] == p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
    assert got == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(df.where("page_id < 4"), min_revisit_bytes=100).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_unwanted_payloads_stay_packed(tmp_path, monkeypatch):
    """Without payloads only the first bytes of a member are inflated, and no digest is checked."""
    body = os.urandom(400_000)
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    whole = warc.gzip_member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:none")], http + body))
    (tmp_path / "a.warc.gz").write_bytes(whole + whole)
    out = [0]
    real = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.z = real(bits)

        def decompress(self, *a):
            got = self.z.decompress(*a)
            out[0] += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    read = lambda payload: [r for b in warc.WarcReader(str(tmp_path), payload, False, 1 << 20).read(warc.Files([str(tmp_path / "a.warc.gz")])) for r in b.to_pylist()]
    assert [(r["payload_length"], r["payload"]) for r in read(False)] == [(400_000, None)] * 2 and out[0] <= 2 * warc.FIRST_BYTES
    assert [r["payload"] for r in read(True)] == [body] * 2 and out[0] > 800_000


def test_source_pushes_filters_and_reads_foreign_members(spark, tmp_path):
    path = f"{tmp_path}/w"
    df = spark.createDataFrame([(i, f"http://h{i % 3}/p", "z" * (i + 1)) for i in range(30)], "page_id long, url string, html string")
    warc.write_archives(warc.to_records(df), path)
    body = b"hello"
    plain = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x>"), ("Content-Type", "text/plain")], body)
    with open(f"{path}/other.warc.gz", "wb") as f:
        f.write(gzip.compress(plain) + gzip.compress(plain))
    every = warc.read_archives(spark, path)
    assert every.count() == 32 and every.where("record_type = 'resource'").select("payload").first()[0] == bytearray(body)
    some = every.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"^\W*(\*\(\d+\) )?Filter ", plan, re.M), plan  # the reader took all predicates
    assert some.count() == 10 and sorted(r.n for r in some.select(F.length("payload").alias("n")).collect()) == list(range(2, 31, 3))
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    assert not [x for x in os.listdir(path) if x.startswith("_")]


def test_files_are_read_once(spark, tmp_path):
    """Many small records: hardly more bytes than the file has, and every payload is verified though none is returned."""
    df = spark.range(6000).selectExpr("id as page_id", "'u' as url", "concat(id, repeat(hex(id * 7919), 40)) as html").coalesce(1)
    warc.write_archives(warc.to_records(df), str(tmp_path / "w"))
    (name,) = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.gz")]
    read = [0]

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            got = self.f.read(n)
            read[0] += len(got)
            return got

        def seek(self, at):
            self.f.seek(at)

        def size(self):
            return os.path.getsize(name)

    reader = warc.WarcReader(str(tmp_path / "w"), False, True, 1 << 30, True)
    with open(name, "rb") as f:
        rows = list(reader._records(Counted(f)))
    assert len(rows) == 6000 and all(r["payload"] is None for r in rows) and read[0] <= 1.2 * os.path.getsize(name)


def test_unreturned_payloads_are_verified(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    bad = warc.gzip_member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:none")], http))
    (tmp_path / "a.warc.gz").write_bytes(bad)
    assert warc.read_archives(spark, str(tmp_path), payload=False).count() == 1
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, str(tmp_path), payload=False, verify_all=True).count()
