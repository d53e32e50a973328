import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest

from loomrow.llm import warc


def test_members_are_standard_gzip_and_stream_in_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "_READ", 7)
    data = [b"", b"a" * 5000, bytes(range(256)) * 9]
    raw = b"".join(map(warc.gzip_member, data))
    assert gzip.decompress(raw) == b"".join(data)
    assert list(warc.members(io.BytesIO(raw))) == data
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(raw[:-3])))


def test_reader_verifies():
    good = warc.record(7, "http://a/é b\r\nX: y", b"<p>\r\n\r\n</p>", None, False, "d")
    (r,) = warc.read_archive(io.BytesIO(warc.gzip_member(good)))
    assert r["payload"] == b"<p>\r\n\r\n</p>" and r["page_id"] == 7 and r["target_uri"] == "http://a/%C3%A9%20b%0D%0AX:%20y"
    for bad in (good.replace(b"<p>", b"<q>"), good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.1")):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(warc.gzip_member(bad))))


def test_round_trip(spark, tmp_path):
    big, small = "é" * 500, "x" * 999
    rows = [(1, "u", big), (2, None, big), (9, "u", big), (9, "u", big), (None, "n", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "long " * 200_000), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(3)
    written = warc.write_archives(df, str(tmp_path / "w"), roll=2000)
    got = warc.read_archives(written).collect()
    want = sorted(str((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 9) if h == big and i != 9 else ("response", None)))) for i, _, h in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    assert all(r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    assert all(zlib.decompressobj(31).decompress(p.read_bytes()).startswith(b"WARC/1.1") for p in Path(tmp_path / "w").glob("*.gz"))
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0
    alone = spark.createDataFrame([(None, "u", big)] * 2, "page_id long, url string, html string")
    assert {r.record_type for r in warc.read_archives(warc.write_archives(alone, str(tmp_path / "a"))).collect()} == {"response"}
