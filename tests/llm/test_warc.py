import base64
import gzip
import hashlib
import os
import zlib

import pytest

from marginalia.llm import warc

PAGES = "page_id long, url string, html string, archive string"


def test_round_trip(spark, tmp_path):
    html = {1: "same", 2: "same", 3: None, 4: "", 5: "<p>é\r\n\r\nWARC/1.1\r\n", 6: "x" * 3_000_000}
    rows = [(i, f"http://x/{i} y" if i % 2 else None, h, "z") for i, h in html.items()] + [(None, None, "same", "z"), (2, "u", "same", "z")]
    folder = f"file://{tmp_path}/w"
    got = warc.round_trip(spark.createDataFrame(rows, PAGES), folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((i, len((h or "").encode()), digest(h), "revisit" if i in (1, 3) else "response", {1: 2, 3: 4}.get(i), )
                  for i, h in [*html.items(), (2, "same")])
    assert sorted(tuple(r) for r in got if r.page_id is not None) == want
    assert [(r.record_type, r.refers_to) for r in got if r.page_id is None] == [("revisit", 2)]
    index = spark.read.parquet(f"{folder}/index").orderBy("archive", "offset").collect()
    assert len(index) == len(rows)
    for name in {r.archive for r in index}:
        packed = open(f"{tmp_path}/w/archives/{name}", "rb").read()
        members = [r for r in index if r.archive == name]
        assert sum(r.length for r in members) == len(packed) == members[-1].offset + members[-1].length
        for r in members:  # one member each, which starts a record
            one = zlib.decompressobj(31)
            assert one.decompress(packed[r.offset:r.offset + r.length]).startswith(b"WARC/1.1\r\n")
            assert one.eof and not one.unused_data
        assert len(list(warc.records(packed))) == len(members)


def test_whole_file_streams(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}", "") for i in range(50)], PAGES).coalesce(1)
    warc.write_streams(warc.decide(pages), f"file://{tmp_path}/s")
    name, = (f for f in os.listdir(tmp_path / "s") if f.endswith(".gz"))
    packed = (tmp_path / "s" / name).read_bytes()
    one = zlib.decompressobj(31)
    assert one.decompress(packed).count(b"WARC/1.1\r\n") == 50 and one.eof and not one.unused_data
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(packed[:-20]))
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(gzip.decompress(packed)[:-10])))


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e").collect() == []


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], PAGES)
    got = {r.page_id: r.record_type for r in warc.decide(pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_digests_are_made_without_a_step_for_each_letter(spark):
    """Inside a lambda, the SHA-1 of a whole page is taken anew for every letter."""
    texts = [f"page {i}" for i in range(3000)] + ["", "é" * 100]  # some digests have zeros at the start of a part
    rows = spark.createDataFrame([(i, "u", t, "") for i, t in enumerate(texts)], PAGES)
    told = warc.decide(rows)
    assert {r.payload: r.payload_digest for r in told.collect()} == {
        t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
