import base64
import hashlib

import pytest
import zstandard

from strandlake.llm import warc


def brute(rows, least=0):
    largest = {}
    for page, _, html in rows:
        key = (html or "").encode()
        largest.setdefault(key, []).append(page)
    out = []
    for page, _, html in rows:
        key = (html or "").encode()
        keep = max((p for p in largest[key] if p is not None), default=None)
        revisit = len(key) >= least and page != keep
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        out.append((page, len(key), digest, "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (6, "u", "y" * 3_000_000), (6, "u", "y" * 3_000_000), (7, "u", "z")]
SCHEMA = "page_id long, url string, html string, keep int, n string"


@pytest.mark.parametrize("least", [0, 1])
def test_small(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, 1, "") for r in ROWS], SCHEMA)
    archive = warc.write(df, str(tmp_path / "a"), min_revisit=least, frame_bytes=64, bundle_bytes=300)
    got = sorted(map(tuple, warc.read(archive).collect()), key=str)
    assert got == brute(ROWS, least)
    one = warc.fetch(archive, 5)
    assert len(one) == 1 and warc.parse(one[0])[2] == ROWS[5][2].encode()
    assert len(warc.fetch(archive, 6)) == 2 and warc.fetch(archive, 99) == []


def test_bundles_are_plain_zstandard(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    archive = warc.write(df, str(tmp_path / "a"), frame_bytes=4096)
    warc.export(archive, str(tmp_path / "files"))
    files = sorted((tmp_path / "files").glob("*.warc.zst"))
    assert files
    n = 0
    for f in files:
        content = f.read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert plain == b"".join(warc.frame(content, k) for k in range(len(warc.seek_table(content))))
        at = 0
        while at < len(plain):
            _, _, payload, at = warc.parse(plain, at)
            n += 1
    assert n == df.count()


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    assert got == brute([(r.page_id, r.url, r.html) for r in df.collect()])
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_prunes_and_hot_payload(spark, tmp_path):
    rows = [(i, "u", "error page" if i % 2 else f"page {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(df, str(tmp_path / "a"), bundle_bytes=2000, frame_bytes=500)
    assert sorted(map(tuple, warc.read(archive).collect()), key=str) == brute(rows)
    assert warc.opened(spark, str(tmp_path / "a")).index.count() == 400
    assert [warc.parse(d)[0]["WARC-Type"] for k in (1, 399, 2) for d in warc.fetch(archive, k)] == ["revisit", "response", "response"]
    for frame, name, value in ((archive.index, "record_id", "x"), (archive.bundles, "bundle", "y")):
        assert f"EqualTo({name},{value})" in frame.where(f"{name} = '{value}'")._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_bundles_follow_the_pages_unless_groups_are_many(spark, tmp_path, threshold):
    """Few groups: as many files as the pages have parts, however many partitions a shuffle has."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": threshold}
    before = {k: spark.conf.get(k) for k in held}
    rows = [(i, "u", "error page" if i % 5 == 0 else f"page {i}") for i in range(400)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path / "a"))
        assert sorted(map(tuple, warc.read(archive).collect()), key=str) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = len(list((tmp_path / "a" / "bundles").glob("part-*")))
    assert files <= 2 if threshold != "-1" else files > 2
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["bundles", "index"]
