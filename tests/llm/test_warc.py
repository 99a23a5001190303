import hashlib
import json
import zlib

import pytest

from sparkloom.llm import warc
from sparkloom.llm.store import shared_dir


def test_round_trip_and_revisits(spark):
    long = "<p>" + "ü" * 200
    rows = [(5, "http://a/x?q=1 2", long), (3, "u", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", "line\r\n\r\nWARC/1.1\r\n" * 9), (None, "n", "z" * 300), (8, "u", "x" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        assert r.url == (url or "")
        want = 3 if html == long and i != 3 else None
        assert (r.record_type, r.refers_to) == (("revisit", 3) if want else ("response", None))
        assert bytes(r.payload) == (b"" if want else body)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_shuffled_join_agrees(spark):
    df = spark.createDataFrame([(i, "u", "y" * 150 if i % 3 else str(i) * 120) for i in range(20)], "page_id long, url string, html string")
    a, b = (sorted(map(tuple, warc.with_record_types(df, n).collect())) for n in (100, 0))
    assert a == b


def test_normalised_files(spark, tmp_path):
    df = warc.with_record_types(spark.createDataFrame([(i, "u", str(i) * 99) for i in range(600)], "page_id long, url string, html string").coalesce(1))
    files = warc.write_archives(df, (tmp_path / "mono").as_uri()).collect()
    assert len(files) == 1
    ranges = warc.normalise(spark.createDataFrame(files), (tmp_path / "norm").as_uri()).collect()
    assert [(r.start, r.records) for r in ranges] == [(0, 256), (256, 256), (512, 88)]
    assert [r.index_from for r in ranges[1:]] == [r.index_to for r in ranges[:-1]] and ranges[-1].index_to == (tmp_path / "norm" / "part-000000.warc.gz.idx").stat().st_size
    data = (tmp_path / "norm" / "part-000000.warc.gz").read_bytes()
    index = [json.loads(x) for x in (tmp_path / "norm" / "part-000000.warc.gz.idx").read_text().splitlines()]
    assert len(index) == 600 and sum(x["length"] for x in index) == len(data)
    one = index[17]
    rec = warc.parse(zlib.decompress(data[one["offset"] : one["offset"] + one["length"]], wbits=31))
    assert rec["page_id"] == 17 and one["type"] == "response"
    mono = zlib.decompressobj(31)
    mono.decompress((tmp_path / "mono" / "part-000000.warc.gz").read_bytes())
    assert mono.eof and not mono.unused_data  # one member holds the whole file
    assert not [p for p in tmp_path.rglob("_try*")]


def test_broken_archives_are_refused():
    rec = warc.record(1, "u", b"abc", "0" * 64, "response", None)
    assert list(warc.split_records(iter([rec[:50], rec[50:] + rec]))) == [rec, rec]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([rec[:-3]])))
    with pytest.raises(ValueError):
        warc.parse(rec[:-3])


def test_ties_dates_and_clashing_names(spark, tmp_path):
    """Two rows with the least id are both responses; a page's own time dates its record."""
    rows = [(3, "u", "y" * 150), (3, "v", "y" * 150), (4, "u", "y" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "TIMESTAMP'2020-02-03 04:05:06' AS fetched_at", "1 AS digest", "2 AS first", "3 AS d")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert got == [(3, "response", None), (3, "response", None), (4, "revisit", 3)]
    files = warc.write_archives(warc.with_record_types(df).coalesce(1), (tmp_path / "m").as_uri()).collect()
    assert len(files) == 1 and zlib.decompress((tmp_path / "m" / "part-000000.warc.gz").read_bytes(), wbits=31).count(b"WARC-Date: 2020-02-03T04:05:06Z") == 3


def test_ranges_are_bound_by_bytes(spark, monkeypatch):
    big = [(i, "u", chr(97 + i % 26) * 300_000 + str(i)) for i in range(40)] + [(100, "u", "z" * 9_000_000), (101, "u", None), (102, "u", "small")]
    pages = spark.createDataFrame(big, "page_id long, url string, html string").coalesce(1)
    base = shared_dir(spark)
    ranges = warc.normalise(warc.write_archives(warc.with_record_types(pages), f"{base}/a"), f"{base}/b").cache()
    sizes = [r.records for r in ranges.collect()]
    assert sum(sizes) == 43 and max(sizes) <= 28 and 1 in sizes
    got = {r.page_id: r.payload.decode() for r in warc.read_archives(ranges).collect()}
    assert got == {i: t or "" for i, _, t in big}
