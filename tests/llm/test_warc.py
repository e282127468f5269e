import base64
import gzip
import hashlib

import pytest

from brook.llm import warc as W
from brook.llm._shared import shared_folder

ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://a/5", "x" * 300_000), (5, "http://a/5", "x" * 300_000), (None, "http://n", "alone"), (7, "http://a/7", "<p>é</p>")]
SCHEMA = "page_id long, url string, html string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "").encode() == data and j is not None]
        revisit = len(data) >= least and same and i != max(same)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def back(spark, rows, least=0, **options):
    path = shared_folder(spark, "warc")
    W.write_archives(W.plan_records(pages(spark, rows), least_bytes=least), path)
    return path, W.read_archives(spark, path, **options)


def key(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    for least in (0, 5, 1000):
        _, df = back(spark, ROWS, least)
        assert key(df) == brute(ROWS, least)
        for r in df.collect():
            assert r.payload is None if r.record_type == "revisit" else base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest


def test_empty(spark):
    assert back(spark, [])[1].collect() == []


def test_verified(spark):
    for least in (0, 1000):
        _, df = back(spark, ROWS, least)
        assert key(W.verified(df)) == brute(ROWS, least)
    wrong = df.withColumn("payload_digest", W.F.lit("X")).withColumn("payload_bytes", W.F.lit(1))
    assert [r for r in key(W.verified(wrong)) if r[3] == "response"] == [r for r in brute(ROWS, 1000) if r[3] == "response"]


def test_append_and_overwrite(spark):
    path = shared_folder(spark, "warc")
    write = lambda rows, mode: W.write_archives(W.plan_records(pages(spark, rows)), path, mode)
    ids = lambda: sorted(r.page_id for r in W.read_archives(spark, path).collect())
    write([(1, "u", "a"), (2, "u", "b")], "append")
    write([(3, "u", "c")], "append")
    write([], "append")
    assert ids() == [1, 2, 3]
    write([(4, "u", "d")], "overwrite")
    assert ids() == [4]
    write([(5, "u", "e")], "append")
    assert ids() == [4, 5]


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_header_predicates(spark, pushdown):
    path, _ = back(spark, ROWS)
    some = lambda **h: W.read_archives(spark, path, wanted_headers={k.replace("_", "-"): v for k, v in h.items()})
    assert sorted(r.page_id for r in some(WARC_Target_URI="http://a/5").collect()) == [5, 5]
    assert sorted(r.page_id for r in some(WARC_Type="revisit", WARC_Date=W.DATE).collect()) == [1, 2, 3]
    assert some(Content_Type="text/plain").collect() == []
    assert [r.page_id for r in some(WARC_Type="revisit").where("url = 'http://a/2'").collect()] == [2]


def test_pushdown_and_skipping(spark, pushdown):
    path, df = back(spark, ROWS, payload=False)
    few = df.where("record_type = 'revisit'")
    assert sorted(r.page_id for r in few.collect()) == [1, 2, 3]
    assert "page_id = 5" in str(df.where("page_id = 5")._jdf.queryExecution()) and df.where("page_id = 5").count() == 2
    assert all(r.payload is None for r in df.collect())
    reader = W.PushingReader({"path": path, "payload": "true", "splitbytes": "1"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)])] == [GreaterThan]
    got = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert sorted((r["page_id"] for r in got), key=str) == [4, 5, 5, 7, None]


def test_foreign_files(spark, tmp_path):
    r = W.record(9, "http://f", b"hello" * 9000, 45000, hashlib.sha1(b"hello" * 9000).hexdigest(), "response", None)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(info + r + info + r)
    (tmp_path / "plain/b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(r) + gzip.compress(info))
    got = W.read_archives(spark, str(tmp_path / "plain")).collect()
    assert sorted(x.record_type for x in got) == ["response"] * 3 + ["warcinfo"] * 4
    assert all(x.payload == b"hello" * 9000 and x.payload_bytes == 45000 for x in got if x.page_id == 9)
