import os
import subprocess
import sys
import time
from datetime import datetime, timezone

import pytest

from brook.functions import geo
from brook.functions.periods import Period
from brook.operators.select import Equals, Within
from brook.streaming.engine import Engine, EngineConfig, Lines, Pull

ATTRIBUTES = {"id": "long", "mtime": "timestamp", "username": "string", "location": "geolocation", "kws": "list<string>"}


def lines(low, high):
    return [f"{i},{1700000000000 + i * 60000},User{i % 7},{'null' if i % 11 == 0 else f'2:{i % 60 - 30}:{i % 90 - 45}' if i % 5 else '4:10:-10:20:-20'},K{i % 3},All" for i in range(low, high)]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"), EngineConfig(trigger="200 milliseconds"))
    yield e
    for q in e.queries.values():
        q.stop()


def feed(engine, tmp_path, low, high):
    os.makedirs(tmp_path / "in", exist_ok=True)
    (tmp_path / "in" / f"{low}.csv").write_text("\n".join(lines(low, high)) + "\n")
    engine.resume("posts", available_now=True).awaitTermination(60)


def stream(engine, tmp_path, low=0, high=200):
    os.makedirs(tmp_path / "in", exist_ok=True)
    engine.create_stream("posts", ATTRIBUTES, Lines(str(tmp_path / "in")), timestamp_by="mtime", start=False)
    feed(engine, tmp_path, low, high)


WHERE = [
    None,
    Equals("username", "USER3"),
    Equals("kws", "k1"),
    Within("location", geo.Box(10, -10, 20, -20)),
    Equals("kws", "k1") & Within("location", geo.Box(15, -15, 30, -30)),
    Equals("username", "user3") | Within("location", geo.Box(10, -10, 20, -20)),
    Equals("id", 17),
    Equals("mtime", datetime.fromtimestamp(1700000000 + 17 * 60, timezone.utc)),
    Equals("kws", ("K1", "all")),
    Within("location", geo.Box(90, -90, 180, -180)),
]
TIMES = [Period(), Period(datetime(2023, 11, 14, 23, 0), datetime(2023, 11, 15, 1, 0))]


def answers(engine):
    return [engine.select("posts", ["id", "username"], w, t, k).collect() for w in WHERE for t in TIMES for k in (7, 1000)]


def test_indexes_never_change_an_answer(spark, engine, tmp_path):
    stream(engine, tmp_path)
    plain = answers(engine)
    assert len(plain[1]) == 200 and len(plain[4 * WHERE.index(Equals("kws", ("K1", "all"))) + 1]) == 67 and [r.id for r in plain[0]] == list(range(199, 192, -1))
    engine.create_index("hash", "byuser", "posts", "username")
    engine.create_index("hash", "bykws", "posts", "kws")
    engine.create_index("hash", "bytime", "posts", "mtime")
    engine.create_index("grid", "world", "posts", "location")
    assert answers(engine) == plain
    assert "PartitionFilters: [isnotnull(_place" in engine.select("posts", where=WHERE[1], time=Period())._jdf.queryExecution().executedPlan().toString()
    engine.create_index("grid", "small", "posts", "location", geo.Grid(geo.Box(5, -5, 5, -5), 3, 2))
    engine.activate("posts", "world", False)
    assert answers(engine) == plain
    feed(engine, tmp_path, 200, 260)  # batches that no index has yet
    engine.activate("posts", "world")
    more = answers(engine)
    for x in ("byuser", "bykws", "bytime", "world", "small"):
        engine.activate("posts", x, False)
    assert answers(engine) == more and len(more[1]) == 260
    for x in ("byuser", "bykws", "bytime", "world", "small"):
        engine.activate("posts", x)
        engine.refresh_index("posts", x)
    assert answers(engine) == more
    engine.compact("posts")
    assert answers(engine) == more
    feed(engine, tmp_path, 260, 270)
    assert engine.records("posts").count() == 270
    assert engine.progress("posts")["total"] == 270 and engine.progress("posts")["indexes"]["byuser"] == 260
    engine.drop_index("posts", "small")
    assert engine.desc("posts").count() == 5
    found = engine.by_id("posts", engine.records("posts").where("id = 5").first()._id).collect()
    assert [r.id for r in found] == [5]


def test_a_new_session_finds_its_streams(spark, engine, tmp_path):
    stream(engine, tmp_path, 0, 20)
    again = Engine(spark, engine.root)
    assert again.desc().collect()[0].stream == "posts" and again.select("posts", time=Period()).count() == 20
    feed(again, tmp_path, 20, 30)
    assert sorted(r.id for r in again.records("posts").collect()) == list(range(30))
    again.drop_stream("POSTS")
    assert Engine(spark, engine.root).desc().count() == 0 and not os.path.exists(f"{engine.root}/streams/posts")
    again.create_stream("posts", {"x": "long"}, Lines(str(tmp_path / "in")), start=False)
    assert again.select("posts").collect() == [] and again.select("posts").columns == ["x"]


def test_declarations_that_are_refused(engine, tmp_path):
    source = Lines(str(tmp_path))
    engine.create_stream("posts", ATTRIBUTES, source, start=False)
    bad = [("posts", ATTRIBUTES, {}), ("a b", ATTRIBUTES, {}), ("select", ATTRIBUTES, {}), ("x", {"where": "long"}, {}), ("x", {"a": "double"}, {}), ("x", {"a": "long"}, {"fields": (0, 1)}), ("x", {"a": "long"}, {"timestamp_by": "a"}), ("x", {"a": "long"}, {"form": "xml"}), ("x", {"_id": "long"}, {})]
    for name, attributes, more in bad:
        with pytest.raises(ValueError):
            engine.create_stream(name, attributes, source, start=False, **more)
    for call in (lambda: engine.select("none"), lambda: engine.create_index("tree", "i", "posts", "id"), lambda: engine.create_index("grid", "i", "posts", "id"), lambda: engine.create_index("hash", "i", "posts", "none"), lambda: engine.drop_index("posts", "i"), lambda: engine.desc("none"), lambda: engine.pause("none")):
        with pytest.raises(ValueError):
            call()


def wait(test, seconds=60):
    end = time.time() + seconds
    while not test():
        assert time.time() < end
        time.sleep(0.3)


def test_pull(spark, engine, tmp_path):
    (tmp_path / "lines").write_text("\n".join(lines(0, 10)))
    server = subprocess.Popen([sys.executable, f"{os.path.dirname(__file__)}/pull_server.py", tmp_path / "lines", "3,0,3,4,0"], stdout=subprocess.PIPE, text=True)
    try:
        port = int(server.stdout.readline())
        engine.create_stream("posts", ATTRIBUTES, Pull("127.0.0.1", port), timestamp_by="mtime")
        engine.show("posts")
        wait(lambda: engine.records("posts").count() == 10)
        assert engine.status("posts") == "running"
        engine.pause("posts")
        assert engine.status("posts") == "paused"
        engine.resume("posts")
        time.sleep(2)
        rows = engine.records("posts").orderBy("_id").collect()
        assert [(r._id, r.id) for r in rows] == [(i, i) for i in range(10)]
        assert [r.id for r in engine.select("posts", ["id"], time=Period(), k=2).collect()] == [9, 8]
        server.kill()
        wait(lambda: engine.status("posts") == "failed")
        assert engine.records("posts").count() == 10
    finally:
        server.kill()
        server.stdout.close()


def test_pull_reads_again_from_the_spool(tmp_path):
    """Tasks fetch; what was spooled is given again as it was, and lines are numbered on from the last batch's file."""
    from brook.sources.pull import Fetch, PullReader

    (tmp_path / "lines").write_text("a\nb\u00e9\nc\nd\ne")
    server = subprocess.Popen([sys.executable, f"{os.path.dirname(__file__)}/pull_server.py", tmp_path / "lines", "2,0,1,2"], stdout=subprocess.PIPE, text=True)
    try:
        options = {"host": "127.0.0.1", "port": server.stdout.readline().strip(), "spool": str(tmp_path / "spool"), "connections": "2"}
        reader = PullReader(options)
        assert reader.latestOffset() == {"next": 1} == reader.latestOffset()
        assert [p.value for p in reader.partitions({"next": 0}, {"next": 1})] == [(0, 0), (1, 0)]
        first = list(reader.read(Fetch(0, 0)))
        assert first == [(0, "a"), (2, "b\u00e9")] == list(PullReader(options).read(Fetch(0, 0)))
        assert list(reader.read(Fetch(1, 0))) == []
        reader.commit({"next": 1})
        assert PullReader(options).latestOffset() == {"next": 2}
        assert list(reader.read(Fetch(0, 1))) == [(4, "c")]
        reader.commit({"next": 2})
        assert list(reader.read(Fetch(1, 1))) == [(1, "d"), (3, "e")] == list(reader.read(Fetch(1, 1)))
        with pytest.raises(ValueError):
            list(reader.read(Fetch(0, 0)))
    finally:
        server.kill()
        server.stdout.close()
    with pytest.raises(OSError):
        list(reader.read(Fetch(0, 2)))


def test_ids_of_many_partitions_and_batches(spark):
    from brook.streaming.engine import own_ids

    many = spark.range(0, 4000, 1, 2000).select(own_ids(1).alias("x")).union(spark.range(1).select(own_ids(2).alias("x")))
    assert many.distinct().count() == 4001
    last = [spark.range(3).coalesce(1).select(own_ids(n).alias("x")).collect() for n in ((1 << 20), (1 << 20) + 1, (1 << 62))]
    assert [int(r.x) for r in last[0]] == [(1 << 83) + i for i in range(3)] and last[0][-1].x < last[1][0].x < last[2][0].x


def test_compaction_that_stops_half_way(spark, engine, tmp_path, monkeypatch):
    stream(engine, tmp_path, 0, 40)
    feed(engine, tmp_path, 40, 60)
    ids = lambda e: sorted(r.id for r in e.records("posts").collect())
    monkeypatch.setattr(engine, "_save", lambda: 1 / 0)  # written, but the catalog doesn't name it
    with pytest.raises(ZeroDivisionError):
        engine.compact("posts")
    monkeypatch.undo()
    assert ids(Engine(spark, engine.root)) == list(range(60))
    again = Engine(spark, engine.root)
    monkeypatch.setattr(again, "_drop_compacted", lambda stream: 1 / 0)  # named, but the old folders are still there
    with pytest.raises(ZeroDivisionError):
        again.compact("posts")
    assert ids(Engine(spark, engine.root)) == list(range(60))
    last = Engine(spark, engine.root)
    feed(last, tmp_path, 60, 70)
    last.compact("posts")
    assert ids(last) == list(range(70)) and len([x for x in os.listdir(f"{engine.root}/streams/posts") if x.startswith("compacted-")]) == 1
    assert [x for x in os.listdir(f"{engine.root}/streams/posts/records") if x.startswith("_batch=")] == []


def test_a_hot_keyword_is_written_by_many_tasks(spark, engine, tmp_path):
    stream(engine, tmp_path, 0, 6000)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        engine.create_index("hash", "bykws", "posts", "kws", buckets=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = [len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(f"{engine.root}/streams/posts/index/bykws")]
    assert max(parts) > 1
    assert len(engine.select("posts", ["id"], Equals("kws", "all"), Period(), 10_000).collect()) == 6000


def test_a_statement_that_takes_too_long(spark, engine):
    from pyspark.sql import functions as F

    slow = spark.range(2).select(F.expr("java_method('java.lang.Thread', 'sleep', id * 0 + 4000L)"))
    with pytest.raises(TimeoutError):
        engine.answer(slow, 0.5)
    assert [r.id for r in engine.answer(spark.range(3))] == [0, 1, 2]
    spark.conf.set("spark.brook.timeoutSeconds", "7.5")
    spark.conf.set("spark.brook.answerSize", "5")
    try:
        assert (EngineConfig.of(spark).timeout, EngineConfig.of(spark).answer_size) == (7.5, 5)
    finally:
        spark.conf.unset("spark.brook.timeoutSeconds")
        spark.conf.unset("spark.brook.answerSize")
