from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from brook.functions import geo, periods, values
from brook.functions.periods import Period
from brook.operators import layout
from brook.operators import select as S
from brook.operators.select import Equals, Within
from brook.sources.formats import Csv, Json, spark_type


def one(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())).select(column).first()[0]


def decoded(spark, decoder, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "_id long, value string")
    return [r.asDict(recursive=True) for r in decoder.decode(df).orderBy("_id").collect()]


# ---------------------------------------------------------------- values and formats


def test_csv(spark):
    form = Csv({"id": "long", "mtime": "timestamp", "username": "string", "location": "geolocation", "kws": "list<string>"})
    lines = ["1,1700000000000,Ann,2:44.9:-93.2,Obama,Trump", "2,1700000000001,Bob,4:10:-10:20:-20,x", "3,bad,Cy,null,y", "4,1700000000002,Di,9:1:1", "5", "", " 7,x,y,2:1:z,", "9223372036854775808,,,2:1"]
    got = decoded(spark, form, lines)
    assert got[0] == {"_id": 0, "id": 1, "mtime": datetime(2023, 11, 14, 22, 13, 20), "username": "ann", "location": {"kind": 2, "n": 44.9, "s": 44.9, "e": -93.2, "w": -93.2}, "kws": ["obama", "trump"]}
    assert got[1]["location"] == {"kind": 4, "n": 10.0, "s": -10.0, "e": 20.0, "w": -20.0} and got[1]["kws"] == ["x"]
    assert got[2]["mtime"] is None and got[2]["location"] is None and got[2]["kws"] == ["y"]
    assert got[3]["location"] is None and got[3]["kws"] == []
    assert got[4]["id"] == 5 and got[4]["username"] is None and got[4]["kws"] == []
    assert got[6]["id"] is None and got[6]["location"] is None and got[7]["id"] is None
    with pytest.raises(ValueError):
        Csv({"a": "long"}, (0, 1))
    with pytest.raises(ValueError):
        Csv({"a": "double"})
    assert spark_type("list<geolocation>") == f"array<{geo.GEO}>"


def test_csv_order_and_lists(spark):
    got = decoded(spark, Csv({"at": "list<timestamp>", "id": "long", "g": "list<geolocation>"}, (1, 0, 2)), ["4,1000,2:1:2,2000"])
    assert got[0]["id"] == 4 and got[0]["at"][0] == datetime(1970, 1, 1, 0, 0, 1) and got[0]["at"][1] is None
    assert got[0]["g"][0]["n"] == 1.0 and got[0]["g"][1] is None


def test_json(spark):
    post = '{"id": 5, "created_at": "Wed Aug 27 13:08:45 +0000 2008", "text": "Hello  the\\nWorld", "user": {"screen_name": "Ann"}, %s}'
    lines = [post % '"geo": {"coordinates": [44.5, -93.0]}', post % '"place": {"bounding_box": {"coordinates": [[[-94, 44], [-94, 46], [-92, 46], [-92, 44]]]}}', post % '"geo": null', "{broken", '{"id": 1}', '{"id": 1, "created_at": "never", "text": "x", "user": {"screen_name": "b"}}']
    got = decoded(spark, Json(), lines)
    assert [r["_id"] for r in got] == [0, 1, 2]
    assert got[0]["mtime"] == datetime(2008, 8, 27, 13, 8, 45) and got[0]["keywords"] == ["hello", "the", "world"] and got[0]["username"] == "ann"
    assert (got[0]["location"]["n"], got[1]["location"]["n"], got[1]["location"]["e"], got[2]["location"]) == (44.5, 45.0, -93.0, None)


def test_values(spark):
    assert one(spark, values.parse_long(F.col("x")), x="-12") == -12 and one(spark, values.parse_long(F.col("x")), x=" 1") is None
    assert one(spark, values.zero_pad(F.col("x"), 3), x=7) == "007" and one(spark, values.zero_pad(F.col("x"), 3), x=12345) == "12345"
    assert one(spark, values.keys(F.col("x")), x=7) == ["7"] and one(spark, values.keys(F.array(F.lit(1), F.lit(2)), True), x=1) == ["1", "2"]
    assert one(spark, values.keys(F.lit(None).cast("string")), x=1) == []


# ---------------------------------------------------------------- locations


@pytest.mark.parametrize("rect,hit", [((10, 10, 20, 20), True), ((10.0001, 10.0001, 0, 0), False), ((15, 5, 25, 15), True), ((50, -50, 60, -60), False), ((50, -50, 5, -5), False), (None, False)])
def test_within(spark, rect, hit):
    g = F.lit(None).cast(geo.GEO) if rect is None else geo.rectangle(*map(F.lit, rect))
    assert bool(one(spark, geo.within(g, geo.Box(10, -10, 20, -20)), x=1)) is hit


def test_boxes():
    for bad in ((91, 0, 1, 0), (1, 2, 1, 0), (1, 0, 0, 1), (1, 0, 181, 0)):
        with pytest.raises(ValueError):
            geo.Box(*bad).check()


def test_grid(spark):
    grid = geo.Grid(geo.Box(40, -40, 60, -60), 8, 12)
    points = [(lat, lng) for lat in range(-90, 91, 5) for lng in range(-180, 181, 5)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lat double, lng double")
    df = df.withColumn("g", geo.point(F.col("lat"), F.col("lng"))).withColumn("cell", grid.cell(F.col("lat"), F.col("lng")))
    for box in (geo.Box(10, -10, 20, -20), geo.Box(90, -90, 180, -180), geo.Box(80, 60, 180, 100), geo.Box(40, 40, 60, 60), geo.Box(90, 30, 70, -70)):
        inside = geo.within(F.col("g"), box)
        assert df.where(inside & grid.may_hold(F.col("cell"), box)).count() == df.where(inside).count()
    assert df.where("cell < -1 or cell >= 96").count() == 0
    touched = df.select(F.array_contains(grid.cells(F.col("g")), F.col("cell")).alias("same")).where("not same").count()
    assert touched == 0


def test_distance(spark):
    assert abs(one(spark, geo.distance_miles(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(4.0)), x=1) - (69.1**2 + 106.0**2) ** 0.5) < 1e-9


# ---------------------------------------------------------------- select


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=min(i, 98)), i % 5, ["a", "B", None][i % 3], float(i % 21 - 10), float(i % 41 - 20), [f"k{i % 4}", "all"] if i % 9 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "_id long, _ts timestamp, user long, kind string, lat double, lng double, tags array<string>")
    return df.select("_id", "_ts", "user", values.fold(F.col("kind")).alias("kind"), geo.point(F.col("lat"), F.col("lng")).alias("place"), "tags").cache()


ALL = Period()


def ids(df):
    return [r._id for r in df.select("_id").collect()]


def test_top_k(spark, posts):
    assert ids(S.newest(posts, 3)) == [99, 98, 97]  # the first two have the same time
    assert S.select(posts, k=0, time=ALL).count() == 0
    with pytest.raises(ValueError):
        S.select(posts, k=-1, time=ALL)
    assert S.select(posts, time=ALL).columns == ["user", "kind", "place", "tags"] and S.select(posts, time=ALL).count() == 20
    assert S.select(posts, ["Kind", "user", "kind"], time=ALL).columns == ["kind", "user", "kind"]
    with pytest.raises(ValueError):
        S.select(posts, ["nothing"], time=ALL)


def test_time(spark, posts):
    at = datetime(2024, 1, 1, 0, 30)
    assert ids(S.matching(posts, None, Period(at, at))) == [30]
    assert sorted(ids(S.matching(posts, None, Period(None, at)))) == list(range(31))
    assert S.select(posts, k=500, now=datetime(2024, 1, 1, 3, 5)).count() == 95 and S.select(posts).count() == 0
    assert ids(S.matching(posts, None, Period(at.replace(tzinfo=timezone.utc), at.replace(tzinfo=timezone.utc)))) == [30]
    with pytest.raises(ValueError):
        S.matching(posts, None, Period(at, at - timedelta(seconds=1)))


def test_conditions(spark, posts):
    rows = {r._id: r for r in posts.collect()}
    match = lambda c: set(ids(S.matching(posts, c)))
    want = lambda f: {i for i, r in rows.items() if f(r)}
    a, b, c = Equals("kind", "A"), Equals("USER", 2), Equals("kind", "b")
    assert match(a) == want(lambda r: r.kind == "a")
    assert match(a | b & c) == want(lambda r: r.kind == "a" or r.user == 2 and r.kind == "b")
    assert match((a | b) & c) == want(lambda r: (r.kind == "a" or r.user == 2) and r.kind == "b")
    assert match(Equals("tags", "K1")) == want(lambda r: r.tags and "k1" in r.tags)
    box = geo.Box(5, -5, 10, -10)
    assert match(Within("place", box)) == want(lambda r: -5 <= r.place.n <= 5 and -10 <= r.place.e <= 10)
    assert match(Equals("place", (-10.0, -20.0))) == want(lambda r: (r.place.n, r.place.e) == (-10, -20))
    for bad in (Equals("none", 1), Within("kind", box), Within("place", geo.Box(1, 2, 3, 4))):
        with pytest.raises(ValueError):
            match(bad)
    assert list((a & b | c).required()) == [] and list((a & (b & c)).required()) == [a, b, c]


def test_periods(spark):
    m = lambda day: F.lit(None).cast("timestamp") if day is None else periods.moment(datetime(2024, 1, day))
    assert one(spark, periods.overlaps(m(1), m(3), m(3), m(5)), x=1) and not one(spark, periods.overlaps(m(1), m(2), m(3), None and m(1) or m(4)), x=1)
    assert one(spark, periods.overlaps(m(None), m(3), m(2), m(None)), x=1)
    assert one(spark, periods.starts_within(m(2), m(1), m(3)), x=1) and not one(spark, periods.starts_within(m(4), m(1), m(3)), x=1)
    assert one(spark, periods.starts_before(m(None), m(1)), x=1) and not one(spark, periods.ends_before(m(None), m(1)), x=1)


def test_layouts(spark, posts):
    by = {r.key: r for r in layout.postings(posts, values.keys(F.col("tags"), True)).collect()}
    assert by["all"].n == 88 and by["k1"].first_id == 1
    assert {r.segment: r.n for r in layout.segments(posts, 30).collect()} == {0: 30, 1: 30, 2: 30, 3: 10}
    assert sorted(ids(layout.oldest_segments(posts, 30, 2))) == list(range(60))
    kept = layout.keep_newest(posts, "user", 2)
    assert sorted(ids(kept)) == list(range(90, 100))
    assert "_rank" not in kept.columns
    near = layout.nearest(posts, "place", 0.0, 0.0, 5).collect()
    assert [r.miles for r in near] == sorted(r.miles for r in near) and len(near) == 5
    empty = posts.limit(0)
    assert layout.postings(empty, values.keys(F.col("tags"), True)).count() == layout.oldest_segments(empty, 3, 1).count() == layout.keep_newest(empty, "user", 1).count() == 0


def test_lines(spark, posts):
    got = [r.value for r in S.as_lines(S.select(posts, ["user", "kind", "place", "tags"], time=ALL, k=2)).collect()]
    assert got == ["4,a,(5.0,-3.0),", "3,,(4.0,-4.0),k2 all"]
