"""Named queries over the tables of a folder, with the same query in SQL.

``events`` stands in for a stream of posts: ``ts`` is the record time, ``event_id`` the id, and a point is
made of both ids by arithmetic; ``documents`` has the keyword lists.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.functions import geo, periods, values
from brook.functions.periods import Period
from brook.operators import layout
from brook.operators import select as S
from brook.operators.select import Equals, Within
from brook.sources.formats import Csv, Json
from brook.streaming.engine import Engine, Lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

JANUARY = Period(datetime(2024, 1, 10), datetime(2024, 1, 20))
BOX = geo.Box(45.0, -45.0, 90.0, -90.0)
GRID = geo.Grid(geo.Box(90.0, -90.0, 180.0, -180.0), 18, 36)
SMALL = geo.Grid(geo.Box(40.0, -40.0, 60.0, -60.0), 8, 12)

LAT, LNG = "((user_id * 37) % 181 - 90)", "((event_id * 73) % 361 - 180)"
E = f"(SELECT event_id, ts, user_id, lower(event_type) AS event_type, value, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng FROM events)"
IN_BOX = "lat BETWEEN -45 AND 45 AND lng BETWEEN -90 AND 90"
IN_TIME = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"
NEWEST = "ORDER BY ts DESC, event_id DESC LIMIT"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    lat, lng = (F.col("user_id") * 37) % 181 - 90, (F.col("event_id") * 73) % 361 - 180
    d = lambda c: c.cast("double")
    return df.select(F.col("event_id").alias("_id"), F.col("ts").alias("_ts"), "event_id", "ts", "user_id", values.fold(F.col("event_type")).alias("event_type"), "value", geo.point(lat, lng).alias("location"), geo.rectangle(d(lat) + 3, d(lat) - 3, d(lng) + 5, d(lng) - 5).alias("area"), d(lat).alias("lat"), d(lng).alias("lng"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").alias("_id"), "doc_id", values.tokens(F.col("text")).alias("keywords"))


# ---------------------------------------------------------------- projection and predicates


@query("SELECT * FROM events")
def select_star(spark, d):
    return S.project(spark.read.parquet(f"{d}/events.parquet").withColumn("_id", F.col("event_id")))


@query(f"SELECT event_type, event_id FROM {E}")
def project(spark, d):
    return S.project(events(spark, d), ["event_type", "event_id"])


@query(f"SELECT event_id, event_type FROM {E} WHERE event_type = 'error'")
def eq_string(spark, d):
    return S.project(S.matching(events(spark, d), Equals("event_type", "ERROR")), ["event_id", "event_type"])


@query(f"SELECT event_id, user_id FROM {E} WHERE user_id = 7")
def eq_long(spark, d):
    return S.project(S.matching(events(spark, d), Equals("user_id", 7)), ["event_id", "user_id"])


@query(f"SELECT event_id, date_trunc('hour', ts) AS hour FROM {E} WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-15 06:00:00'")
def eq_timestamp(spark, d):
    df = events(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return S.project(S.matching(df, Equals("hour", datetime(2024, 1, 15, 6))), ["event_id", "hour"])


@query(f"SELECT event_id FROM {E} WHERE abs(lat - 25) < 1e-6 AND abs(lng + 180) < 1e-6")
def point_eq_eps(spark, d):
    return S.project(S.matching(events(spark, d), Equals("location", (25.0, -180.0))), ["event_id"])


@query(f"SELECT event_id, lat, lng FROM {E} WHERE {IN_BOX}")
def within_point(spark, d):
    return S.project(S.matching(events(spark, d), Within("location", BOX)), ["event_id", "lat", "lng"])


@query(f"SELECT event_id FROM {E} WHERE (lat + 3 BETWEEN 10 AND 20 OR lat - 3 BETWEEN 10 AND 20) AND (lng - 5 BETWEEN -30 AND 0 OR lng + 5 BETWEEN -30 AND 0)")
def within_rect_corner(spark, d):
    return S.project(S.matching(events(spark, d), Within("area", geo.Box(20.0, 10.0, 0.0, -30.0))), ["event_id"])


@query(f"SELECT event_id FROM {E} WHERE {IN_BOX} OR (lat + 3 BETWEEN -45 AND 45 OR lat - 3 BETWEEN -45 AND 45) AND (lng - 5 BETWEEN -90 AND 90 OR lng + 5 BETWEEN -90 AND 90)")
def list_within(spark, d):
    df = events(spark, d).withColumn("places", F.array("location", "area"))
    return S.project(S.matching(df, Within("places", BOX)), ["event_id"])


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '\\s+'), 'the')")
def keyword_contains(spark, d):
    return S.project(S.matching(documents(spark, d), Equals("keywords", "The")), ["doc_id"])


@query(f"SELECT event_id FROM {E} WHERE event_type = 'click' AND user_id % 5 = 2")
def list_equality(spark, d):
    df = events(spark, d).withColumn("pair", F.array("event_type", (F.col("user_id") % 5).cast("string")))
    return S.project(S.matching(df, Equals("pair", ("Click", "2"))), ["event_id"])


@query(f"SELECT event_id, event_type, user_id FROM {E} WHERE event_type = 'click' OR event_type = 'error' AND user_id = 7")
def and_or_precedence(spark, d):
    where = Equals("event_type", "click") | Equals("event_type", "error") & Equals("user_id", 7)
    return S.project(S.matching(events(spark, d), where), ["event_id", "event_type", "user_id"])


@query(f"SELECT event_id FROM {E} WHERE (event_type = 'click' AND user_id = 3) OR ((event_type = 'error' OR event_type = 'view') AND {IN_BOX})")
def grouped_condition(spark, d):
    where = Equals("event_type", "click") & Equals("user_id", 3) | (Equals("event_type", "error") | Equals("event_type", "view")) & Within("location", BOX)
    return S.project(S.matching(events(spark, d), where), ["event_id"])


# ---------------------------------------------------------------- time and top-k


@query(f"SELECT event_id, ts FROM {E} WHERE {IN_TIME}")
def time_range(spark, d):
    return S.project(S.matching(events(spark, d), None, JANUARY), ["event_id", "ts"])


@query(f"SELECT event_id, ts FROM {E} {NEWEST} 20")
def topk_recent(spark, d):
    return S.select(events(spark, d), ["event_id", "ts"], time=Period())


@query(f"SELECT event_id, event_type FROM {E} WHERE event_type = 'error' AND {IN_BOX} AND {IN_TIME} {NEWEST} 20")
def topk_filtered(spark, d):
    return S.select(events(spark, d), ["event_id", "event_type"], Equals("event_type", "error") & Within("location", BOX), JANUARY, 20)


@query(f"SELECT event_id, ts FROM {E} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR {NEWEST} 20")
def time_default_anchor(spark, d):
    return S.project(layout.latest_period(events(spark, d), 3, 20), ["event_id", "ts"])


@query(f"SELECT count(*) AS n FROM {E} WHERE event_type = 'error' AND {IN_BOX}")
def rows_matched(spark, d):
    return S.matching(events(spark, d), Equals("event_type", "error") & Within("location", BOX)).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, user_id, value FROM {E} WHERE event_id = 77")
def by_id(spark, d):
    return S.project(events(spark, d).where("_id = 77"), ["event_id", "user_id", "value"])


# ---------------------------------------------------------------- indexes, segments, retention


@query("SELECT key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS key FROM documents) GROUP BY key")
def hash_postings(spark, d):
    return layout.postings(documents(spark, d), values.keys(F.col("keywords"), is_list=True))


CELL = "CAST(36 * least(floor((90 - lat) / 10), 17) + least(floor((lng + 180) / 10), 35) AS INTEGER)"


@query(f"SELECT event_id, {CELL} AS cell FROM {E}")
def grid_cell(spark, d):
    return events(spark, d).select("event_id", GRID.cell(F.col("lat"), F.col("lng")).alias("cell"))


@query(f"SELECT event_id, CASE WHEN lat BETWEEN -40 AND 40 AND lng BETWEEN -60 AND 60 THEN CAST(12 * least(floor((40 - lat) / 10), 7) + least(floor((lng + 60) / 10), 11) AS INTEGER) ELSE -1 END AS cell FROM {E}")
def grid_cell_outside(spark, d):
    return events(spark, d).select("event_id", SMALL.cell(F.col("lat"), F.col("lng")).alias("cell"))


@query(f"SELECT cell, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, {CELL} AS cell FROM {E}) GROUP BY cell")
def grid_postings(spark, d):
    return layout.cell_postings(events(spark, d), F.array(GRID.cell(F.col("lat"), F.col("lng"))))


@query(f"SELECT event_id FROM {E} WHERE {IN_BOX}")
def grid_range(spark, d):
    df = events(spark, d).withColumn("cell", GRID.cell(F.col("lat"), F.col("lng")))
    return S.project(S.matching(df.where(GRID.may_hold(F.col("cell"), BOX)), Within("location", BOX)), ["event_id"])


@query(f"""SELECT event_id, CAST(36 * y + x AS INTEGER) AS cell FROM (SELECT event_id, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT event_id, x0, x1, unnest(generate_series(y0, y1)) AS y FROM (
  SELECT event_id, CAST(least(floor((90 - least(lat + 3, 90)) / 10), 17) AS BIGINT) AS y0, CAST(least(floor((90 - greatest(lat - 3, -90)) / 10), 17) AS BIGINT) AS y1,
  CAST(least(floor((greatest(lng - 5, -180) + 180) / 10), 35) AS BIGINT) AS x0, CAST(least(floor((least(lng + 5, 180) + 180) / 10), 35) AS BIGINT) AS x1 FROM {E})))""")
def rect_cells(spark, d):
    return events(spark, d).select("event_id", F.explode(GRID.cells(F.col("area"))).alias("cell"))


@query(f"SELECT CAST(floor(event_id / 2500) AS BIGINT) AS segment, count(*) AS n, min(ts) AS since, max(ts) AS until FROM {E} GROUP BY segment")
def segment_assign(spark, d):
    return layout.segments(events(spark, d), 2500)


@query("SELECT event_id FROM events WHERE floor(event_id / 2500) <= (SELECT max(floor(event_id / 2500)) FROM events) - 2")
def flush_oldest(spark, d):
    return S.project(layout.oldest_segments(events(spark, d), 2500, 2), ["event_id"])


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def retain_k_per_key_ext(spark, d):
    return S.project(layout.keep_newest(events(spark, d), "event_type", 5), ["event_id", "event_type"])


MILES = "sqrt(pow(69.1 * (lat - 44.97), 2) + pow(53.0 * (lng + 93.26), 2))"


@query(f"SELECT event_id, round({MILES}, 4) AS miles FROM {E} ORDER BY {MILES}, event_id DESC LIMIT 20")
def knn_ext(spark, d):
    return layout.nearest(events(spark, d), "location", 44.97, -93.26, 20).select("event_id", F.round("miles", 4).alias("miles"))


# ---------------------------------------------------------------- value functions


@query(f"SELECT event_id, round({MILES}, 4) AS miles FROM {E}")
def distance_approx(spark, d):
    return events(spark, d).select("event_id", F.round(geo.distance_miles(F.col("lat"), F.col("lng"), F.lit(44.97), F.lit(-93.26)), 4).alias("miles"))


@query(f"SELECT event_id, greatest(lat + 3, 10.0) AS n, least(lat - 3, -10.0) AS s, greatest(lng + 5, 20.0) AS e, least(lng - 5, -20.0) AS w, round(53.0 * ((lng + 5) - (lng - 5)), 4) AS width, round(69.1 * ((lat + 3) - (lat - 3)), 4) AS height, (lat + 3 <= 10.0 AND lat - 3 >= -10.0 AND lng + 5 <= 20.0 AND lng - 5 >= -20.0) AS inside FROM {E}")
def rect_algebra(spark, d):
    fixed = geo.rectangle(F.lit(10), F.lit(-10), F.lit(20), F.lit(-20))
    a = F.col("area")
    m = geo.merged(a, fixed)
    return events(spark, d).select("event_id", *(m[x].alias(x) for x in "nsew"), F.round(geo.width_miles(a), 4).alias("width"), F.round(geo.height_miles(a), 4).alias("height"), geo.contains(fixed, a).alias("inside"))


T0, T1 = "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-20'"


@query(f"SELECT event_id, (ts <= {T1} AND {T0} <= ts + INTERVAL 2 DAY) AS overlap, (ts >= {T0} AND ts <= {T1}) AS starts_within, ts < {T0} AS starts_before, ts > {T1} AS starts_after, ts + INTERVAL 2 DAY < {T0} AS ends_before FROM events")
def period_overlap(spark, d):
    a, b = F.col("ts"), F.col("ts") + F.expr("INTERVAL 2 DAYS")
    t0, t1 = (periods.moment(x, "timestamp_ntz") for x in JANUARY)
    return events(spark, d).select("event_id", periods.overlaps(a, b, t0, t1).alias("overlap"), periods.starts_within(a, t0, t1).alias("starts_within"), periods.starts_before(a, t0).alias("starts_before"), periods.starts_after(a, t1).alias("starts_after"), periods.ends_before(b, t0).alias("ends_before"))


def _lines(spark, d):
    """Events as lines: id, user, location, then type and a number as keywords."""
    e = events(spark, d)
    here = F.when(F.col("event_id") % 3 == 0, F.concat_ws(":", F.lit("2"), F.col("lat").cast("int").cast("string"), F.col("lng").cast("int").cast("string"))).when(F.col("event_id") % 3 == 1, F.lit("4:10:-10:20:-20")).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("null")).otherwise(F.lit("9:1:1")))
    return e.select("_id", F.concat_ws(",", F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise(F.col("user_id").cast("string")), here, F.upper("event_type"), F.col("user_id").cast("string"), F.lit("")).alias("value"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE user_id END AS user_id, lower(event_type) AS kind FROM events")
def csv_decode(spark, d):
    rows = Csv({"id": "long", "user_id": "long", "kind": "string"}, (0, 1, 3)).decode(_lines(spark, d))
    return S.project(rows).withColumn("user_id", F.coalesce("user_id", F.lit(-1)))  # bad numbers are null


@query("SELECT event_id AS id, 2 AS n_keys, lower(event_type) AS first_key, CAST(user_id AS VARCHAR) AS last_key FROM events")
def list_tail(spark, d):
    rows = Csv({"id": "long", "keys": "list<string>"}, (0, 3)).decode(_lines(spark, d))
    return rows.select("id", F.size("keys").alias("n_keys"), F.get("keys", F.lit(0)).alias("first_key"), F.element_at("keys", -1).alias("last_key"))


@query(f"SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS kind, CASE event_id % 3 WHEN 0 THEN lat WHEN 1 THEN 10.0 ELSE 999 END AS n, CASE event_id % 3 WHEN 0 THEN lng WHEN 1 THEN -20.0 ELSE 999 END AS w FROM {E}")
def geo_parse(spark, d):
    rows = Csv({"id": "long", "place": "geolocation"}, (0, 2)).decode(_lines(spark, d))
    return rows.select("id", F.coalesce(F.col("place.kind").cast("int"), F.lit(0)).alias("kind"), *(F.coalesce(f"place.{x}", F.lit(999.0)).alias(x) for x in "nw"))


@query(f"SELECT event_id AS id, ts AS mtime, 2 AS n_keywords, 'user' || CAST(user_id AS VARCHAR) AS username, lat, lng FROM {E} WHERE event_id % 7 <> 0")
def json_decode(spark, d):
    e = events(spark, d)
    corner = lambda lat, lng: F.array(F.col("lng") + lng, F.col("lat") + lat)
    made = F.to_json(F.struct(F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.concat(F.lit("Some "), F.upper("event_type")).alias("text"), F.struct(F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("screen_name")).alias("user"), F.when(F.col("event_id") % 2 == 0, F.struct(F.array("lat", "lng").alias("coordinates"))).alias("geo"), F.struct(F.struct(F.array(F.array(corner(-2, -2), corner(-2, 2), corner(2, 2), corner(2, -2))).alias("coordinates")).alias("bounding_box")).alias("place")))
    rows = Json().decode(e.select("_id", made.alias("value")))
    return rows.select("id", F.col("mtime").cast("timestamp_ntz").alias("mtime"), F.size("keywords").alias("n_keywords"), "username", F.col("location.n").alias("lat"), F.col("location.e").alias("lng"))


@query(f"SELECT event_id, lat + 1 AS lat, lng + 0.5 AS lng FROM {E}")
def bbox_centroid(spark, d):
    corner = lambda lat, lng: F.array(F.col("lng") + lng, F.col("lat") + lat)
    g = geo.centroid(F.array(corner(0, 0), corner(0, 1), corner(2, 1), corner(2, 0)))
    return events(spark, d).select("event_id", g["n"].alias("lat"), g["e"].alias("lng"))


@query(f"SELECT event_id, '(' || CAST(CAST(lat AS INTEGER) AS VARCHAR) || '.0,' || CAST(CAST(lng AS INTEGER) AS VARCHAR) || '.0)' AS shown, lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded FROM {E}")
def show_values(spark, d):
    return events(spark, d).select("event_id", geo.text(F.col("location")).alias("shown"), values.zero_pad(F.col("user_id"), 6).alias("padded"))


@query("SELECT doc_id, len(string_split_regex(lower(text), '\\s+')) AS n_tokens, md5(lower(text)) AS folded FROM documents")
def tokenise(spark, d):
    df = spark.read.parquet(f"{d}/documents.parquet")
    return df.select("doc_id", F.size(values.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.md5(values.fold(F.col("text")).cast("binary")).alias("folded"))


# ---------------------------------------------------------------- streams and their indexes

POSTS = {"id": "long", "mtime": "timestamp", "username": "string", "location": "geolocation", "kws": "list<string>"}


def _posts(spark, d) -> Engine:
    """An engine whose stream ``posts`` has taken in all events as lines: ids, times in milliseconds, users, points, types."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/engine-{uuid.uuid4().hex}"
    e = events(spark, d)
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.unix_millis(F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp")).cast("string"), F.concat(F.lit("User"), F.col("user_id").cast("string")), F.concat_ws(":", F.lit("2"), F.col("lat").cast("int").cast("string"), F.col("lng").cast("int").cast("string")), F.upper("event_type"), F.lit("All"))
    e.select(line.alias("value")).write.text(f"{root}/lines")
    engine = Engine(spark, root)
    engine.create_stream("posts", POSTS, Lines(f"{root}/lines"), timestamp_by="mtime", start=False)
    engine.resume("posts", available_now=True).awaitTermination()
    return engine


P = f"(SELECT event_id AS id, date_trunc('millisecond', ts) AS mtime, 'user' || CAST(user_id AS VARCHAR) AS username, lat, lng, event_type AS kind FROM {E})"
IN_MTIME = IN_TIME.replace("ts", "mtime", 1)


@query(f"SELECT * FROM {P}")
def stream_ingest(spark, d):
    rows = S.project(_posts(spark, d).records("posts"), ["id", "mtime", "username", "location", "kws"])
    return rows.select("id", F.convert_timezone(None, F.lit("UTC"), F.col("mtime").cast("timestamp_ntz")).alias("mtime"), "username", F.col("location.n").alias("lat"), F.col("location.e").alias("lng"), F.get("kws", F.lit(0)).alias("kind"))


@query(f"SELECT id, username FROM {P} WHERE kind = 'error' AND {IN_MTIME} ORDER BY mtime DESC LIMIT 100")
def select_by_hash_index(spark, d):
    engine = _posts(spark, d)
    engine.create_index("hash", "bykws", "posts", "kws")
    return engine.select("posts", ["id", "username"], Equals("kws", "ERROR"), JANUARY, 100)


@query(f"SELECT id, lat, lng FROM {P} WHERE {IN_BOX} AND {IN_MTIME} ORDER BY mtime DESC LIMIT 100")
def select_by_grid_index(spark, d):
    engine = _posts(spark, d)
    engine.create_index("grid", "world", "posts", "location", GRID)
    rows = engine.select("posts", ["id", "location"], Within("location", BOX), JANUARY, 100)
    return rows.select("id", F.col("location.n").alias("lat"), F.col("location.e").alias("lng"))


@query(f"SELECT CAST(event_id AS VARCHAR) || ',' || event_type || ',(' || CAST(CAST(lat AS INTEGER) AS VARCHAR) || '.0,' || CAST(CAST(lng AS INTEGER) AS VARCHAR) || '.0)' AS value FROM {E}")
def show_lines(spark, d):
    return S.as_lines(S.project(events(spark, d), ["event_id", "event_type", "location"]))
