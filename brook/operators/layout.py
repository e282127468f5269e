"""Index layouts as plain tables: postings, grid cells, segments and retention.

None of them changes an answer; they let Spark read less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brook.functions import geo
from brook.operators.select import newest


def postings(records: DataFrame, keys: Column) -> DataFrame:
    """For each key how many records it has, and its first and last id.  Partial counts are made before the shuffle."""
    listed = records.select("_id", F.explode(keys).alias("key"))
    return listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))


def cell_postings(records: DataFrame, cells: Column) -> DataFrame:
    listed = records.select("_id", F.explode(cells).alias("cell"))
    return listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))


def segment(_id: Column, per_segment: int) -> Column:
    """Segments hold so many consecutive ids."""
    return F.floor(_id / per_segment).cast("bigint")


def segments(records: DataFrame, per_segment: int) -> DataFrame:
    """Size and period of each segment."""
    by = records.groupBy(segment(F.col("_id"), per_segment).alias("segment"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("since"), F.max("_ts").alias("until"))


def oldest_segments(records: DataFrame, per_segment: int, keep: int) -> DataFrame:
    """Records outside the ``keep`` newest segments: those that a flush takes."""
    last = records.agg(F.max(segment(F.col("_id"), per_segment)).alias("last"))  # one row
    return records.join(F.broadcast(last), segment(F.col("_id"), per_segment) <= F.col("last") - keep).drop("last")


def keep_newest(records: DataFrame, key: str, k: int, salt: int = 16) -> DataFrame:
    """The k newest records of each key.  Keys are cut into ``salt`` parts first, so a hot one is ranked by many tasks."""
    order = [F.col("_ts").desc(), F.col("_id").desc()]
    part = F.pmod(F.xxhash64("_id"), F.lit(salt))
    some = records.withColumn("_rank", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).where(F.col("_rank") <= k)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def nearest(records: DataFrame, location: str, lat: float, lng: float, k: int) -> DataFrame:
    """The k records whose point lies nearest, with the distance in miles; ties to the larger id."""
    g = F.col(location)
    miles = geo.distance_miles(g["n"], g["e"], F.lit(lat), F.lit(lng)).alias("miles")
    return records.where(g.isNotNull()).select("*", miles).orderBy("miles", F.col("_id").desc()).limit(k)


def latest_period(records: DataFrame, hours: int, k: int) -> DataFrame:
    """The k newest of the last hours before the newest record."""
    last = records.agg(F.max("_ts").alias("_last"))  # one row
    near = records.join(F.broadcast(last), F.col("_ts") >= F.col("_last") - F.expr(f"INTERVAL {int(hours)} HOURS")).drop("_last")
    return newest(near, k)
