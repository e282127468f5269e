"""The newest matching records of a stream: conditions, time ranges and top-k as one DataFrame plan.

Top-k becomes ``TakeOrderedAndProject``: every task keeps k rows, so nothing is sorted or shuffled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from brook.functions import geo, periods
from brook.functions.periods import Period

DEFAULT_K = 20
SYSTEM = ("_id", "_ts", "_date", "_batch", "_bucket", "_cell")


class Condition:
    """A tree of predicates, combined with & and |.  There is no "not", so a predicate on null, being null, never
    lets a record through; left as it is, Spark can push it down to the scan."""

    def __and__(self, other: Condition) -> Condition:
        return Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Either(self, other)

    def column(self, schema: ST.StructType) -> Column:
        raise NotImplementedError

    def required(self) -> Iterator[Condition]:
        """Predicates that every matching record fulfils (none below an "or")."""
        yield self


def _field(schema: ST.StructType, name: str) -> ST.DataType:
    if name.lower() not in schema.fieldNames():
        raise ValueError(f"no attribute {name!r}; there are {', '.join(n for n in schema.fieldNames() if n not in SYSTEM)}")
    return schema[name.lower()].dataType


def is_geo(kind: ST.DataType) -> bool:
    return isinstance(kind, ST.StructType) and kind.fieldNames() == ["kind", "n", "s", "e", "w"]


@dataclass(frozen=True)
class Equals(Condition):
    """attribute = value; for a list attribute: some element is the value, or all are those of a tuple, in order."""

    attribute: str
    value: object

    def column(self, schema: ST.StructType) -> Column:
        kind, c = _field(schema, self.attribute), F.col(self.attribute.lower())
        if is_geo(kind):
            if isinstance(self.value, geo.Box):
                return geo.within(c, self.value.check())
            return geo.same_point(c, *self.value)
        value = self.value.lower() if isinstance(self.value, str) else self.value
        if isinstance(kind, ST.ArrayType) and isinstance(self.value, tuple):
            return c == F.array(*(F.lit(x.lower() if isinstance(x, str) else x) for x in self.value)).cast(kind)
        if isinstance(kind, ST.ArrayType):
            return F.array_contains(c, F.lit(value).cast(kind.elementType))
        if isinstance(value, datetime):
            return c == periods.moment(value, kind.simpleString())
        return c == F.lit(value).cast(kind)


@dataclass(frozen=True)
class Within(Condition):
    """A corner of the location (or of one in the list) lies in the closed box."""

    attribute: str
    box: geo.Box

    def column(self, schema: ST.StructType) -> Column:
        kind, c = _field(schema, self.attribute), F.col(self.attribute.lower())
        if is_geo(kind):
            return geo.within(c, self.box.check())
        if isinstance(kind, ST.ArrayType) and is_geo(kind.elementType):
            return geo.any_within(c, self.box.check())
        raise ValueError(f"{self.attribute!r} is not a location")


@dataclass(frozen=True)
class Both(Condition):
    left: Condition
    right: Condition

    def column(self, schema: ST.StructType) -> Column:
        return self.left.column(schema) & self.right.column(schema)

    def required(self) -> Iterator[Condition]:
        yield from self.left.required()
        yield from self.right.required()


@dataclass(frozen=True)
class Either(Condition):
    left: Condition
    right: Condition

    def column(self, schema: ST.StructType) -> Column:
        return self.left.column(schema) | self.right.column(schema)

    def required(self) -> Iterator[Condition]:
        yield from ()


def matching(records: DataFrame, where: Condition | None = None, time: Period | None = None) -> DataFrame:
    """Records that match, in no order.  A ``_date`` column gets the bounds that follow from the period, which Spark can't derive itself."""
    if time is not None:
        time.check()
        records = records.where(time.holds(F.col("_ts"), records.schema["_ts"].dataType.simpleString()))
        if "_date" in records.columns:  # a day more on either side: dates are those of the session's zone
            if time.start is not None:
                records = records.where(F.col("_date") >= F.lit(time.start.date() - timedelta(days=1)))
            if time.end is not None:
                records = records.where(F.col("_date") <= F.lit(time.end.date() + timedelta(days=1)))
    return records if where is None else records.where(where.column(records.schema))


def newest(records: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The k newest records, newest first; of equal times the larger id is newer."""
    if k < 0:
        raise ValueError("k is negative")
    return records.orderBy(F.col("_ts").desc(), F.col("_id").desc()).limit(k)


def project(records: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Named attributes in order, repeats allowed; all but the system's columns by default."""
    for name in attributes or ():
        _field(records.schema, name)
    return records.select(*([a.lower() for a in attributes] if attributes is not None else [c for c in records.columns if c not in SYSTEM]))


def select(records: DataFrame, attributes: list[str] | None = None, where: Condition | None = None, time: Period | None = None, k: int = DEFAULT_K, now: datetime | None = None) -> DataFrame:
    """The k newest records in the period (the three hours until now, if none is given) that match.

    records: a stream's table with ``_id`` and ``_ts``.  The rows come newest first; nulls match nothing."""
    time = time if time is not None else Period.until(now or datetime.now(timezone.utc))
    return project(newest(matching(records, where, time), k), attributes)


def as_lines(records: DataFrame) -> DataFrame:
    """Records as text: values between commas, nulls empty, locations as (lat,lng) or (n,s,e,w), lists between spaces."""

    def shown(f: ST.StructField) -> Column:
        c = F.col(f.name)
        if is_geo(f.dataType):
            c = geo.text(c)
        elif isinstance(f.dataType, ST.ArrayType):
            inner = geo.text if is_geo(f.dataType.elementType) else lambda x: x.cast("string")
            c = F.array_join(F.transform(c, inner), " ")
        return F.coalesce(c.cast("string"), F.lit(""))

    return records.select(F.concat_ws(",", *(shown(f) for f in records.schema)).alias("value"))
