"""Decoders of lines into typed columns.  A decoder is a function from a DataFrame with ``_id`` and ``value`` to one with attributes.

Bad values are null; a record is dropped only where its format says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.functions import geo, values

# The scalar types of attributes.
SCALARS = {"long": "bigint", "string": "string", "timestamp": "timestamp", "geolocation": geo.GEO}


def spark_type(kind: str) -> str:
    """``list<string>`` is ``array<string>``, and so on."""
    inner = re.fullmatch(r"list<(\w+)>", kind)
    name = inner[1] if inner else kind
    if name not in SCALARS:
        raise ValueError(f"no type {kind!r}; there are {', '.join(SCALARS)} and lists of them")
    return f"array<{SCALARS[name]}>" if inner else SCALARS[name]


def parse_value(c: Column, kind: str) -> Column:
    return {"long": values.parse_long, "timestamp": values.parse_timestamp, "string": values.fold, "geolocation": geo.parse}[kind](c)


def fields(line: Column) -> Column:
    """Fields between commas, without quoting; empty ones at the end are not there."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


@dataclass(frozen=True)
class Csv:
    """Attribute i reads field ``indices[i]``; a list attribute takes that field and all after it."""

    attributes: dict[str, str]
    indices: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.indices is not None and len(self.indices) != len(self.attributes):
            raise ValueError(f"{len(self.attributes)} attributes, but {len(self.indices)} field numbers")
        for kind in self.attributes.values():
            spark_type(kind)

    def column(self, line: Column, at: int, kind: str) -> Column:
        parts = fields(line)
        if not kind.startswith("list<"):
            return parse_value(F.get(parts, F.lit(at)), kind)
        inner = kind[5:-1]
        return F.transform(F.when(F.size(parts) > at, F.slice(parts, F.lit(at + 1), F.size(parts))).otherwise(F.array().cast("array<string>")), lambda x: parse_value(x, inner))

    def decode(self, lines: DataFrame) -> DataFrame:
        indices = self.indices if self.indices is not None else range(len(self.attributes))
        keep = [c for c in lines.columns if c != "value"]
        return lines.select(*keep, *(self.column(F.col("value"), at, kind).alias(name.lower()) for (name, kind), at in zip(self.attributes.items(), indices, strict=True)))


@dataclass(frozen=True)
class Json:
    """Posts: id, created_at, text, user.screen_name, and geo.coordinates or else the middle of place.bounding_box.

    Records that are malformed, or lack one of the first four, are dropped."""

    SHAPE = "id bigint, created_at string, text string, user struct<screen_name:string>, geo struct<coordinates:array<double>>, place struct<bounding_box:struct<coordinates:array<array<array<double>>>>>"
    attributes = {"id": "long", "mtime": "timestamp", "keywords": "list<string>", "username": "string", "location": "geolocation"}

    def decode(self, lines: DataFrame) -> DataFrame:
        r = F.from_json("value", self.SHAPE)
        keep = [c for c in lines.columns if c != "value"]
        # behind a generator, so that each line is parsed once and not for each filter and field
        rows = lines.select(*keep, F.explode(F.array(r)).alias("r")).where(F.col("r.id").isNotNull() & F.col("r.created_at").isNotNull() & F.col("r.text").isNotNull() & F.col("r.user.screen_name").isNotNull())
        # "Wed Aug 27 13:08:45 +0000 2008": the day of the week follows from the rest
        moment = F.try_to_timestamp(F.regexp_replace("r.created_at", "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss xx yyyy"))
        moment = F.coalesce(moment, F.try_to_timestamp("r.created_at"))
        at = F.col("r.geo.coordinates")
        here = F.when(F.size(at) == 2, geo.point(F.get(at, F.lit(0)), F.get(at, F.lit(1))))
        corners = F.get(F.col("r.place.bounding_box.coordinates"), F.lit(0))
        out = rows.select(*keep, F.col("r.id").alias("id"), moment.alias("mtime"), F.filter(values.tokens(F.col("r.text")), lambda t: t != "").alias("keywords"), values.fold(F.col("r.user.screen_name")).alias("username"), F.coalesce(here, geo.centroid(corners)).alias("location"))
        return out.where(F.col("mtime").isNotNull())
