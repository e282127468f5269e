"""Locations: points and rectangles in degrees, as one struct, and what can be asked of them.

A point is the rectangle with n = s and e = w, so one expression serves both and its bounds can be
pushed down to the scan.  Boxes don't wrap at the antimeridian.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

GEO = "struct<kind:tinyint,n:double,s:double,e:double,w:double>"
POINT, RECTANGLE = 2, 4
EPSILON = 1e-6
# Miles in a degree of latitude, and in one of longitude at middle latitudes.
MILES_LAT, MILES_LNG = 69.1, 53.0


class Box(NamedTuple):
    north: float
    south: float
    east: float
    west: float

    def check(self) -> Box:
        if not (-90 <= self.south <= self.north <= 90 and -180 <= self.west <= self.east <= 180):
            raise ValueError(f"not a box in degrees (north, south, east, west): {tuple(self)}")
        return self


def rectangle(n: Column, s: Column, e: Column, w: Column, kind: int = RECTANGLE) -> Column:
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), *(c.cast("double").alias(a) for c, a in ((n, "n"), (s, "s"), (e, "e"), (w, "w"))))


def point(lat: Column, lng: Column) -> Column:
    return rectangle(lat, lat, lng, lng, POINT)


def parse(c: Column) -> Column:
    """``2:lat:lng`` or ``4:n:s:e:w``; other tags, bad numbers and ``null`` give null."""
    part = F.split(c, ":")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    whole = lambda n: F.forall(F.slice(part, 2, n), lambda x: x.try_cast("double").isNotNull()) & (F.size(part) == n + 1)
    tag = F.get(part, F.lit(0))
    return F.when((tag == "2") & whole(2), point(number(1), number(2))).when((tag == "4") & whole(4), rectangle(number(1), number(2), number(3), number(4)))


def text(g: Column) -> Column:
    """(lat,lng) or (n,s,e,w)."""
    join = lambda *names: F.concat(F.lit("("), F.concat_ws(",", *(g[n].cast("string") for n in names)), F.lit(")"))
    return F.when(g["kind"] == POINT, join("n", "e")).when(g["kind"] == RECTANGLE, join("n", "s", "e", "w"))


def within(g: Column, box: Box) -> Column:
    """Some corner of the location lies in the closed box (a box inside a rectangle, or across it, holds no corner)."""
    lat = g["n"].between(box.south, box.north) | g["s"].between(box.south, box.north)
    lng = g["w"].between(box.west, box.east) | g["e"].between(box.west, box.east)
    return lat & lng


def same_point(g: Column, lat: float, lng: float, epsilon: float = EPSILON) -> Column:
    return (F.abs(g["n"] - lat) < epsilon) & (F.abs(g["e"] - lng) < epsilon) & (g["n"] == g["s"]) & (g["e"] == g["w"])


def any_within(gs: Column, box: Box) -> Column:
    """For a list of locations: some element lies in the box."""
    return F.exists(gs, lambda g: within(g, box))


def distance_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Planar approximation."""
    return F.sqrt(F.pow(F.lit(MILES_LAT) * (lat1 - lat2), F.lit(2.0)) + F.pow(F.lit(MILES_LNG) * (lng1 - lng2), F.lit(2.0)))


def contains(outer: Column, inner: Column) -> Column:
    return (inner["n"] <= outer["n"]) & (inner["s"] >= outer["s"]) & (inner["e"] <= outer["e"]) & (inner["w"] >= outer["w"])


def merged(a: Column, b: Column) -> Column:
    """The least rectangle around both."""
    return rectangle(F.greatest(a["n"], b["n"]), F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]), F.least(a["w"], b["w"]))


def width_miles(g: Column) -> Column:
    return F.lit(MILES_LNG) * (g["e"] - g["w"])


def height_miles(g: Column) -> Column:
    return F.lit(MILES_LAT) * (g["n"] - g["s"])


def centroid(corners: Column) -> Column:
    """The mean of a list of [lng, lat] corners as a point."""
    mean = lambda i: F.aggregate(corners, F.lit(0.0), lambda t, c: t + F.get(c, F.lit(i))) / F.size(corners)
    return F.when(F.size(corners) > 0, point(mean(1), mean(0)))


# ---------------------------------------------------------------- the grid


class Grid(NamedTuple):
    """rows x cols cells over a box; cell = cols * y + x, y from north, x from west.  What lies outside is cell -1."""

    box: Box = Box(90.0, -90.0, 180.0, -180.0)
    rows: int = 180
    cols: int = 360

    def y(self, lat: Column) -> Column:
        step = (self.box.north - self.box.south) / self.rows
        return F.least(F.floor((F.lit(self.box.north) - lat) / step), F.lit(self.rows - 1)).cast("int")

    def x(self, lng: Column) -> Column:
        step = (self.box.east - self.box.west) / self.cols
        return F.least(F.floor((lng - self.box.west) / step), F.lit(self.cols - 1)).cast("int")

    def cell(self, lat: Column, lng: Column) -> Column:
        inside = lat.between(self.box.south, self.box.north) & lng.between(self.box.west, self.box.east)
        return F.when(inside, self.y(lat) * self.cols + self.x(lng)).otherwise(-1)

    def cells(self, g: Column) -> Column:
        """All cells that a location touches, clamped to the grid; [-1] if it lies outside."""
        top, bottom = F.least(g["n"], F.lit(self.box.north)), F.greatest(g["s"], F.lit(self.box.south))
        right, left = F.least(g["e"], F.lit(self.box.east)), F.greatest(g["w"], F.lit(self.box.west))
        ys, xs = F.sequence(self.y(top), self.y(bottom)), F.sequence(self.x(left), self.x(right))
        all_cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * self.cols + x)))
        return F.when((top >= bottom) & (left <= right), all_cells).otherwise(F.array(F.lit(-1)))

    def ranges(self, box: Box) -> list[tuple[int, int]]:
        """For each row of cells that a query box touches: its first and last cell.  Rows outside the grid are read as well (-1)."""
        high, wide = (self.box.north - self.box.south) / self.rows, (self.box.east - self.box.west) / self.cols
        y = [min(self.rows - 1, max(0, math.floor((self.box.north - v) / high))) for v in (box.north, box.south)]
        x = [min(self.cols - 1, max(0, math.floor((v - self.box.west) / wide))) for v in (box.west, box.east)]
        apart = box.north < self.box.south or box.south > self.box.north or box.east < self.box.west or box.west > self.box.east
        return [(-1, -1)] + ([] if apart else [(r * self.cols + x[0], r * self.cols + x[1]) for r in range(y[0], y[1] + 1)])

    def may_hold(self, cell: Column, box: Box) -> Column:
        """A condition on cells alone that no location in the box fails."""
        out = F.lit(False)
        for low, high in self.ranges(box):
            out |= (cell == low) if low == high else cell.between(low, high)
        return out
