"""Closed periods of time; a null end is open."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SPAN = timedelta(hours=3)


def moment(at: datetime, kind: str = "timestamp") -> Column:
    """A literal; a moment without a zone is in UTC whatever the session's zone."""
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat(sep=" ") + ("" if kind == "timestamp_ntz" else "+00:00")).cast(kind)


class Period(NamedTuple):
    start: datetime | None = None
    end: datetime | None = None

    def check(self) -> Period:
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError(f"a period ends before it begins: {self.start} > {self.end}")
        return self

    @classmethod
    def until(cls, now: datetime, span: timedelta = DEFAULT_SPAN) -> Period:
        return cls(now - span, now)

    def holds(self, ts: Column, kind: str = "timestamp") -> Column:
        """kind: ``timestamp`` or ``timestamp_ntz``, as the column is."""
        out = F.lit(True)
        if self.start is not None:
            out &= ts >= moment(self.start, kind)
        if self.end is not None:
            out &= ts <= moment(self.end, kind)
        return out


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """The periods share a moment."""
    return F.coalesce(a_from <= b_to, F.lit(True)) & F.coalesce(b_from <= a_to, F.lit(True))


def starts_within(a_from: Column, b_from: Column, b_to: Column) -> Column:
    return F.coalesce(a_from >= b_from, b_from.isNull()) & F.coalesce(a_from <= b_to, F.lit(True))


def starts_before(a_from: Column, moment: Column) -> Column:
    return F.coalesce(a_from < moment, F.lit(True))


def starts_after(a_from: Column, moment: Column) -> Column:
    return F.coalesce(a_from > moment, F.lit(False))


def ends_before(a_to: Column, moment: Column) -> Column:
    return F.coalesce(a_to < moment, F.lit(False))
