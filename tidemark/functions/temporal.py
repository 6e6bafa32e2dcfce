"""Half-open ranges as column pairs, and points of one axis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(start: Column, end: Column, point: Column) -> Column:
    return (start <= point) & (point < end)


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct(range_start, range_end), or null where the ranges do not meet."""
    return F.when(overlaps(a_start, a_end, b_start, b_end), F.struct(F.greatest(a_start, b_start).alias("range_start"), F.least(a_end, b_end).alias("range_end")))


def difference(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """What the second range leaves of the first: an array of up to two ranges."""
    one = lambda s, e: F.struct(s.alias("range_start"), e.alias("range_end"))
    met = F.array(one(a_start, F.greatest(a_start, b_start)), one(F.least(a_end, b_end), a_end))
    return F.filter(F.when(overlaps(a_start, a_end, b_start, b_end), met).otherwise(F.array(one(a_start, a_end))), lambda r: r["range_start"] < r["range_end"])


def magnitude(start: Column, end: Column) -> Column:
    return end - start


def microseconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


AXES = ("position", "time")


@dataclass(frozen=True)
class Point:
    """A point of one axis and clock; points of others do not compare."""

    value: int
    axis: str = "position"
    clock: str | None = None

    def __post_init__(self):
        if self.axis not in AXES:
            raise ValueError(f"unknown axis {self.axis}")

    def _of(self, other: Point) -> int:
        if (self.axis, self.clock) != (other.axis, other.clock):
            raise ValueError("points of two axes or clocks do not compare")
        return other.value

    def __lt__(self, other: Point) -> bool:
        return self.value < self._of(other)

    def __le__(self, other: Point) -> bool:
        return self.value <= self._of(other)


@dataclass(frozen=True)
class Range:
    """[start, end); without an end it is open."""

    start: Point
    end: Point | None = None
    end_status: str = "Closed"

    def __post_init__(self):
        if self.end is not None and self.end < self.start:
            raise ValueError("a range ends before it starts")

    @property
    def has_end(self) -> bool:
        return self.end is not None

    @property
    def is_empty(self) -> bool:
        return self.end is not None and self.end.value == self.start.value

    @property
    def length(self) -> int:
        if self.end is None:
            raise ValueError("an open range has no length")
        return self.end.value - self.start.value

    def contains(self, point: Point) -> bool:
        return self.start <= point and (self.end is None or point < self.end)

    def overlaps(self, other: Range) -> bool:
        return (other.end is None or self.start < other.end) and (self.end is None or other.start < self.end)
