"""Datums: one value with its unit or a time, parsed, converted and formatted on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from . import timescales, units

_NUMBER = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?:\s+(\S.*?))?\s*\Z")


@dataclass(frozen=True)
class Datum:
    """A number with a unit, or microseconds since 1970 with the unit UTC."""

    value: float
    unit: str = ""

    @property
    def is_time(self) -> bool:
        return self.unit == "UTC"

    def to(self, unit: str) -> float:
        """The number in another unit, or a time's on another epoch's scale."""
        if self.is_time:
            if unit == "UTC":
                return self.value
            return units.convert(self.value - timescales.US_1970_2000, "us2000", unit)
        return units.convert(self.value, self.unit, unit)

    def time(self) -> Datum:
        """A number on an epoch scale as a time."""
        return self if self.is_time else Datum(round(units.convert(self.value, self.unit, "us2000")) + timescales.US_1970_2000, "UTC")

    def text(self, digits: int = 6, seconds: int = 3) -> str:
        """digits is for numbers (trailing zeros cut), seconds for times."""
        if self.is_time:
            return timescales.format_micros(int(self.value), seconds) + " UTC"
        return f"{self.value:.{digits}g}" + (f" {self.unit}" if self.unit else "")


def parse(s: str, unit: str = "") -> Datum:
    """A number with an optional unit ("80 s"), or a time ("2017-001T14:00 UTC"); unit is that of bare numbers."""
    if m := _NUMBER.match(s):
        if m[2] is None or not re.match(r"[-:]|\d", m[2]):
            return Datum(float(m[1]), (m[2] or unit).strip())
    return Datum(timescales.parse_micros(s), "UTC")


def parse_range(s: str) -> tuple[Datum, Datum]:
    """low to high, with a unit after the high one for both."""
    low, _, high = s.partition(" to ")
    if not high:
        raise ValueError(f"{s!r} is no range")
    b = parse(high)
    a = parse(low, "" if b.is_time else b.unit)
    if a.is_time != b.is_time:
        raise ValueError(f"{s!r} mixes a time and a number")
    return a, b


def compare(a: Datum, b: Datum) -> int:
    """By value in a's unit; NaN if they can't be converted raises."""
    x, y = a.value if not a.is_time else a.value, b.to(a.unit)
    if math.isnan(x) or math.isnan(y):
        raise ValueError("no order with NaN")
    return (x > y) - (x < y)
