"""Array operators: append, pad, put, slice, sequences, reductions along an index, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(base, step, n: Column | int) -> Column:
    """base + step * i for i from 0 to n - 1; empty for n of 0. Integer overflow is an error."""
    n = n if isinstance(n, Column) else F.lit(n)
    base, step = (x if isinstance(x, Column) else F.lit(x) for x in (base, step))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: base + step * i)).otherwise(F.array().cast("array<double>"))


def plus_reference(offsets: Column, reference: Column) -> Column:
    """Coordinate of each item: reference + offset."""
    return F.transform(offsets, lambda o: reference + o)


def part(a: Column, start: int, stop: int | None = None) -> Column:
    """Items start to stop - 1, counted from 0; to the end without stop."""
    if start < 0 or stop is not None and stop <= start:
        raise ValueError(f"bad range {start}:{stop}")
    return F.slice(a, start + 1, F.size(a) if stop is None else F.lit(stop - start))


def item(a: Column, i: int) -> Column:
    """The i-th item from 0, null beyond the end."""
    return F.get(a, F.lit(i))


def nearest(a: Column, coords: Column, at: float) -> Column:
    """The item whose coordinate is nearest; of equals the first."""
    pairs = F.transform(coords, lambda c, i: F.struct(F.abs(c - at).alias("d"), i.alias("i")))
    return F.get(a, F.array_min(pairs)["i"])


def put(a: Column, i: int, value) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.lit(value)).otherwise(x))


def pad(a: Column, n: int, fill=None) -> Column:
    """Ragged to n items, short ones filled."""
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def total(a: Column) -> Column:
    """Sum of non-null items, null if there are none."""
    kept = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x))


def mean_over(a: Column, coords: Column) -> Column:
    """Sum over the coordinate's extent."""
    return total(a) / (F.array_max(coords) - F.array_min(coords))


def from_csv(s: Column, sep: str = ",") -> Column:
    """Doubles of a separated list; items that are no number become null."""
    return F.transform(F.split(s, f"\\Q{sep}\\E"), lambda x: F.trim(x).try_cast("double"))


def to_csv(a: Column, sep: str = ",", digits: int = 6) -> Column:
    return F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}e", x.cast("double"))), sep)


def append(a: Column, *values) -> Column:
    """Items added at the end of an array."""
    return F.concat(a, F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]))


def runs(a: Column, ends: Column) -> Column:
    """A flat array cut into runs that end before each of the ascending positions; a last open run is kept if it has items."""
    stops = F.concat(ends, F.when(F.coalesce(F.element_at(ends, -1), F.lit(0)) < F.size(a), F.array(F.size(a))).otherwise(F.array().cast("array<int>")))
    return F.transform(stops, lambda stop, i: F.slice(a, F.when(i == 0, 1).otherwise(F.get(stops, i - 1) + 1), stop - F.when(i == 0, 0).otherwise(F.get(stops, i - 1))))


def cleared(a: Column) -> Column:
    """An empty array of the same kind."""
    return F.slice(a, 1, 0)


def shape(a: Column, rank: int = 1) -> Column:
    """Largest size at each of rank nested levels, for the array as a cube."""
    level, out = a, []
    for k in range(rank):
        out.append(F.size(level) if k == 0 else F.coalesce(F.array_max(F.transform(level, F.size)), F.lit(0)))
        level = level if k == 0 else F.flatten(level)
    return F.array(*out)


def count_items(a: Column, rank: int = 1) -> Column:
    """Items in all nested levels."""
    for _ in range(rank - 1):
        a = F.flatten(a)
    return F.size(a)


def has(a: Column, *at: int) -> Column:
    """Whether the index is within the (nested) array."""
    ok, here = F.lit(True), a
    for i in at:
        ok = ok & (F.lit(i) >= 0) & (F.lit(i) < F.coalesce(F.size(here), F.lit(0)))
        here = F.get(here, F.lit(i))
    return ok


def cube(a: Column, n: int, m: int, fill=None) -> Column:
    """A ragged array of arrays as n by m, short runs and missing ones filled."""
    rows = F.transform(a, lambda r: pad(r, m, fill))
    return F.concat(rows, F.array_repeat(F.array_repeat(F.lit(fill).cast("double") if fill is None else F.lit(fill), m), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def box_shape(ranges: list[tuple[int, int]]) -> list[int]:
    """Extents of an index box [low, high) in each index; those of 1 are dropped, and an empty or negative range raises."""
    for low, high in ranges:
        if low < 0 or high <= low:
            raise ValueError(f"bad range {low}:{high}")
    return [high - low for low, high in ranges if high - low > 1]


def box(a: Column, ranges: list[tuple[int, int]]) -> Column:
    """The items of a nested array in an index box; indices of one item lose their level."""
    box_shape(ranges)
    (low, high), rest = ranges[0], ranges[1:]
    if high - low == 1:
        one = F.get(a, F.lit(low))
        return box(one, rest) if rest else one
    cut = F.slice(a, low + 1, high - low)
    return F.transform(cut, lambda x: box(x, rest)) if rest else cut


def cube_index(ranges: list[tuple[int, int]]) -> Column:
    """Every index of a box, last index fastest, as an array of arrays."""
    box_shape(ranges)

    def longer(low: int, high: int):
        return lambda x: F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: F.concat(x, F.array(i.cast("int"))))

    out = F.array(F.array().cast("array<int>"))
    for low, high in ranges:
        out = F.flatten(F.transform(out, longer(low, high)))
    return out


def tags(values: list[float] | None = None, start: float | None = None, step: float | None = None, n: int | None = None) -> list[float]:
    """Tag values of a scan: the list, or a series from start by step of n."""
    if values:
        return [float(v) for v in values]
    if n is None or step is None:
        raise ValueError("tags are a list, or a step and a number")
    return [(start or 0.0) + i * step for i in range(n)]


def interval(tag_values: list[float], part: float = 0.01, most: int = 2) -> float:
    """The mean spacing of tags; raises where more than most spacings are off by over that part."""
    if len(tag_values) < 2:
        raise ValueError("fewer than two tags")
    gaps = [b - a for a, b in zip(tag_values, tag_values[1:], strict=False)]
    mean = (tag_values[-1] - tag_values[0]) / len(gaps)
    if not mean or sum(abs(g - mean) > part * abs(mean) for g in gaps) > most:
        raise ValueError("irregular tags")
    return mean
