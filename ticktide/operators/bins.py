"""Reductions over bins of the X coordinate.

A bin is the whole-number part, cut towards zero, of (x - origin) / width; the origin is shared by
all packet types of a stream. One aggregation with partial results serves every reduction, so
records in any order give one row a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timescales import micros

REDUCTIONS = ("mean", "min", "max", "stddev", "peak", "count")


def origin(df: DataFrame, x: Column):
    """The least x, read once by the driver, so that bins are a projection and no join."""
    return df.agg(F.min(x)).first()[0]


def _div(d: Column, width: int) -> Column:
    """Whole-number division, cut towards zero."""
    return ((d - d % width) / width).cast("long")


def bin_of(x: Column, first, width) -> Column:
    """Cut towards zero, so bin 0 is of double width where x may lie before the origin."""
    d = x - F.lit(first)
    return _div(d, width) if isinstance(width, int) and isinstance(first, int) else (d / width).cast("long")


def _reduced(c: Column, how: str) -> Column:
    return {
        "mean": F.avg(c),
        "min": F.min(c),
        "max": F.max(c),
        "stddev": F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))),
        "peak": F.when(F.count(c) > 0, F.greatest(F.max(c), F.lit(0.0))),
        "count": F.count(c),
    }[how]


def reduce_bins(df: DataFrame, x: Column, width, values: list[str], how=("mean",), keys: list[str] = (), first=None, items: dict[str, int] | None = None) -> DataFrame:
    """keys, bin, x (the bin's middle) and a column value_how for each reduction.

    Records without x are left out. Null (fill) values are skipped; a bin without any has null. items gives the length of columns
    that are fixed-length arrays: these are reduced item by item in the same aggregation. The peak
    starts from 0. first is the origin, the least x by default."""
    first = origin(df, x) if first is None else first
    if first is None:
        first = 0
    aggs = []
    for v in values:
        for h in how:
            n = (items or {}).get(v)
            c = F.array(*[_reduced(F.get(v, F.lit(j)), h) for j in range(n)]) if n else _reduced(F.col(v), h)
            aggs.append(c.alias(f"{v}_{h}"))
    out = df.where(x.isNotNull()).withColumn("bin", bin_of(x, first, width)).groupBy(*keys, "bin").agg(*aggs)
    return out.withColumn("x", F.lit(first) + width * (F.col("bin") + 0.5))


def reduce_seconds(df: DataFrame, time: str, seconds: float, values: list[str], how=("mean",), keys: list[str] = (), begin: int | None = None, items=None) -> DataFrame:
    """reduce_bins over microseconds of a timestamp column."""
    return reduce_bins(df, micros(F.col(time)), int(seconds * 1_000_000), values, how, keys, begin, items)


def collapse(df: DataFrame, wave: str, out: str) -> DataFrame:
    """A waveform column as one value per sample, for bins at least as wide as a waveform."""
    return df.withColumn(out, F.explode(wave)).drop(wave)


def goes_back(df: DataFrame, order: list[str], x: Column) -> bool:
    """Whether x decreases anywhere in the order: ranges of it are looked through apart, then their ends compared."""
    d = df.select(*order, x.cast("double").alias("x_")).repartitionByRange(*order).sortWithinPartitions(*order)
    at = d.columns.index("x_")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first = last = None
        bad = False
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False)
            if len(v):
                bad = bad or bool((np.diff(v) < 0).any()) or last is not None and v[0] < last
                first, last = v[0] if first is None else first, v[-1]
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": float(first), "last": float(last), "bad": bad}])

    ends = sorted(d.mapInArrow(run, "part long, first double, last double, bad boolean").collect())
    return any(e["bad"] for e in ends) or any(a["last"] > b["first"] for a, b in zip(ends, ends[1:], strict=False))


#: Bins that one task of a dense rate makes.
SPAN = 1 << 16


def rates(df: DataFrame, x: Column, width, dense: bool = True, events: bool = False, size: Column | None = None, first=None, order: list[str] | None = None) -> DataFrame:
    """bin and rate: records, or summed size, per unit of time in each bin, over all packet types.

    dense gives every bin from the least to the greatest, 0 where nothing is, made in tasks of SPAN
    bins; events gives 1.0 for each of them instead. Records without x are left out. With order, the
    stream's own order, a time that goes back raises."""
    if first is None or dense:
        low, high = df.agg(F.min(x), F.max(x)).first()
        first = low if first is None else first
    d = df.where(x.isNotNull())
    if order is not None:
        if goes_back(d, order, x):
            raise ValueError("time goes back")
    counted = d.withColumn("bin", bin_of(x, first or 0, width)).groupBy("bin").agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("n"))
    if dense:
        spark = df.sparkSession
        if low is None:
            return counted.select("bin", F.lit(0.0).alias("rate"))
        ends = spark.range(1).select(bin_of(F.lit(low), first, width).alias("a"), bin_of(F.lit(high), first, width).alias("b")).first()
        every = spark.range(ends["a"], ends["b"] + 1, 1, max(1, -(-(ends["b"] + 1 - ends["a"]) // SPAN)))
        counted = every.select(F.col("id").alias("bin")).join(counted, "bin", "left")
    n = F.lit(1.0) if events else F.coalesce("n", F.lit(0))
    return counted.select("bin", n.alias("rate"))


def from_zero(df: DataFrame, x: Column, period: float, values: list[str], keys: list[str] = ()) -> DataFrame:
    """Bins aligned to 0, none below it, and 0.0 for items without data."""
    at = (x / period).cast("long")
    return df.withColumn("bin", at).where("bin >= 0").groupBy(*keys, "bin").agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{v}_mean") for v in values])


#: Bytes in a unit of volume.
VOLUMES = {"bytes": 1, "kB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def volume(size: Column, unit: str) -> Column:
    """Bytes as kB, MB or GB of 1024 each."""
    return size / VOLUMES[unit]


def resolution_label(seconds: float) -> str:
    """Text on averaged data's resolution, as it is put after a title."""
    if seconds < 1:
        return f" ({seconds * 1000:.0f} ms Averages)"
    if seconds < 60:
        return f" ({seconds:.1f} s Averages)"
    if seconds < 3600:
        return f" ({seconds / 60:.1f} minute Averages)"
    return f" ({seconds / 3600:.1f} hour Averages)" if seconds < 86400 else f" ({seconds / 86400:.3g} day Averages)"


def interval_label(seconds: float) -> str:
    """An interval in prose: 1 second, 10 minutes, ..."""
    for size, name in ((86400, "day"), (3600, "hour"), (60, "minute"), (1, "second")):
        if seconds >= size:
            shown = f"{seconds / size:.3f}".rstrip("0").rstrip(".")
            return f"{shown} {name}" + ("" if shown == "1" else "s")
    return f"{seconds * 1000:g} milliseconds"


def axis_interval(seconds: float) -> str:
    """An interval for axis labels: s, 10 minutes, 1.5 hours, ...; within a thousandth of one it is the bare unit."""
    us = seconds * 1e6
    for size, one, many in ((86400e6, "day", "days"), (3600e6, "hour", "hours"), (60e6, "minute", "minutes"), (1e6, "s", "s"), (1e3, "ms", "ms"), (1.0, "μs", "μs"), (1e-3, "ns", "ns")):
        if us >= size or one == "ns":
            n = us / size
            return one if abs(1 - n) < 1e-3 else f"{n:.3f}".rstrip("0").rstrip(".") + f" {many}"
    raise AssertionError


def rate_label(seconds: float, unit: str | None = None, events: bool = False) -> tuple[str, str]:
    """Label and units of a rate of packets, or of a volume in unit; coverage has no units."""
    if events:
        return "Coverage", ""
    one = axis_interval(seconds)
    return f"Stream Volume ({unit or 'packets'}/{one})", f"{unit or 'packets'} {one}**-1"


def width_properties(seconds: float, before: float | None = None) -> dict[str, str]:
    """Stream properties after binning; data already coarser than the bins keep their own resolution."""
    width = max(seconds, before or 0)
    return {"xTagWidth": f"{width:g} s", "xCacheResolution": f"{width:g} s", "xCacheResInfo": resolution_label(width)}


def collapses(renderer: str, offsets: list[float], width: float) -> bool:
    """Whether a scan is a waveform so short that a bin holds it whole."""
    return renderer == "waveform" and bool(offsets) and max(offsets) - min(offsets) <= width


def totals(df: DataFrame, size: Column, time: str | None = None) -> DataFrame:
    """One row: records, bytes, seconds from the first to the last time, and kB a second."""
    seconds = (F.max(micros(F.col(time))) - F.min(micros(F.col(time)))) / 1e6 if time else F.lit(None).cast("double")
    d = df.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), seconds.alias("seconds"))
    return d.withColumn("kb_per_s", F.when(F.col("seconds") > 0, F.col("bytes") / 1024 / F.col("seconds")))


def runs(df: DataFrame, order: list[str], keys: list[str], x: Column, width, value: str, first=None, version: Column | None = None) -> DataFrame:
    """keys, run, bin, mean, n: one row each time the bin (or the type's version) changes in the stream's order.

    Late records open their bin again, as a reader that emits on change would; order must be total
    within keys, or rows of equal order may fall either way."""
    from pyspark.sql import Window

    first = origin(df, x) if first is None else first
    w = Window.partitionBy(*keys).orderBy(*order)
    mark = F.struct(F.col("bin"), (F.lit(0) if version is None else version).alias("v"))
    d = df.withColumn("bin", bin_of(x, first or 0, width)).withColumn("mark", mark)
    d = d.withColumn("new", F.when(F.lag("mark").over(w).eqNullSafe(F.col("mark")), 0).otherwise(1))
    d = d.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run", "bin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
