"""Discrete Fourier magnitudes and power spectral densities in Arrow batches, and cadence segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = {1: 0.0, 2: 0.5, 3: 2 / 3, 4: 0.75}


def weights(n: int, window: str | None, kind: str = "psd") -> np.ndarray:
    """None, or the Hann window: half-scale for densities, double for plain transforms."""
    if n < 2 or n % 2:
        raise ValueError(f"length {n} isn't even")
    if window is None:
        return np.ones(n)
    if window != "hann":
        raise ValueError(f"unknown window {window}")
    return (0.5 if kind == "psd" else 2.0) * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def psd_of(x: np.ndarray, window: str | None = "hann", center: bool = True) -> np.ndarray:
    """One-sided densities of rows: ends single, others summed from both sides."""
    n = x.shape[-1]
    w = weights(n, window)
    x = x - x.mean(axis=-1, keepdims=True) if center else x
    p = np.abs(np.fft.rfft(x * w, axis=-1)) ** 2 / (n * (w**2).sum() if window else n * n)
    p[..., 1:-1] *= 2
    return p


def magnitude_of(x: np.ndarray, window: str | None = None) -> np.ndarray:
    n = x.shape[-1]
    m = np.abs(np.fft.rfft(x * weights(n, window, "dft"), axis=-1)) / n
    m[..., 1:-1] *= 2
    return m


def array_transform(df: DataFrame, array: str, out: str, length: int, f) -> DataFrame:
    """df with out, f of the array column's rows of that length; others, and those with a null item, get null."""
    names = df.columns

    def run(batches):
        for b in batches:
            a = b.column(b.schema.get_field_index(array))
            # Rows of the right length lie apart in one flat buffer; they are reshaped together, without Python values.
            offsets, flat = a.offsets.to_numpy(), a.values.cast(pa.float64())
            nulls = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
            size = offsets[1:] - offsets[:-1]
            good = a.is_valid().to_numpy(zero_copy_only=False) & (size == length) & (nulls[offsets[1:]] == nulls[offsets[:-1]])
            x = flat.to_numpy(zero_copy_only=False)[(offsets[:-1][good][:, None] + np.arange(length)).ravel()].reshape(-1, length)
            y = f(x) if len(x) else np.empty((0, 1))
            ends = np.concatenate(([0], np.cumsum(np.where(good, y.shape[1], 0)))).astype(np.int32)
            res = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y.ravel(), pa.float64()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([*b.columns, res], [*names, out])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{out}` array<double>")


def psd(df: DataFrame, array: str, out: str = "psd", length: int = 64, window: str | None = "hann", center: bool = True) -> DataFrame:
    return array_transform(df, array, out, length, lambda x: psd_of(x, window, center))


def magnitude(df: DataFrame, array: str, out: str = "magnitude", length: int = 64, window: str | None = None) -> DataFrame:
    return array_transform(df, array, out, length, lambda x: magnitude_of(x, window))


def frequencies(interval: float, length: int) -> np.ndarray:
    """Axis of a transform of length samples, interval apart."""
    return np.arange(length // 2 + 1) / (interval * length)


def segments(df: DataFrame, key: list[str], order: list[str], t: Column, jitter: float = 0.01) -> DataFrame:
    """df with seg, the number of cadence breaks before a row in its series.

    Three points whose spacing differs by more than the jitter break the cadence, and the new
    segment starts at the middle one. A series is one window partition; give long ones a key that
    also holds a period."""
    w = Window.partitionBy(*key).orderBy(*order)
    names = df.columns
    d = df.withColumn("s_t", t).withColumn("s_1", F.lag("s_t", 1).over(w)).withColumn("s_0", F.lag("s_t", 2).over(w))
    off = 2.0 * F.abs(F.col("s_t") - 2 * F.col("s_1") + F.col("s_0")) / (F.col("s_t") - F.col("s_0"))
    d = d.withColumn("s_b", F.when(F.col("s_0").isNotNull() & (F.col("s_t") > F.col("s_0")) & (off > jitter), 1).otherwise(0))
    d = d.withColumn("s_n", F.coalesce(F.lead("s_b").over(w), F.lit(0)))
    return d.select(*names, F.sum("s_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seg"))


def sliding(df: DataFrame, array: str, length: int, slide: int = 1) -> DataFrame:
    """One row per window of length items, length // slide apart, of an array column: pos and window."""
    hop = length // slide
    starts = F.when(F.size(array) >= length, F.sequence(F.lit(0), F.size(array) - length, F.lit(hop)))
    d = df.withColumn("pos", F.explode(starts))
    return d.withColumn("window", F.slice(F.col(array), F.col("pos") + 1, length))


def series_windows(df: DataFrame, key: list[str], order: list[str], value: str, length: int, slide: int = 1) -> DataFrame:
    """key, win, values: count-based windows over rows of each series, complete ones only.

    Each row goes to at most slide windows, then rows meet by series and window, so no series is
    collected whole."""
    hop = length // slide
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("n", F.row_number().over(w) - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / hop)).cast("int")
    d = d.withColumn("win", F.explode(F.sequence(low, F.floor(F.col("n") / hop).cast("int"))))
    g = d.groupBy(*key, "win").agg(F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("v")))).alias("x"))
    return g.where(F.size("x") == length).select(*key, "win", F.transform("x", lambda s: s["v"]).alias("values"))


def components_of(x: np.ndarray, window: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts of the whole transform of rows."""
    z = np.fft.fft(x * weights(x.shape[-1], window, "dft"), axis=-1)
    return z.real, z.imag


def power_ratio(x: np.ndarray, spectrum: np.ndarray, center: bool = True) -> np.ndarray:
    """Summed density over the mean square of the input before windowing; 1 without a window."""
    x = x - x.mean(axis=-1, keepdims=True) if center else x
    return spectrum.sum(axis=-1) / (x**2).mean(axis=-1)


def trim(df: DataFrame, array: str, low: float, high: float, axis: list[float]) -> tuple[DataFrame, list[float]]:
    """df with the items of array whose axis value is in [low, high), and the axis left."""
    keep = [i for i, f in enumerate(axis) if low <= f < high]
    if not keep:
        raise ValueError(f"no value of the axis in [{low}, {high})")
    return df.withColumn(array, F.slice(array, keep[0] + 1, len(keep))), [axis[i] for i in keep]


def density(units_in: str, interval: float, length: int, hertz: float = 1.0) -> tuple[float, str]:
    """Factor that makes summed power a density per Hz, and the density's units."""
    from ..functions import units

    return length * interval / hertz, units.multiply(units.power(units_in, 2), "Hz**-1") if units_in else "Hz**-1"


def series_psd(df: DataFrame, key: list[str], time: str, value: str, interval: float, length: int, slide: int = 1, window: str | None = "hann", center: bool = True, units_in: str = "", jitter: float = 0.01) -> DataFrame:
    """Spectra of a series of single values: key, seg, win, t (centre of the window, seconds), psd (length / 2 + 1 densities).

    Breaks of the cadence begin a new segment; each segment has windows of length rows, length //
    slide apart, complete ones only. A window with a null has a null spectrum, and windows whose
    spectrum is 0 throughout are left out. The frequency axis and units are the column's metadata."""
    scale, out_units = density(units_in, interval, length)
    seg = segments(df, key, [time], F.col(time), jitter)
    w = Window.partitionBy(*key, "seg").orderBy(time)
    rows = seg.withColumn("n", F.row_number().over(w) - 1)
    hop = length // slide
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / hop)).cast("int")
    rows = rows.withColumn("win", F.explode(F.sequence(low, F.floor(F.col("n") / hop).cast("int"))))
    g = rows.groupBy(*key, "seg", "win").agg(F.array_sort(F.collect_list(F.struct("n", F.col(time).alias("t"), F.col(value).alias("v")))).alias("x")).where(F.size("x") == length)
    g = g.select(*key, "seg", "win", (F.element_at("x", -1)["t"] - length / 2 * interval).alias("t"), F.transform("x", lambda s: s["v"]).alias("values"))
    return _finished(psd(g, "values", "psd", length, window, center).drop("values"), "psd", scale, interval, length, out_units)


def scan_psd(df: DataFrame, array: str, time: str, interval: float, length: int, slide: int = 1, window: str | None = "hann", center: bool = True, units_in: str = "") -> DataFrame:
    """Spectra inside each scan: df's other columns, pos, time moved to the window's centre, and psd.

    Windows with a null or beyond the scan's end have a null spectrum, and where it is 0 throughout
    the row is left out. Its axis and units are the column's metadata."""
    scale, out_units = density(units_in, interval, length)
    d = sliding(df, array, length, slide).drop(array)
    d = d.withColumn(time, F.col(time) + (F.col("pos") + length / 2) * interval)
    return _finished(psd(d, "window", "psd", length, window, center).drop("window"), "psd", scale, interval, length, out_units)


def _finished(d: DataFrame, out: str, scale: float, interval: float, length: int, out_units: str) -> DataFrame:
    meta = {"units": out_units, "tags": [float(f) for f in frequencies(interval, length)], "tag_units": "Hz"}
    d = d.where(F.col(out).isNull() | F.exists(out, lambda v: v != 0))
    return d.withColumn(out, F.transform(out, lambda v: v * scale).alias(out, metadata=meta))
