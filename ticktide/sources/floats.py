"""Version 1 records: bare big-endian floats, with or without tags, and their text forms."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timescales import US_1970_2000
from .packets import StreamError

_TAG = re.compile(rb":b0:\s*(\d+)\s")


def records(data: bytes, items: int) -> np.ndarray:
    """Rows of items big-endian floats; a short last record raises."""
    if items < 1 or len(data) % (4 * items):
        raise StreamError(f"{len(data)} bytes aren't records of {items} floats")
    return np.frombuffer(data, ">f4").astype(float).reshape(-1, items)


def tagged(data: bytes):
    """The float arrays of :b0: packets, whose lengths may differ."""
    at = 0
    while at < len(data):
        m = _TAG.match(data, at)
        if not m:
            if not data[at:].strip():
                return
            raise StreamError(f"no tag at byte {at}")
        size = int(m[1])
        raw = data[m.end() : m.end() + size]
        if len(raw) < size or size % 4:
            raise StreamError(f"short record at byte {at}")
        at = m.end() + size
        yield np.frombuffer(raw, ">f4").astype(float)


def tag(values) -> bytes:
    raw = np.asarray(values, ">f4").tobytes()
    return b":b0:" + f"{len(raw)} ".encode() + raw


def read(spark: SparkSession, path: str, names: list[str], begin_us: int, fill: float | None = None) -> DataFrame:
    """time and a column per name: the first float of each record is seconds since begin_us (microseconds since 1970)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(0).to_pylist():
                x = records(raw, len(names) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(x.shape[1])], ["offset", *names])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{n}` double" for n in ["offset", *names]))
    clean = lambda c: F.when(c != fill, c) if fill is not None else c
    return raw.select(F.timestamp_micros((F.round(F.col("offset") * 1e6)).cast("long") + begin_us).cast("timestamp_ntz").alias("time"), *[clean(F.col(f"`{n}`")).alias(n) for n in names])


def read_tagged(spark: SparkSession, path: str, begin_us: int, scans: dict[int, list[float]], fill: float | None = None) -> dict[int, DataFrame]:
    """A frame per record length: time and values, its tags in the metadata; lengths without tags raise."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(0).to_pylist():
                got = list(tagged(raw))
                if any(len(x) - 1 not in scans for x in got):
                    raise StreamError("a record of a length without tags")
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1:].tolist() for x in got], pa.list_(pa.float64()))], ["offset", "values"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "offset double, values array<double>")
    out = {}
    for n, tags in scans.items():
        values = F.transform("values", lambda v: F.when(v != fill, v)) if fill is not None else F.col("values")
        out[n] = raw.where(F.size("values") == n).select(F.timestamp_micros((F.round(F.col("offset") * 1e6)).cast("long") + begin_us).cast("timestamp_ntz").alias("time"), values.alias("values", metadata={"tags": tags}))
    return out


def us2000_base(begin_us: int) -> int:
    """Microseconds since 2000 of a begin time in microseconds since 1970."""
    return begin_us - US_1970_2000


def lines(df: DataFrame, time: str | None = "time") -> DataFrame:
    """One text column: ISO time to the millisecond, then numbers as %10.3e, null as 0."""
    first = [F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS")] if time else []
    return df.select(F.concat_ws(" ", *first, *[F.format_string("%10.3e", F.coalesce(F.col(f"`{f.name}`").cast("double"), F.lit(0.0))) for f in df.schema.fields if f.name != time]).alias("value"))
