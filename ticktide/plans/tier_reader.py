"""Reading a tiered cache: the chosen tier's files that exist, headers put together, records in a padded range."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import time_range
from ..sources import packets
from . import tiers

#: Files that one request may name; a longer one asks for a coarser tier.
MOST_FILES = 100_000
_STEP = {"yearly": timedelta(days=366), "monthly": timedelta(days=31), "daily": timedelta(days=1), "hourly": timedelta(hours=1), "perminute": timedelta(minutes=1), "persecond": timedelta(seconds=1)}


class NoData(LookupError):
    """No records in the range; its packet is what a reader sends."""

    def __init__(self, begin: datetime, end: datetime):
        super().__init__(f"No data in interval {begin.isoformat()} to {end.isoformat()}")
        self.packet = packets.no_data(begin.isoformat(), end.isoformat())


def existing(spark: SparkSession, root: str, relative: list[str], ending: str = ".d2t") -> list[str]:
    """The paths under root that exist, as the cluster's file system sees them."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for r in relative:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{r}{ending}")
        if p.getFileSystem(conf).exists(p):
            out.append(p.toString())
    return out


def request(config: Mapping[str, str], params: str, begin: datetime, end: datetime, resolution: float, pad: float = 0.0) -> tuple[float, list[str], datetime, datetime]:
    """Bin size, relative paths and the padded range; the end is rounded up to whole periods for the paths."""
    low, high = begin - timedelta(seconds=pad), end + timedelta(seconds=pad)
    own = tiers.levels(config, params)
    size = tiers.choose(own, resolution)
    if (high - low) / _STEP[own[size]["period"]] > MOST_FILES:
        raise tiers.NoTier(f"over {MOST_FILES} files at {size:g} s")
    return size, tiers.paths(own[size]["period"], low, high), low, high


def read(spark: SparkSession, config: Mapping[str, str], root: str, params: str, begin: datetime, end: datetime, resolution: float, pad: float = 0.0, time: str = "time", ending: str = ".d2t") -> dict[int, DataFrame]:
    """A frame per packet type of the chosen tier, records from begin - pad up to end + pad (seconds).

    Equal formats of different files are one type. Without files NoData is raised; a range without
    records gives empty frames, as finding out would read them."""
    size, relative, low, high = request(config, params, begin, end, resolution, pad)
    level = f"bin-{size:g}s" if size else "intrinsic"
    found = existing(spark, f"{root}/{params}/{level}", relative, ending)
    if not found:
        raise NoData(begin, end)
    out = {}
    for k, df in packets.read(spark, found).items():
        meta = df.schema[time].metadata
        df = df.withColumn(time, F.to_timestamp_ntz(time).alias(time, metadata=meta))
        out[k] = time_range(df, time, low, high)
    return out


def required(frames: dict[int, DataFrame], begin: datetime, end: datetime) -> dict[int, DataFrame]:
    """The frames, or NoData where all are empty; looks for a first record only."""
    if all(df.isEmpty() for df in frames.values()):
        raise NoData(begin, end)
    return frames
