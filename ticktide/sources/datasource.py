"""Version 3 streams as a batch data source: spark.read.format("ticktide_stream").option("set", id).load(path).

Paths are files or folders that all machines mount; each file is one partition. The columns are
those of v3.schema, calendar values as text."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import v3
from .packets import StreamError

#: Bytes read at a time while the driver looks for headers.
HEAD = 1 << 20


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(f for f in (glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)) if not os.path.basename(f).startswith((".", "_")))


def first_header(path: str, k: int | None) -> v3.Dataset:
    """The dataset's header, from as much of the first file that has it as holds it."""
    for f in files(path):
        size, limit = os.path.getsize(f), HEAD
        while True:
            with open(f, "rb") as h:
                data = h.read(limit)
            try:
                for tag, n, body in v3.packets(data):
                    if tag == "Hx" and k in (None, n):
                        return v3.dataset(n, body)
            except StreamError:
                if limit >= size:
                    raise
            if limit >= size:
                break
            limit *= 8
    raise StreamError(f"no dataset {k if k is not None else ''} at {path}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, dataset: v3.Dataset):
        self.path, self.dataset = path, dataset

    def partitions(self):
        return [InputPartition(f) for f in files(self.path)]

    def read(self, partition):
        with open(partition.value, "rb") as h:
            data = h.read()
        for tag, k, body in v3.packets(data):
            if tag == "Pd" and k == self.dataset.id:
                yield tuple(_row(v, x, len(v.extents)) for v, x in zip(self.dataset.recorded, v3.record(self.dataset, body), strict=True))


def _row(v: v3.Variable, x, depth: int):
    return [_row(v, y, depth - 1) for y in x] if depth and x is not None else x


class StreamSource(DataSource):
    @classmethod
    def name(cls):
        return "ticktide_stream"

    def _dataset(self) -> v3.Dataset:
        k = self.options.get("set")
        return first_header(self.options["path"], int(k) if k else None)

    def schema(self):
        return T.StructType([T.StructField(f.name, f.dataType) for f in v3.schema(self._dataset()).fields])

    def reader(self, schema):
        return _Reader(self.options["path"], self._dataset())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StreamSource)
