"""Whole files written by executors: a data source sink with a commit, for streams that no built-in sink can hold."""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.ending = options["path"].removeprefix("file://"), options.get("ending", "")
        self.head, self.then = bytes.fromhex(options.get("head", "")), bytes.fromhex(options.get("then", ""))
        self.deflate = options.get("deflate") == "true"

    def write(self, rows):
        """One file a task under a hidden name of its own; commit shows it, so a repeated task leaves no second copy."""
        os.makedirs(self.path, exist_ok=True)
        name = f".{uuid.uuid4().hex}"
        squeeze = zlib.compressobj() if self.deflate else None
        with open(f"{self.path}/{name}", "wb") as f:
            f.write(self.head)
            f.write(squeeze.compress(self.then) if squeeze else self.then)
            empty = True
            for r in rows:
                empty = False
                f.write(squeeze.compress(bytes(r[0])) if squeeze else bytes(r[0]))
            if squeeze:
                f.write(squeeze.flush())
        if empty:
            os.remove(f"{self.path}/{name}")
            name = ""
        return _Written(name)

    def commit(self, messages):
        for i, m in enumerate(x for x in messages if x is not None and x.name):
            os.replace(f"{self.path}/{m.name}", f"{self.path}/part-{i:05d}{self.ending}")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.name and os.path.exists(f"{self.path}/{m.name}"):
                os.remove(f"{self.path}/{m.name}")


class ByteFiles(DataSource):
    """Rows of one binary column as files on a path that all machines share."""

    @classmethod
    def name(cls):
        return "ticktide_bytes"

    def schema(self):
        return "value binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_bytes(values: DataFrame, path: str, ending: str, head: bytes = b"", then: bytes = b"", deflate: bool = False) -> None:
    """A folder with a file for each partition that has rows: head, then the bytes "then" and the column value, deflated if asked.

    path is a folder that all machines mount; it must not hold files yet."""
    if os.path.isdir(path.removeprefix("file://")) and os.listdir(path.removeprefix("file://")):
        raise ValueError(f"{path} isn't empty")
    values.sparkSession.dataSource.register(ByteFiles)
    values.select("value").write.format("ticktide_bytes").mode("append").option("ending", ending).option("head", head.hex()).option("then", then.hex()).option("deflate", str(deflate).lower()).save(path)
