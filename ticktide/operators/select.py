"""Row and column selection: selector queries, half-open ranges, newest versions, resolution tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__", "beg": "__ge__", "end": "__lt__"}


def predicate(df: DataFrame, selectors: list[str]) -> Column:
    """The conjunction of key.op.value selectors; values are cast to the column's type, so filters reach the scan.

    beg and end make a half-open range. Unknown columns or operators raise."""
    out = F.lit(True)
    for s in selectors:
        key, op, value = s.split(".", 2)
        if key not in df.columns or op not in OPS:
            raise ValueError(f"bad selector {s!r}")
        kind = df.schema[key].dataType
        out = out & getattr(F.col(key), OPS[op])(F.lit(value).cast(kind))
    return out


def select_where(df: DataFrame, selectors: list[str], columns: list[str] | None = None) -> DataFrame:
    d = df.where(predicate(df, selectors))
    return d.select(*columns) if columns else d


def time_range(df: DataFrame, time: str, begin, end) -> DataFrame:
    """Rows from begin up to, not including, end."""
    kind = df.schema[time].dataType
    return df.where((F.col(time) >= F.lit(begin).cast(kind)) & (F.col(time) < F.lit(end).cast(kind)))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def union_packets(frames: list[DataFrame]) -> DataFrame:
    """Packets of equal format put together; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def request(df: DataFrame, arguments: list[str], enums: dict[str, list[str]] | None = None, outputs: dict[str, list[str]] | None = None) -> DataFrame:
    """df by a reader's arguments: key.op.value selectors, and out.NAME for the groups of columns to give.

    enums lists the values a key may be compared with, others raise; outputs names groups of
    columns, all of which are given where no out argument is. A selector's value of yes, no, on or
    off is a truth value for boolean columns."""
    chosen = [a.split(".", 1)[1] for a in arguments if a.startswith("out.")]
    tests = [a for a in arguments if not a.startswith("out.")]
    for i, a in enumerate(tests):
        key, op, value = a.split(".", 2)
        if enums and key in enums and value not in enums[key]:
            raise ValueError(f"{key} is one of {enums[key]}, not {value!r}")
        if key in df.columns and df.schema[key].dataType.simpleString() == "boolean" and value.lower() in ("yes", "no", "on", "off"):
            tests[i] = f"{key}.{op}.{'true' if value.lower() in ('yes', 'on') else 'false'}"
    unknown = set(chosen) - set(outputs or {})
    if unknown:
        raise ValueError(f"no outputs {sorted(unknown)}")
    columns = list(dict.fromkeys(c for n in chosen or (outputs or {}) for c in (outputs or {})[n]))
    return select_where(df, tests, columns or None)
