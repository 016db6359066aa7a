"""Exact histograms of distinct values, and their cumulative fractions on the dense grid of items and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, item: str, value: str) -> DataFrame:
    """item, value, n; nulls are skipped."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(item).alias("item"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def array_counts(df: DataFrame, array: str) -> DataFrame:
    """counts over the items of an array column."""
    return counts(df.select(F.posexplode(array).alias("item", "value")), "item", "value")


def wide(n: DataFrame, items: list) -> DataFrame:
    """One row a value, ascending when ordered, and one count column an item."""
    return n.groupBy("value").pivot("item", items).agg(F.first("n")).na.fill(0)


#: Ranges of values that the running sums are cut into.
RANGES = 64
#: Items (columns of a scan) that one table may have: a header's bound, so that the list is small.
MOST_ITEMS = 10_000


def dense(n: DataFrame) -> DataFrame:
    """Every item with every value: each value's row gets a map of its counts, which the list of items opens.

    Values are grouped by themselves and the items are at most MOST_ITEMS, a bound that is checked,
    so no two tables are crossed."""
    items = sorted(r[0] for r in n.select("item").distinct().limit(MOST_ITEMS + 1).collect())
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    kind = n.schema["item"].dataType
    by_value = n.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("m"))
    listed = F.array(*[F.lit(i).cast(kind) for i in items]) if items else F.array().cast("array<int>")
    return by_value.select(F.explode(listed).alias("item"), "value", "m").select("item", "value", F.coalesce(F.try_element_at("m", F.col("item")), F.lit(0)).alias("n"))


def cumulative(n: DataFrame, above: bool = False) -> DataFrame:
    """item, value, fraction at or below value (or at or above it).

    Running sums are taken within ranges of values, each range a task of its own, and to them is
    added what the item has in the ranges before: a table of items by RANGES rows."""
    d = dense(n)
    cuts = n.select("value").distinct().approxQuantile("value", [i / RANGES for i in range(1, RANGES)], 0.001) if n.schema["value"].dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint") else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(F.col("value") > c, 1).otherwise(0)
    d = d.withColumn("part", part)
    w = Window.partitionBy("item", "part").orderBy(F.desc("value") if above else F.asc("value")).rowsBetween(Window.unboundedPreceding, 0)
    sums = d.groupBy("item", "part").agg(F.sum("n").alias("s"))
    s = Window.partitionBy("item")
    before = s.orderBy(F.desc("part") if above else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("item").alias("item_"), F.col("part").alias("part_"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"), F.sum("s").over(s).alias("total"))
    d = d.withColumn("upto", F.sum("n").over(w)).join(sums, (F.col("item") == F.col("item_")) & (F.col("part") == F.col("part_")))
    return d.select("item", "value", ((F.col("upto") + F.col("before")) / F.col("total")).alias("fraction"))
