"""Bin reductions over unbounded input: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, seconds: float, value: str, keys: list[str] = (), late: str = "10 minutes") -> DataFrame:
    """keys, bin (window start), mean, min, max, stddev and count of each tumbling window, emitted once.

    Records later than the watermark are dropped; where every late record must count, bin in batch.
    The state is one row per open window and key."""
    t = F.col(time).cast("timestamp")
    w = stream.withColumn(time, t).withWatermark(time, late).groupBy(*keys, F.window(time, f"{int(seconds * 1000)} milliseconds"))
    c = F.col(value)
    return w.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias("stddev"), F.count(c).alias("n")).select(*keys, F.col("window.start").alias("bin"), "mean", "min", "max", "stddev", "n")


def counted(stream: DataFrame, key: str, time: str, value: str, length: int, slide: int = 1, jitter: float = 0.01, late: str = "10 minutes") -> DataFrame:
    """key, first, last, values of every whole window of length samples, length // slide apart, over unbounded input.

    A key's samples are taken in the order of their times within a batch. A change of cadence, by
    three points whose spacings differ by more than the jitter, begins anew at the middle one. The
    state is at most the open window's samples, so a key needs length numbers."""
    import pandas as pd

    hop = length // slide

    def step(keys, batches, state):
        held = list(state.get[0]) if state.exists else []
        seen = list(state.get[1]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v in zip(rows[time].astype("datetime64[us]").astype("int64") / 1e6, rows[value], strict=True):
            if len(seen) >= 2 and t > seen[-2] and 2 * abs(t - 2 * seen[-1] + seen[-2]) / (t - seen[-2]) > jitter:
                seen, held = seen[-1:], held[-1:]
            seen.append(float(t))
            held.append(float(v))
            if len(held) == length:
                out.append((keys[0], seen[0], seen[-1], list(held)))
                seen, held = seen[hop:], held[hop:]
        state.update((held, seen))
        yield pd.DataFrame(out, columns=[key, "first", "last", "values"])

    kind = stream.schema[key].dataType.simpleString()
    s = stream.select(key, F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value)).withWatermark(time, late)
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first double, last double, values array<double>", "held array<double>, seen array<double>", "append", "NoTimeout")


def run_bins(stream: DataFrame, key: str, time: str, seconds: float, value: str, version: str | None = None, late: str = "10 minutes") -> DataFrame:
    """key, bin, mean, n: a bin is given out when a record of another bin, or of another version of its type, comes.

    Bins count from the key's first time. A late record opens its bin again, and so gives it out a
    second time. The open bin itself stays in the state until then."""
    import pandas as pd

    def step(keys, batches, state):
        first, bin_, ver, total, n = state.get if state.exists else (None, None, None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v, k in zip(rows[time].astype("datetime64[us]").astype("int64") / 1e6, rows[value], rows["version_"], strict=True):
            first = float(t) if first is None else first
            b = int((t - first) / seconds)
            if bin_ is not None and (b, k) != (bin_, ver):
                out.append((keys[0], bin_, total / n if n else None, n))
                total, n = 0.0, 0
            bin_, ver = b, int(k)
            if v == v and v is not None:
                total, n = total + float(v), n + 1
        state.update((first, bin_, ver, total, n))
        yield pd.DataFrame(out, columns=[key, "bin", "mean", "n"])

    kind = stream.schema[key].dataType.simpleString()
    s = stream.select(key, F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value), (F.col(version) if version else F.lit(0)).cast("int").alias("version_")).withWatermark(time, late)
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, bin long, mean double, n long", "first double, bin long, version int, total double, n long", "append", "NoTimeout")


def reporter(send, task_size: int | None = None):
    """A query listener that passes task sizes and rows done to send(kind, value), at most once a second."""
    from time import monotonic

    from pyspark.sql.streaming import StreamingQueryListener

    class Report(StreamingQueryListener):
        done, last = 0, 0.0

        def onQueryStarted(self, event):
            if task_size is not None:
                send("taskSize", task_size)

        def onQueryProgress(self, event):
            self.done += event.progress.numInputRows
            if monotonic() - self.last >= 1.0:
                self.last = monotonic()
                send("taskProgress", self.done)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            send("taskProgress", self.done)

    return Report()


def each_batch(stream: DataFrame, handlers: dict[str, object], column: str, checkpoint: str):
    """Starts a query that hands every micro-batch's records of a kind to its handler, a function of a frame and the batch's number.

    A handler runs once a batch for the kinds it names; a restarted query may repeat the last batch."""

    def run(df, n):
        df.persist()
        try:
            for kind, f in handlers.items():
                f(df.where(F.col(column) == kind), n)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def histogram(stream: DataFrame, item: str, value: str) -> DataFrame:
    """item, value, n of all records so far; start it in complete or update mode. Its state is one row a distinct value."""
    return stream.where(F.col(value).isNotNull()).groupBy(F.col(item).alias("item"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rates(stream: DataFrame, time: str, seconds: float, first: int = 0) -> DataFrame:
    """bin and rate, records of each bin so far, counted from first (microseconds since 1970); start it in complete or update mode."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return stream.where(F.col(time).isNotNull()).groupBy(F.floor((us - first) / int(seconds * 1_000_000)).alias("bin")).agg(F.count(F.lit(1)).alias("rate"))
