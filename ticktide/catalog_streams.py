"""Further queries of the engine: encodings, spectra of series, runs, positions, index spaces, scales; with their DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import HOUR, _rounded, _table, query
from .functions import arrays, timescales
from .operators import bins, select, spectral, vectors
from .plans import indices
from .sources import delimited, packets, v3, v3write

_CSV = """SELECT '"items";"values";' || CAST(l_orderkey AS VARCHAR) || ';' || CAST(l_linenumber AS VARCHAR) || ';' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000;' || format('{:.7e}', l_extendedprice) || ';"' || replace(l_returnflag, '"', '""') || '"' AS value FROM lineitem"""


@query(_CSV)
def csv_sink(spark, d):
    """Delimited export of a packet type."""
    return delimited.rows(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_returnflag"), "items")


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z,' || format('{:.6e}', CAST(user_id AS DOUBLE)) || ',' || CASE WHEN value IS NULL THEN 'NaN' ELSE format('{:.6e}', value) END AS value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10'")
def hapi_rows(spark, d):
    """Comma-separated records of a half-open range, time first."""
    return delimited.hapi_rows(_table(spark, d, "events").select("ts", "user_id", "value"), "ts", "2024-01-03", "2024-01-10")


@query("SELECT format('{:15.6f}', (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) || ' ' || lpad(format('{:e}', value), 15, ' ') AS value FROM events WHERE event_type = 'click'")
def fixed_table(spark, d):
    return delimited.fixed_table(_table(spark, d, "events").where("event_type = 'click'").select("ts", "value"), "ts", relative_to="2024-01-01")


def _through(df: DataFrame, run, schema: str) -> DataFrame:
    def batches(found):
        for b in found:
            yield run(b)

    return df.mapInArrow(batches, schema)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') AS time, CAST(format('{:.6e}', value) AS DOUBLE) AS value FROM events")
def packet_text_roundtrip(spark, d):
    """Events as text records of a version 2 stream, encoded and decoded again."""
    e = _table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("time"), "value")
    packet = packets.Packet([packets.Plane("x", "time", 24, time=True, encoding="time"), packets.Plane("y", "event_id", 21), packets.Plane("y", "value", 14)])
    head = packets.stream_header() + packets.packet_header(1, packet)

    def run(b):
        ids, times, values = (c.to_pylist() for c in b.columns)
        raw = head + b"".join(packets.record(1, packet, list(r)) for r in zip(times, ids, values, strict=True))
        rows = [r for _, r in packets.parse(raw)[2]]
        return pa.RecordBatch.from_arrays([pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["event_id", "time", "value"])

    return _through(e, run, "event_id long, time string, value double")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def packet_binary_roundtrip(spark, d):
    """Scans as big-endian and little-endian reals of version 2 records."""
    e = _table(spark, d, "embeddings").select("vec_id", "embedding")

    def run(b):
        ids, scans = (c.to_pylist() for c in b.columns)
        out = []
        for i, scan in zip(ids, scans, strict=True):
            half = len(scan) // 2
            packet = packets.Packet([packets.Plane("x", "id", 8, encoding="be"), packets.Plane("yscan", "a", 4, half, encoding="be"), packets.Plane("yscan", "b", 4, len(scan) - half, encoding="le")])
            raw = packets.stream_header() + packets.packet_header(1, packet) + packets.record(1, packet, [float(i), scan[:half], scan[half:]])
            ((_, r),) = packets.parse(raw)[2]
            out.append((int(r[0]), sum(r[1]) + sum(r[2]), len(r[1]) + len(r[2])))
        ids, totals, sizes = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.float64()), pa.array(sizes, pa.int32())], ["vec_id", "total", "n"])

    return _through(e, run, "vec_id long, total double, n int").select("vec_id", _rounded("total").alias("total"), "n")


def _ragged(encoding: str) -> v3.Dataset:
    text = encoding == "text"
    runs = v3.Variable("value", "center", "data", "real", "float", "V", ("*", "*", "*"), field=v3.Field(None, 14, "utf8", "-1e31", b"", (b"!", b"$")) if text else v3.Field(None, 8, "LEreal", "-1e31"))
    names = v3.Variable("kind", "center", "data", "string", "", "", ("*", "*"), field=v3.Field(None, None, "utf8", "", b";", (b"!",)))
    user = v3.Variable("user", "center", "coord", "integer", "long", "", ("*",), field=v3.Field(1, 12, "utf8") if text else v3.Field(1, 8, "BEint"))
    return v3.Dataset(1, "events", ("*", "*", "*"), "events", {}, [user, runs, names])


def _roundtrip(spark, d, encoding: str) -> DataFrame:
    e = _table(spark, d, "events").where(F.col("value").isNotNull()).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    e = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "x"))).alias("g")).select("user_id", F.transform("g", lambda g: F.transform(g["x"], lambda s: s["value"])).alias("runs"), F.transform("g", lambda g: g["event_type"]).alias("names"))
    dataset = _ragged(encoding)

    def run(b):
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        raw = v3write.stream_header() + v3write.dataset_header(dataset) + b"".join(v3write.record(dataset, list(r)) for r in rows)
        out = [(u, k, sum(r), len(r)) for _, (u, runs, names) in v3.parse(raw)[1] for k, r in zip(names, runs, strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["user_id", "event_type", "total", "n"])

    return _through(e, run, "user_id long, event_type string, total double, n long").select("user_id", "event_type", _rounded("total", 4).alias("total"), "n")


_RAGGED = "SELECT user_id, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


@query(_RAGGED)
def ragged_text_roundtrip(spark, d):
    """Two ragged levels ended by terminators, and a list of texts, in version 3 records."""
    return _roundtrip(spark, d, "text")


@query(_RAGGED)
def ragged_binary_roundtrip(spark, d):
    """The same with counted runs of little-endian reals."""
    return _roundtrip(spark, d, "binary")


_N, _HOP, _TAU = 16, 8, 0.5
_WINDOWS = f"""SELECT vec_id, w AS win, (CASE WHEN {{bad}} THEN NULL ELSE embedding END)[w*{_HOP}+1 : w*{_HOP}+{_N}] AS a FROM (SELECT vec_id, {{embedding}} AS embedding FROM embeddings), range(0, 7) AS r(w)"""
_SPECTRUM = f"""x AS (SELECT vec_id, win, j, (CAST(a[j+1] AS DOUBLE) - list_avg(list_transform(a, lambda v: CAST(v AS DOUBLE)))) * 0.5 * (1 - cos(2*pi()*j/{_N - 1})) AS v FROM s, range(0, {_N}) AS t(j) WHERE list_count(a) = {_N}),
f AS (SELECT vec_id, win, k, sum(v*cos(2*pi()*j*k/{_N})) AS re, sum(v*sin(2*pi()*j*k/{_N})) AS im FROM x, range(0, {_N // 2 + 1}) AS r(k) GROUP BY 1, 2, 3),
c AS (SELECT {_N} * sum(pow(0.5*(1-cos(2*pi()*j/{_N - 1})), 2)) AS wss FROM range(0, {_N}) AS t(j)),
p AS (SELECT vec_id, win, k, (re*re+im*im) * CASE WHEN k=0 OR k={_N // 2} THEN 1 ELSE 2 END / wss * {_N * _TAU} AS p FROM f, c)"""


@query(f"WITH s AS ({_WINDOWS.format(bad='false', embedding='embedding')}), {_SPECTRUM} SELECT vec_id, CAST(win AS INTEGER) AS win, round((win * {_HOP} + {_N} - 1) * {_TAU} - {_N} / 2 * {_TAU}, 6)::DOUBLE AS t, CAST(k AS INTEGER) AS k, round(p, 8) AS p FROM p")
def psd_of_series(spark, d):
    """Spectra of series of single values: windows over rows, densities a hertz, times of the windows' centres."""
    e = _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", (F.col("i") * _TAU).alias("t"), F.col("v").cast("double").alias("v"))
    p = spectral.series_psd(e, ["vec_id"], "t", "v", _TAU, _N, _N // _HOP)
    return p.select("vec_id", "win", _rounded("t").alias("t"), F.posexplode("psd").alias("k", "p")).withColumn("p", _rounded("p", 8))


_SPOILT = "CASE WHEN vec_id % 7 = 0 THEN list_concat(list_concat(embedding[1:20], [CAST(NULL AS FLOAT)]), embedding[22:]) WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda v: CAST(0 AS FLOAT)) ELSE embedding END"


@query(f"WITH s AS ({_WINDOWS.format(bad='false', embedding=_SPOILT)}), {_SPECTRUM}, q AS (SELECT vec_id, win, list(round(p, 8) ORDER BY k) AS p, max(p) AS top FROM p GROUP BY 1, 2) SELECT vec_id, CAST(win * {_HOP} AS INTEGER) AS pos, round(win * {_HOP} * {_TAU} + {_N} / 2 * {_TAU}, 6)::DOUBLE AS t, q.top IS NULL AS is_fill, round(coalesce(q.p[3], -1), 8) AS p2 FROM s LEFT JOIN q USING (vec_id, win) WHERE q.top IS NULL OR q.top > 0")
def psd_of_scans(spark, d):
    """Spectra within scans: a window with fill is fill, one without any power is left out."""
    a = F.col("embedding").cast("array<double>")
    spoilt = F.when(F.col("vec_id") % 7 == 0, F.transform(a, lambda v, i: F.when(i != 20, v))).when(F.col("vec_id") % 11 == 0, F.transform(a, lambda v: F.lit(0.0))).otherwise(a)
    e = _table(spark, d, "embeddings").select("vec_id", spoilt.alias("wave"), F.lit(0.0).alias("t"))
    p = spectral.scan_psd(e, "wave", "t", _TAU, _N, _N // _HOP)
    return p.select("vec_id", "pos", _rounded("t").alias("t"), F.col("psd").isNull().alias("is_fill"), F.coalesce(_rounded(F.get("psd", F.lit(2)), 8), F.lit(-1.0)).alias("p2"))


@query("SELECT vec_id, CAST(8 AS INTEGER) AS n, round(CAST(embedding[11] AS DOUBLE), 6) AS first FROM embeddings")
def frequency_trim(spark, d):
    """Items of an axis in [1, 1.8)."""
    t, axis = spectral.trim(_table(spark, d, "embeddings"), "embedding", 1.0, 1.8, [0.1 * i for i in range(64)])
    return t.select("vec_id", F.size("embedding").alias("n"), _rounded(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


@query("WITH b AS (SELECT event_type, event_id, value, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS BIGINT) AS bin FROM events), c AS (SELECT *, CASE WHEN bin IS DISTINCT FROM lag(bin) OVER (PARTITION BY event_type ORDER BY event_id % 5000, event_id) THEN 1 ELSE 0 END AS n FROM b), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY event_id % 5000, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT event_type, CAST(run AS BIGINT) AS run, bin, round(avg(value), 6) AS mean, count(value) AS n FROM r GROUP BY 1, 2, 3")
def bin_runs(spark, d):
    """One row each time the bin changes, in a stream that goes back once."""
    e = _table(spark, d, "events").withColumn("turn", F.col("event_id") % 5000)
    return bins.runs(e, ["turn", "event_id"], ["event_type"], timescales.micros(F.col("ts")), int(HOUR * 1_000_000), "value").withColumn("mean", _rounded("mean"))


@query("SELECT count(*) AS packets, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round(date_diff('microseconds', min(ts), max(ts)) / 1e6, 6) AS seconds, round(sum(strlen(props)) / 1024 / (date_diff('microseconds', min(ts), max(ts)) / 1e6), 9) AS kb_per_s FROM events")
def stream_totals(spark, d):
    t = bins.totals(_table(spark, d, "events"), F.octet_length("props"), "ts")
    return t.select("packets", "bytes", _rounded("seconds").alias("seconds"), _rounded("kb_per_s", 9).alias("kb_per_s"))


@query("WITH p AS (SELECT epoch_us(ts) / 1e6 AS tm, value AS x, 2 * value AS y, value - 1 AS z FROM events WHERE event_type = 'purchase' AND value IS NOT NULL), e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), j AS (SELECT e.event_id, e.t, (SELECT max(tm) FROM p WHERE tm <= e.t) AS a, (SELECT min(tm) FROM p WHERE tm >= e.t) AS b FROM e) SELECT event_id, CASE WHEN b > a THEN round(p.x + (t - a) / (b - a) * (q.x - p.x), 5) WHEN a = b THEN round(p.x, 5) END AS x, CASE WHEN b > a THEN round(p.y + (t - a) / (b - a) * (q.y - p.y), 5) WHEN a = b THEN round(p.y, 5) END AS y FROM j LEFT JOIN p ON p.tm = a LEFT JOIN p q ON q.tm = b")
def position_interpolated(spark, d):
    """Positions between the rows of an ephemeris table, null beyond its ends."""
    e = _table(spark, d, "events")
    at = timescales.micros(F.col("ts")) / 1e6
    p = e.where("event_type = 'purchase' AND value IS NOT NULL").select(F.lit("moon").alias("body"), F.lit("J2000").alias("frame"), at.alias("at"), F.col("value").alias("x"), (2 * F.col("value")).alias("y"), (F.col("value") - 1).alias("z"))
    c = vectors.locate(e.where("event_type = 'click'").select("event_id", at.alias("t")), p, "t", "moon", "J2000", "where")
    return c.select("event_id", _rounded("where.x", 5).alias("x"), _rounded("where.y", 5).alias("y"))


@query("WITH v AS (SELECT event_id, epoch_us(ts) / 3600e6 AS t, value AS r, CAST(user_id % 360 AS DOUBLE) AS lon, value / 2 AS z FROM events WHERE value IS NOT NULL), h AS (SELECT (SELECT min(t) FROM v) AS t0), m AS (SELECT t0 + 1 + i * 6 AS tm, radians(i * 7.0) AS a FROM h, range(0, 200) AS r(i)), j AS (SELECT v.*, (SELECT arg_max(a, tm) FROM m WHERE tm <= v.t) AS a FROM v) SELECT event_id, round(cos(a) * r * cos(radians(lon)) - sin(a) * r * sin(radians(lon)), 6) AS x, round(sin(a) * r * cos(radians(lon)) + cos(a) * r * sin(radians(lon)), 6) AS y, CASE WHEN a IS NULL THEN NULL ELSE round(z, 6) END AS z FROM j")
def rotate_by_time(spark, d):
    """Cylindrical vectors turned by the matrix in force at their time; none before the first matrix."""
    e = _table(spark, d, "events").where(F.col("value").isNotNull())
    t = timescales.micros(F.col("ts")) / 3600e6
    v = e.select("event_id", t.alias("t"), vectors.vector([F.col("value"), (F.col("user_id") % 360), F.col("value") / 2], "cylindrical", frame="body"))
    t0 = v.agg(F.min("t")).first()[0] or 0.0
    a = F.radians(F.col("id") * 7.0)
    m = spark.range(200).select(F.lit("body").alias("from_frame"), F.lit("sky").alias("to_frame"), (F.lit(t0) + 1 + F.col("id") * 6).alias("at"), *[c.alias(f"m{i}") for i, c in enumerate((F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))])
    r = vectors.rotate(v, "vector", m, "t", "turned", "sky")
    return r.select("event_id", *[_rounded(f"turned.{c}").alias(c) for c in "xyz"])


_GRID = "list_transform(range(0, 8), lambda i: list_transform(embedding[i*8+1 : i*8+8], lambda v: CAST(v AS DOUBLE)))"


def _grid(spark, d):
    a = F.col("embedding").cast("array<double>")
    return _table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(a, i * 8 + 1, 8)).alias("g"))


@query(f"WITH g AS (SELECT vec_id, {_GRID} AS g FROM embeddings) SELECT vec_id, round(list_sum(list_transform(g[3:5], lambda r: r[2] + r[3])), 6) AS total, CAST(3 AS INTEGER) AS n, round(g[2][8], 6) AS one FROM g")
def index_box(spark, d):
    """A box of a nested array, and one item of it."""
    b = arrays.box(F.col("g"), [(2, 5), (1, 3)])
    flat = F.aggregate(F.flatten(b), F.lit(0.0), lambda s, x: s + x)
    return _grid(spark, d).select("vec_id", _rounded(flat).alias("total"), F.size(b).alias("n"), _rounded(arrays.box(F.col("g"), [(1, 2), (7, 8)])).alias("one"))


@query("WITH e AS (SELECT user_id, list(value ORDER BY event_id) AS a FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, CAST(len(a) AS INTEGER) AS n, CAST(len(a) + 2 AS INTEGER) AS appended, CAST(ceil(len(a) / 4.0) AS INTEGER) AS runs, round(list_sum(a[5:8]), 4) AS second FROM e WHERE len(a) > 8")
def array_runs(spark, d):
    """Arrays appended to, and cut into runs of four."""
    e = _table(spark, d, "events").where(F.col("value").isNotNull()).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("a")).where(F.size("a") > 8)
    ends = F.transform(F.sequence(F.lit(1), F.floor(F.size("a") / 4).cast("int")), lambda i: i * 4)
    r = arrays.runs(F.col("a"), ends)
    return e.select("user_id", F.size("a").alias("n"), F.size(arrays.append(F.col("a"), 1.0, 2.0)).alias("appended"), F.size(r).alias("runs"), _rounded(arrays.total(F.get(r, F.lit(1))), 4).alias("second"))


@query("WITH e AS (SELECT vec_id, embedding[1:4] AS f, [embedding[1:2], embedding[3:3]] AS r FROM embeddings) SELECT vec_id, CAST(2 AS INTEGER) AS rows_, CAST(2 AS INTEGER) AS cols_, CAST(3 AS INTEGER) AS items, CAST(r[2][1] AS DOUBLE) AS kept, CAST(-1 AS DOUBLE) AS filled, true AS has_01, false AS has_11 FROM e")
def array_cube(spark, d):
    """A ragged array's shape, items and valid indices, and the array filled to a cube."""
    a = F.col("embedding").cast("array<double>")
    e = _table(spark, d, "embeddings").select("vec_id", F.array(F.slice(a, 1, 2), F.slice(a, 3, 1)).alias("r"))
    s, c = arrays.shape(F.col("r"), 2), arrays.cube(F.col("r"), 2, 2, -1.0)
    return e.select("vec_id", F.get(s, F.lit(0)).alias("rows_"), F.get(s, F.lit(1)).alias("cols_"), arrays.count_items(F.col("r"), 2).alias("items"), F.get(F.get(c, F.lit(1)), F.lit(0)).alias("kept"), F.get(F.get(c, F.lit(1)), F.lit(1)).alias("filled"), arrays.has(F.col("r"), 0, 1).alias("has_01"), arrays.has(F.col("r"), 1, 1).alias("has_11"))


@query(f"WITH g AS (SELECT vec_id, {_GRID} AS g FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS i1, CAST(j AS INTEGER) AS i2, round(g[i+1][j+1], 6) AS v, 0.5 * j::DOUBLE AS axis FROM g, range(0, 8) AS a(i), range(0, 8) AS b(j)")
def long_form(spark, d):
    """A nested array and an axis that runs over its inner index alone, one row an index."""
    e = _grid(spark, d).withColumn("axis", arrays.linear(0.0, 0.5, 8))
    out = indices.long_form(e, {"g": ("*", "8", "8"), "axis": ("*", "-", "8")}, 3)
    return out.select("vec_id", F.col("i1").cast("int").alias("i1"), F.col("i2").cast("int").alias("i2"), _rounded("g").alias("v"), "axis")


@query("SELECT o_orderkey, CAST(floor(epoch_us(o_orderdate) / 86400000000.0) + 4383 AS BIGINT) AS days, CAST((epoch_us(o_orderdate) // 1000) % 86400000 AS BIGINT) AS millis, o_orderdate AS back FROM orders")
def days_1958(spark, d):
    """Days since 1958 and milliseconds of the day, and back."""
    ts = F.col("o_orderdate")
    days, ms = timescales.days1958(ts), timescales.millis_of_day(ts)
    return _table(spark, d, "orders").select("o_orderkey", days.alias("days"), ms.alias("millis"), timescales.from_1958(days, ms).cast("timestamp_ntz").alias("back"))


@query("WITH t AS (SELECT event_id, ((epoch_us(ts) - 946684800000000 - 43135816000) * 1000 + 5000000000) / 1e9 AS s FROM events) SELECT event_id, CAST(round((s + 1.657e-3 * sin(6.239996 + 1.99096871e-7 * s + 1.671e-2 * sin(6.239996 + 1.99096871e-7 * s)) - s) * 1e6) AS INTEGER) AS swing_us, 0 AS off_us FROM t")
def ephemeris_time(spark, d):
    """Ephemeris seconds of terrestrial time, and back to within a microsecond."""
    tt = timescales.tt2000(F.col("ts"))
    et = timescales.et2000(tt)
    back = timescales.tt_from_et2000(et)
    return _table(spark, d, "events").select("event_id", F.round((et - tt / 1e9) * 1e6).cast("int").alias("swing_us"), F.round((back - tt) / 1000).cast("int").alias("off_us"))


@query("SELECT user_id, event_id, ts FROM events WHERE event_type IN ('click', 'view')")
def merged_streams(spark, d):
    """Two packet types in one stream by time."""
    e = _table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return indices.merge_streams([e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view")], "ts")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-04 23:59:00' AND ts < TIMESTAMP '2024-01-06 00:01:00'")
def padded_range(spark, d):
    """A day's records with a minute before and after it, as a reader of tiers pads its range."""
    from datetime import datetime

    from .plans import tier_reader

    *_, low, high = tier_reader.request({"cacheLevel_00": "intrinsic | daily | p"}, "p", datetime(2024, 1, 5), datetime(2024, 1, 6), 0.0, 60.0)
    return select.time_range(_table(spark, d, "events"), "ts", low, high).select("event_id", "value")




@query("WITH p AS (SELECT user_id, ts AS since, value AS price FROM events WHERE event_type = 'purchase') SELECT event_id, (SELECT arg_max(price, since) FROM p WHERE p.user_id = e.user_id AND p.since <= e.ts) AS price FROM events e")
def as_of_value(spark, d):
    """The price in force at each event, looked up by days with what each begins with carried over."""
    e = _table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("price"))
    return vectors.as_of(e.select("event_id", "user_id", "ts"), p, "ts", "since", ["user_id"], ["price"], 86400.0).select("event_id", "price")


@query("SELECT vec_id, list_transform(list_concat(list_concat(embedding[1:2], [-1.0]), embedding[4:]), lambda x: round(CAST(x AS DOUBLE), 6))[3] AS put, -9.0::DOUBLE AS filled, CAST(64 AS INTEGER) AS before_, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def array_put_values(spark, d):
    """What put and pad leave at the places they change and beside them."""
    p = arrays.pad(arrays.put(F.col("embedding").cast("array<double>"), 2, -1.0), 66, -9.0)
    return _table(spark, d, "embeddings").select("vec_id", F.get(p, F.lit(2)).alias("put"), F.get(p, F.lit(65)).alias("filled"), (F.array_position(p, -9.0) - 1).cast("int").alias("before_"), _rounded(F.get(p, F.lit(63))).alias("last"))
