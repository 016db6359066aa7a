"""The engine's own queries by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, expressions, text, timescales, units
from .operators import bins, histogram, select, spectral, vectors
from .plans import tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3600.0


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(c, digits: int = 6):
    return F.round(c, digits)


_BINNED = "WITH e AS (SELECT event_type, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS off, value FROM events) SELECT event_type, CAST(off // 3600000000 AS BIGINT) AS bin, {} FROM e GROUP BY 1, 2"


def _hourly(spark, d, how):
    return bins.reduce_seconds(_table(spark, d, "events").select("event_type", "ts", "value"), "ts", HOUR, ["value"], how, ["event_type"])


@query(_BINNED.format("round(avg(value), 6) AS v_avg, CAST((SELECT min(epoch_us(ts)) FROM events) + 3600000000 * (CAST(off // 3600000000 AS BIGINT) + 0.5) AS BIGINT) AS mid_us"))
def bin_avg_hour(spark, d):
    return _hourly(spark, d, ["mean"]).select("event_type", "bin", _rounded("value_mean").alias("v_avg"), F.col("x").cast("long").alias("mid_us"))


@query(_BINNED.format("min(value) AS v_min, max(value) AS v_max, count(*) AS n"))
def bin_range_hour(spark, d):
    return _hourly(spark, d, ["min", "max", "count"]).select("event_type", "bin", F.col("value_min").alias("v_min"), F.col("value_max").alias("v_max"), F.col("value_count").alias("n"))


@query(_BINNED.format("round(coalesce(stddev_samp(value), 0), 6) AS v_sd"))
def bin_stddev_hour(spark, d):
    return _hourly(spark, d, ["stddev"]).select("event_type", "bin", _rounded("value_stddev").alias("v_sd"))


@query(_BINNED.format("round(avg(value), 6) AS v_avg, greatest(max(value), 0) AS v_peak"))
def bin_peak_hour(spark, d):
    return _hourly(spark, d, ["mean", "peak"]).select("event_type", "bin", _rounded("value_mean").alias("v_avg"), F.col("value_peak").alias("v_peak"))


@query("WITH x AS (SELECT label, vec_id // 50 AS bin, unnest(range(64)) AS j, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(bin AS BIGINT) AS bin, CAST(j AS INTEGER) AS j, round(avg(CAST(v AS DOUBLE)), 6) AS v_avg, max(v) AS v_max FROM x GROUP BY 1, 2, 3")
def bin_scans(spark, d):
    """Item-by-item reductions of fixed-length scans, without exploding them before the shuffle."""
    e = _table(spark, d, "embeddings")
    r = bins.reduce_bins(e, F.col("vec_id"), 50, ["embedding"], ["mean", "max"], ["label"], first=0, items={"embedding": 64})
    z = r.select("label", "bin", F.posexplode(F.arrays_zip(F.col("embedding_mean").alias("m"), F.col("embedding_max").alias("x"))).alias("j", "v"))
    return z.select("label", "bin", "j", _rounded("v.m").alias("v_avg"), F.col("v.x").alias("v_max"))


@query("WITH x AS (SELECT label, vec_id // 50 AS bin, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(bin AS BIGINT) AS bin, round(avg(CAST(v AS DOUBLE)), 6) AS v_avg FROM x GROUP BY 1, 2")
def bin_waveform_collapse(spark, d):
    e = bins.collapse(_table(spark, d, "embeddings"), "embedding", "v")
    return bins.reduce_bins(e, F.col("vec_id"), 50, ["v"], ["mean"], ["label"], first=0).select("label", "bin", _rounded("v_mean").alias("v_avg"))


_RATE = "WITH n AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 600000000 AS bin, count(*) AS k, sum(strlen(props)) AS b FROM events GROUP BY 1)"
_DENSE = " SELECT CAST(g.bin AS BIGINT) AS bin, {} AS rate FROM (SELECT unnest(range((SELECT max(bin) + 1 FROM n))) AS bin) g LEFT JOIN n ON g.bin = n.bin"


def _rate(spark, d, **options):
    e = _table(spark, d, "events")
    return bins.rates(e, timescales.micros(F.col("ts")), 600_000_000, **options)


@query(_RATE + _DENSE.format("CAST(coalesce(n.k, 0) AS BIGINT)"))
def bin_rate_dense(spark, d):
    return _rate(spark, d)


@query(_RATE + " SELECT CAST(bin AS BIGINT) AS bin, k AS rate FROM n")
def bin_rate_monotonic(spark, d):
    return _rate(spark, d, dense=False)


@query(_RATE + _DENSE.format("1.0::DOUBLE"))
def bin_coverage_events(spark, d):
    return _rate(spark, d, events=True)


@query(_RATE + _DENSE.format("round(coalesce(n.b, 0) / 1024.0, 9)::DOUBLE"))
def bin_volume_kb(spark, d):
    r = _rate(spark, d, size=F.octet_length("props"))
    return r.select("bin", _rounded(F.col("rate") / 1024.0, 9).alias("rate"))


@query("SELECT event_type, CAST(trunc((epoch_us(ts) - 1704067200000000) / 1e6 / 7200) AS BIGINT) AS bin, round(coalesce(avg(value), 0), 6) AS v_avg FROM events WHERE trunc((epoch_us(ts) - 1704067200000000) / 1e6 / 7200) >= 0 GROUP BY 1, 2")
def bin_from_zero(spark, d):
    x = (timescales.micros(F.col("ts")) - 1_704_067_200_000_000) / 1e6
    return bins.from_zero(_table(spark, d, "events"), x, 7200, ["value"], ["event_type"]).select("event_type", "bin", _rounded("value_mean").alias("v_avg"))


_ITEMS = "WITH n AS (SELECT item, value, count(*) AS n FROM (SELECT 0 AS item, l_discount AS value FROM lineitem UNION ALL SELECT 1, l_tax FROM lineitem) WHERE value IS NOT NULL GROUP BY 1, 2), g AS (SELECT i.item, x.value, coalesce(n.n, 0) AS k FROM (SELECT DISTINCT item FROM n) i CROSS JOIN (SELECT DISTINCT value FROM n) x LEFT JOIN n ON n.item = i.item AND n.value = x.value)"


def _items(spark, d):
    return histogram.array_counts(_table(spark, d, "lineitem").select(F.array("l_discount", "l_tax").alias("scan")), "scan")


@query(_ITEMS + " SELECT value, sum(k) FILTER (item = 0)::BIGINT AS n_discount, sum(k) FILTER (item = 1)::BIGINT AS n_tax FROM g GROUP BY value")
def histogram_values(spark, d):
    return histogram.wide(_items(spark, d), [0, 1]).select("value", F.col("0").alias("n_discount"), F.col("1").alias("n_tax"))


_CUM = _ITEMS + " SELECT item, value, round(sum(k) OVER (PARTITION BY item ORDER BY value {} ROWS UNBOUNDED PRECEDING) * 1.0 / sum(k) OVER (PARTITION BY item), 9)::DOUBLE AS fraction FROM g"


@query(_CUM.format(""))
def histogram_cdf(spark, d):
    return histogram.cumulative(_items(spark, d)).select("item", "value", _rounded("fraction", 9).alias("fraction"))


@query(_CUM.format("DESC"))
def histogram_rcdf(spark, d):
    return histogram.cumulative(_items(spark, d), above=True).select("item", "value", _rounded("fraction", 9).alias("fraction"))


@query("SELECT event_id, round(value * 60, 6) AS minutes_s, round(value / 86400, 9) AS s_day, round(value * 1e-3, 9) AS milli FROM events")
def mean_unit_convert(spark, d):
    c = lambda a, b: units.convert(F.col("value"), a, b)
    return _table(spark, d, "events").select("event_id", _rounded(c("minute", "s")).alias("minutes_s"), _rounded(c("s", "day"), 9).alias("s_day"), _rounded(c("mV", "V"), 9).alias("milli"))


@query("SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def time_diff(spark, d):
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", timescales.difference(F.col("l_shipdate"), F.col("o_orderdate")).alias("seconds"))


@query("SELECT vec_id, CAST(j AS INTEGER) AS j, CAST(vec_id * 1000000 + 125000 * j AS BIGINT) AS center FROM (SELECT vec_id, unnest(range(64)) AS j FROM embeddings)")
def time_offsets(spark, d):
    """Centre coordinate of each sample: reference plus offset, exploded to the long form."""
    e = _table(spark, d, "embeddings").select("vec_id")
    off = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: j.cast("long") * 125_000)
    return e.select("vec_id", F.posexplode(arrays.plus_reference(off, F.col("vec_id") * 1_000_000)).alias("j", "center"))


@query("SELECT vec_id, CAST(j AS INTEGER) AS j, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding) AS v FROM embeddings)")
def ref_plus_offset(spark, d):
    """Long form of a dataset: every index of every record."""
    return _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v")).select("vec_id", "j", F.col("v").cast("double").alias("v"))


@query("SELECT event_id, epoch_us(ts) - 946684800000000 AS us2000, round((epoch_us(ts) - 946684800000000) / 86400000000 + 15340, 6) AS mj1958, epoch_us(ts) * 1000 AS ns1970, round((epoch_us(ts) - 946684800000000) / 1e6, 6) AS t2000 FROM events")
def time_scales(spark, d):
    ts = F.col("ts")
    return _table(spark, d, "events").select("event_id", timescales.us2000(ts).alias("us2000"), _rounded(timescales.mj1958(ts)).alias("mj1958"), timescales.ns1970(ts).alias("ns1970"), _rounded(units.convert(timescales.us2000(ts), "us2000", "t2000")).alias("t2000"))


_LEAPS = "WITH l AS (SELECT * FROM (VALUES " + ", ".join(f"(TIMESTAMP '{day}', {n})" for day, n in timescales.LEAPS) + ") AS l(since, n))"


@query(_LEAPS + " SELECT o_orderkey, CAST((epoch_us(o_orderdate) - 946684800000000 - 43135816000) * 1000 + ((SELECT max(n) FROM l WHERE since <= o_orderdate) - 32)::BIGINT * 1000000000 AS BIGINT) AS tt2000, epoch_us(o_orderdate) AS back_us FROM orders")
def tt2000_leap(spark, d):
    tt = timescales.tt2000(F.col("o_orderdate"))
    return _table(spark, d, "orders").select("o_orderkey", tt.alias("tt2000"), F.unix_micros(timescales.from_tt2000(tt)).alias("back_us"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%jT%H:%M:%S') AS ordinal, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS calendar, epoch_us(o_orderdate) AS parsed_us FROM orders")
def ordinal_format(spark, d):
    o = timescales.ordinal(F.col("o_orderdate"))
    return _table(spark, d, "orders").select("o_orderkey", o.alias("ordinal"), timescales.calendar(F.col("o_orderdate")).alias("calendar"), F.unix_micros(timescales.parse_time(o)).alias("parsed_us"))


@query("SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - 946684800000000) / 86400000000.0) AS BIGINT) + 2451545 AS jd, CAST((epoch_us(o_orderdate) // 1000000) % 86400 AS DOUBLE) AS second FROM orders")
def julian_day(spark, d):
    o = F.col("o_orderdate")
    return _table(spark, d, "orders").select("o_orderkey", timescales.julian_day(o).alias("jd"), F.floor(timescales.seconds_of_day(o)).cast("double").alias("second"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(1.3 + 0.05 * i, 9)::DOUBLE AS v FROM (SELECT vec_id, unnest(range(1 + vec_id % 5)) AS i FROM embeddings)")
def linear_sequence(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id")
    s = arrays.linear(F.lit(1.3).cast("double"), F.lit(0.05).cast("double"), (1 + F.col("vec_id") % 5).cast("int"))
    return e.select("vec_id", F.posexplode(s).alias("i", "v")).select("vec_id", "i", _rounded("v", 9).alias("v"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[11:20], lambda x: x::DOUBLE)), 6) AS s, embedding[6]::DOUBLE AS item, len(embedding[11:20]) AS n FROM embeddings")
def slice_range(spark, d):
    s = arrays.part(F.col("embedding"), 10, 20)
    return _table(spark, d, "embeddings").select("vec_id", _rounded(arrays.total(F.transform(s, lambda x: x.cast("double")))).alias("s"), arrays.item(F.col("embedding"), 5).cast("double").alias("item"), F.size(s).cast("long").alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s FROM embeddings")
def rank_sum(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", _rounded(arrays.total(F.col("embedding").cast("array<double>"))).alias("s"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / (0.5 * 63), 6) AS a FROM embeddings")
def rank_avg(spark, d):
    axis = arrays.linear(F.lit(2.0), F.lit(0.5), 64)
    return _table(spark, d, "embeddings").select("vec_id", _rounded(arrays.mean_over(F.col("embedding").cast("array<double>"), axis)).alias("a"))


@query("SELECT vec_id, embedding[5]::DOUBLE AS v FROM embeddings")
def rank_slice(spark, d):
    axis = arrays.linear(F.lit(2.0), F.lit(0.5), 64)
    return _table(spark, d, "embeddings").select("vec_id", arrays.nearest(F.col("embedding"), axis, 4.1).cast("double").alias("v"))


_PSD = """WITH s AS (SELECT vec_id, embedding AS a, len(embedding) AS n, list_avg(embedding) AS m FROM embeddings),
x AS (SELECT vec_id, n, i AS j, (CAST(a[i+1] AS DOUBLE) - m) * 0.5 * (1 - cos(2*pi()*i/(n-1))) AS v, CAST(a[i+1] AS DOUBLE) AS raw FROM s, unnest(range(n)) AS t(i)),
w AS (SELECT n, n*sum(pow(0.5*(1-cos(2*pi()*i/(n-1))),2)) AS wss FROM (SELECT DISTINCT n FROM s), unnest(range(n)) AS t(i) GROUP BY n),
f AS (SELECT vec_id, n, k, sum(v*cos(2*pi()*j*k/n)) AS re, sum(v*sin(2*pi()*j*k/n)) AS im, sum(raw*cos(2*pi()*j*k/n)) AS r0, sum(raw*sin(2*pi()*j*k/n)) AS i0 FROM x, range(0,33) AS r(k) GROUP BY 1,2,3),
p AS (SELECT vec_id, CAST(k AS INTEGER) AS k, (re*re+im*im)*CASE WHEN k=0 OR k=n//2 THEN 1 ELSE 2 END/wss AS p, sqrt(r0*r0+i0*i0)*CASE WHEN k=0 OR k=n//2 THEN 1 ELSE 2 END/n AS m FROM f JOIN w USING (n))
"""


@query(_PSD + "SELECT vec_id, k, round(p, 9) AS p FROM p")
def psd_vectors(spark, d):
    p = spectral.psd(_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return p.select("vec_id", F.posexplode("psd").alias("k", "p")).select("vec_id", "k", _rounded("p", 9).alias("p"))


@query(_PSD + ", q AS (SELECT vec_id, list_avg(list_transform(embedding, lambda x: pow(x::DOUBLE - list_avg(embedding), 2))) AS ms FROM embeddings) SELECT vec_id, round(sum(p) / any_value(ms), 6) AS ratio FROM p JOIN q USING (vec_id) GROUP BY vec_id")
def psd_power_ratio(spark, d):
    p = spectral.psd(_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    mean = arrays.total(F.col("embedding")) / F.size("embedding")
    p = p.withColumn("m", mean)
    ms = arrays.total(F.transform("embedding", lambda x: (x - F.col("m")) * (x - F.col("m")))) / F.size("embedding")
    return p.select("vec_id", _rounded(arrays.total(F.col("psd")) / ms).alias("ratio"))


@query(_PSD + "SELECT vec_id, k, round(m, 9) AS m FROM p")
def dft_magnitude(spark, d):
    p = spectral.magnitude(_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return p.select("vec_id", F.posexplode("magnitude").alias("k", "m")).select("vec_id", "k", _rounded("m", 9).alias("m"))


@query("""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t, lag(epoch_us(ts),1) OVER w AS t1, lag(epoch_us(ts),2) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, CASE WHEN t0 IS NOT NULL AND t>t0 AND 2.0*abs(t-2*t1+t0)/(t-t0) > 0.5 THEN 1 ELSE 0 END AS brk FROM a),
s AS (SELECT *, coalesce(lead(brk) OVER (PARTITION BY user_id ORDER BY event_id),0) AS st FROM b)
SELECT user_id, event_id, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM s""")
def jitter_sessions(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", "ts")
    return spectral.segments(e, ["user_id"], ["event_id"], timescales.micros(F.col("ts")), 0.5).select("user_id", "event_id", "seg")


@query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(list_avg(list_transform(embedding[pos+1:pos+16], lambda x: x::DOUBLE)), 6) AS m FROM (SELECT vec_id, embedding, unnest(range(0, 49, 8)) AS pos FROM embeddings)")
def sliding_windows(spark, d):
    s = spectral.sliding(_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 16, 2)
    return s.select("vec_id", "pos", _rounded(arrays.total(F.col("window").cast("array<double>")) / 16).alias("m"))


@query("WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), w AS (SELECT user_id, value, n, unnest(range(greatest(0, CAST(ceil((n - 7) / 4.0) AS BIGINT)), n // 4 + 1)) AS win FROM n) SELECT user_id, CAST(win AS INTEGER) AS win, round(avg(value), 6) AS m FROM w GROUP BY 1, 2 HAVING count(*) = 8")
def count_windows(spark, d):
    s = spectral.series_windows(_table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 8, 2)
    return s.select("user_id", "win", _rounded(arrays.total(F.col("values")) / 8).alias("m"))


_XYZ = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _xyz(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"SELECT vec_id, round(sqrt(x*x+y*y), 6) AS rho, round(CASE WHEN degrees(atan2(y,x)) < 0 THEN degrees(atan2(y,x)) + 360 ELSE degrees(atan2(y,x)) END, 6) AS phi, round(sqrt(x*x+y*y+z*z), 6) AS r, round(degrees(acos(z/sqrt(x*x+y*y+z*z))), 6) AS colat, round(degrees(atan2(y,x)), 6) AS lon, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(x, 6) AS back_x FROM {_XYZ}")
def cyl_sph_lat(spark, d):
    v = tuple(map(F.col, "xyz"))
    cyl, sph, lat = vectors.cylindrical(*v), vectors.spherical(*v), vectors.latitudinal(*v)
    out = {"rho": cyl[0], "phi": cyl[1], "r": sph[0], "colat": sph[1], "lon": lat[1], "lat": lat[2], "back_x": vectors.from_latitudinal(*lat)[0]}
    return _xyz(spark, d).select("vec_id", *[_rounded(c).alias(n) for n, c in out.items()])


@query(f"WITH m AS (SELECT label, radians(10.0 * label) AS a FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, round(cos(a)*x - sin(a)*y, 6) AS x2, round(sin(a)*x + cos(a)*y, 6) AS y2, round(z, 6) AS z2 FROM {_XYZ} JOIN m USING (label)")
def rotate_vectors(spark, d):
    """Rotation by an attitude table, here one matrix a label; the join side is chosen by its size."""
    v = _xyz(spark, d)
    a = F.radians(10.0 * F.col("label"))
    m = v.select("label").distinct().select("label", F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"))
    j = v.join(m, "label")
    r = vectors.rotated(tuple(map(F.col, "xyz")), [F.get("m", F.lit(i)) for i in range(9)])
    return j.select("vec_id", *[_rounded(c).alias(n) for n, c in zip(("x2", "y2", "z2"), r, strict=True)])


@query("WITH p AS (SELECT user_id, ts AS since, value AS price FROM events WHERE event_type = 'purchase') SELECT event_id, (SELECT arg_max(price, since) FROM p WHERE p.user_id = e.user_id AND p.since <= e.ts) IS NOT NULL AS known FROM events e")
def as_of_lookup(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("price"))
    return vectors.as_of(e.select("event_id", "user_id", "ts"), p, "ts", "at", ["user_id"], ["price"]).select("event_id", F.col("price").isNotNull().alias("known"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01' AND o_totalprice > 100000 AND o_orderstatus = 'O'")
def param_select(spark, d):
    return select.select_where(_table(spark, d, "orders"), ["o_orderdate.beg.1995-01-01", "o_orderdate.end.1996-01-01", "o_totalprice.gt.100000", "o_orderstatus.eq.O"], ["o_orderkey", "o_totalprice"])


@query("SELECT event_id, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12 12:00:00'")
def time_select(spark, d):
    return select.time_range(_table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12 12:00:00").select("event_id", "value")


@query(r"WITH v AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site, CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS version FROM pages) SELECT site, version, page_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY version DESC, page_id) AS k FROM v) WHERE k = 1")
def latest_version(spark, d):
    v = _table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("site"), F.regexp_extract("url", "/([0-9]+)", 1).alias("v"))
    v = v.withColumn("version", text.version_key(F.col("v"), "int").cast("int"))
    return select.newest(v, ["site"], [F.desc("version"), F.asc("page_id")]).select("site", "version", "page_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def union_packets(spark, d):
    e = _table(spark, d, "events")
    kind = F.col("event_type")
    # A packet kind a frame for the first 100, which bounds the plan; all others, and those of no kind, come in one.
    kinds = [r[0] for r in e.where(kind.isNotNull()).select(kind).distinct().orderBy(kind).limit(100).collect()]
    u = select.union_packets([*(e.where(kind == k) for k in kinds), e.where(kind.isNull() | ~kind.isin(kinds))])
    return u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _rounded(F.sum("value"), 4).alias("total"))


_TIERS = {60.0: "minute", 600.0: "ten", 3600.0: "hour", 86400.0: "day"}


@query("WITH t(bin) AS (VALUES (60.0), (600.0), (3600.0), (86400.0)), r(res) AS (VALUES (60.0), (599.0), (7200.0), (100000.0)) SELECT res::DOUBLE AS res, (SELECT max(bin) FROM t WHERE bin <= res)::DOUBLE AS tier FROM r")
def cache_tier_pick(spark, d):
    rows = [(r, tiers.choose(_TIERS, r)) for r in (60.0, 599.0, 7200.0, 100000.0)]
    values = ", ".join(f"({r}D, {t}D)" for r, t in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(res, tier)")


@query("SELECT c_nationkey, round(avg(CASE WHEN abs((-999.99 - c_acctbal) / -999.99) < 1e-5 THEN NULL ELSE c_acctbal END), 6) AS mean, count(CASE WHEN abs((-999.99 - c_acctbal) / -999.99) < 1e-5 THEN NULL ELSE c_acctbal END) AS n FROM customer GROUP BY 1")
def fill_handling(spark, d):
    c = _table(spark, d, "customer").withColumn("v", expressions.to_null(F.col("c_acctbal"), -999.99))
    return c.groupBy("c_nationkey").agg(_rounded(F.avg("v")).alias("mean"), F.count("v").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_retailprice BETWEEN -32768 AND 32767 THEN CAST(trunc(p_retailprice) AS INTEGER) END AS as_short, CASE WHEN p_size BETWEEN 0 AND 255 THEN CAST(p_size AS INTEGER) END AS as_ubyte, CASE WHEN p_partkey BETWEEN -128 AND 127 THEN CAST(p_partkey AS INTEGER) END AS as_byte FROM part")
def cast_checks(spark, d):
    c = lambda n, to: expressions.checked(F.col(n), to).cast("int").alias(f"as_{to}")
    return _table(spark, d, "part").select("p_partkey", c("p_retailprice", "short"), c("p_size", "ubyte"), c("p_partkey", "byte"))


@query("SELECT doc_id, list_sum(list_transform(string_split(concat_ws(',', doc_id, n_chars, source), ','), lambda x: coalesce(try_cast(x AS DOUBLE), 0)))::DOUBLE AS total FROM documents")
def str_csv_array(spark, d):
    a = arrays.from_csv(F.concat_ws(",", F.col("doc_id"), F.col("n_chars"), F.col("source")))
    return _table(spark, d, "documents").select("doc_id", arrays.total(a).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS product, round(l_quantity + l_tax * 60, 6) AS total, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END, 6) AS quotient FROM lineitem")
def binop_promote(spark, d):
    b = lambda x, op, y, ua="", ub="": _rounded(expressions.binary(F.col(x), op, F.col(y), ua, ub)[0])
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b("l_extendedprice", "*", "l_discount").alias("product"), b("l_quantity", "+", "l_tax", "s", "minute").alias("total"), b("l_quantity", "/", "l_tax").alias("quotient"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS root, round(ln(l_extendedprice), 9) AS log, round(1 / l_quantity, 9) AS inverse, round(cbrt(l_quantity), 9) AS cube FROM lineitem")
def unary_ops(spark, d):
    u = lambda op, c: _rounded(expressions.unary(op, F.col(c)), 9)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", u("sqrt", "l_quantity").alias("root"), u("ln", "l_extendedprice").alias("log"), u("^-1", "l_quantity").alias("inverse"), u("curt", "l_quantity").alias("cube"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(80 AS INTEGER) AS padded, round(embedding[3]::DOUBLE, 6) AS old, -1.0::DOUBLE AS new FROM embeddings")
def array_put_pad(spark, d):
    p = arrays.pad(arrays.put(F.col("embedding").cast("array<double>"), 2, -1.0), 80, -1e31)
    return _table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.size(p).alias("padded"), _rounded(F.get("embedding", F.lit(2)).cast("double")).alias("old"), F.get(p, F.lit(2)).alias("new"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '-a_5_-q_x_-z' WHEN 1 THEN 'a_b' ELSE '_noparam' END AS params FROM customer")
def normal_params(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "-z  -q x -a 5").when(F.col("c_custkey") % 3 == 1, " b a ").otherwise("  ")
    return _table(spark, d, "customer").select("c_custkey", text.normal_params(raw).alias("params"))


from . import catalog_streams  # noqa: E402,F401 registers its queries
