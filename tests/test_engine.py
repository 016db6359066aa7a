"""The engine: golden values of units and time scales, queries against their SQL, sources and streaming."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ticktide import catalog
from ticktide.functions import expressions, text, timescales, units
from ticktide.operators import bins, select, spectral, vectors
from ticktide.plans import tiers
from ticktide.sources import delimited, packets
from ticktide.streaming import bins as stream_bins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("a, b, factor", [("microsecond", "s", 1e-6), ("kilodonut/day", "donut hertz", 1000 / 86400), ("μΩ", "Ohm", 1e-6), ("km s**-1", "m/s", 1000), ("minute", "s", 60)])
def test_factors(a, b, factor):
    assert math.isclose(units.affine(a, b)[0], factor, rel_tol=1e-12)


def test_unit_algebra():
    assert units.can_convert("1/microsecond", "Hz") and math.isclose(units.affine("1/microsecond", "Hz")[0], 1e6)
    assert units.reduce("hertz / kiloelectronvolt / centimeters^2 / steradian") == units.reduce("cm**-2 keV**-1 s**-1 sr**-1")
    assert units.multiply("V", "m**-1") == "V m**-1" and units.root("V**2", 2) == "V" and units.divide("m", "m") == ""
    assert units.affine("mj1958", "us2000")[0] * 0.5416666666666666 + units.affine("mj1958", "us2000")[1] == pytest.approx(-1325329200000000.0)
    assert units.can_merge("us2000", "-", "t2000") and not units.can_merge("s", "+", "us2000")
    with pytest.raises(units.UnitError):
        units.multiply("us2000", "m")


def test_time_scales(spark):
    d = spark.createDataFrame([("2000-01-01T01:00:00.000001",), ("1958-01-01T13:00",), ("2000-001T01:00",), ("Jan 5, 2001",), ("rubbish",)], "s string").withColumn("t", timescales.parse_time(F.col("s")))
    r = d.select("t", timescales.us2000(F.col("t")), timescales.mj1958(F.col("t")), timescales.seconds_of_day(F.col("t")), timescales.julian_day(F.col("t"))).collect()
    assert r[0][1] == 3600000001 and r[0][3] == pytest.approx(3600.000001) and r[0][4] == 2451545
    assert r[1][2] == pytest.approx(0.5416666666666666) and r[2][2] == pytest.approx(15340.041666666666)
    assert r[3][0].year == 2001 and r[4][0] is None


def test_promotion_and_casts(spark):
    assert expressions.promote("ubyte", "+", "byte") == expressions.promote("byte", "+", "ubyte") == "float"
    assert expressions.promote("time", "-", "time") == "double" and expressions.promote("text", "+", "int") is None
    d = spark.createDataFrame([(300.0,), (7.9,), (-1e31,)], "v double")
    assert [r[0] for r in d.select(expressions.checked(F.col("v"), "ubyte")).collect()] == [None, 7, None]
    assert [r[0] for r in d.select(expressions.to_null(F.col("v"), -1e31)).collect()] == [300.0, 7.9, None]


def test_bins_cut_towards_zero(spark):
    d = spark.createDataFrame([(x, v) for x, v in ((-9, 1.0), (0, 3.0), (9, None), (10, -2.0), (-11, 4.0))], "x int, v double")
    r = {x["bin"]: x for x in bins.reduce_bins(d, F.col("x"), 10, ["v"], ["mean", "peak", "stddev"], first=0).collect()}
    assert r[0]["v_mean"] == 2.0 and r[-1]["v_mean"] == 4.0 and r[1]["v_peak"] == 0.0 and r[1]["v_stddev"] == 0.0 and r[1]["x"] == 15.0


def test_interval_labels():
    assert [bins.interval_label(s) for s in (1, 60, 600, 90)] == ["1 second", "1 minute", "10 minutes", "1.5 minutes"]


@given(st.lists(st.floats(-1e3, 1e3), min_size=16, max_size=16))
@settings(max_examples=50, deadline=None)
def test_parseval(x):
    a = np.array([x])
    assert spectral.psd_of(a, None, False).sum() == pytest.approx((a**2).mean(), abs=1e-6)


def test_bad_windows():
    for bad in ((7, "hann"), (8, "square")):
        with pytest.raises(ValueError):
            spectral.weights(*bad)


def test_vectors_round_trip(spark):
    d = spark.createDataFrame([(1.0, -2.0, 3.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    v = tuple(map(F.col, "xyz"))
    for there, back in ((vectors.cylindrical, vectors.from_cylindrical), (vectors.spherical, vectors.from_spherical), (vectors.latitudinal, vectors.from_latitudinal)):
        assert np.allclose(d.select(*back(*there(*v))).collect(), [[1, -2, 3], [0, 0, 0]])
    alt, lon, lat = d.limit(1).select(*vectors.geodetic(F.lit(6378.137), F.lit(0.0), F.lit(0.0), 6378.137, 1 / 298.257)).first()
    assert abs(alt) < 1e-9 and lon == lat == 0


def test_tiers_and_config():
    c = tiers.parse_config("a = 'x;y' ; note\ncacheLevel_01 = '3600 s | monthly | p'\ncacheLevel_02 = \"60 s | daily | p\"\n")
    assert c["a"] == "x;y" and list(tiers.levels(c, "p")) == [3600.0, 60.0]
    from datetime import datetime

    assert tiers.plan(c, "p", datetime(2020, 1, 30), datetime(2020, 2, 2), 90) == (60.0, ["2020/01/30", "2020/01/31", "2020/02/01"])
    assert tiers.plan(c, "p", datetime(2020, 1, 30), datetime(2020, 3, 2), 4000)[1] == ["2020/01", "2020/02", "2020/03"]
    with pytest.raises(tiers.NoTier):
        tiers.choose({60.0: 0}, 10)


def test_path_templates(spark):
    t = text.PathTemplate("data/$Y/$m/f_$Y$m$d_v$v.txt")
    d = spark.createDataFrame([("data/2020/01/f_20200103_v1.10.txt",), ("data/2020/01/f_20200103_v1.9.txt",), ("other",)], "p string")
    got = select.newest(d.where(t.matches(F.col("p"))).withColumn("v", text.version_key(t.fields(F.col("p"))["v"])), [], [F.desc("v")]).collect()
    assert [r["p"] for r in got] == ["data/2020/01/f_20200103_v1.10.txt"]


def test_selectors_reject_bad_keys(spark):
    with pytest.raises(ValueError):
        select.predicate(spark.range(1), ["nope.eq.1"])


def packet_stream():
    def packet(tag, body):
        return f"[{tag}]{len(body):06d}{body}".encode()

    head = packet("00", '<stream version="2.2"><properties title="t"/></stream>')
    kind = packet("01", '<packet><x type="time20" units="us2000"/><y type="ascii10" name="b" units="nT"><properties yFill="-1"/></y><yscan type="ascii8" name="s" nitems="2" zUnits="V" yTags="1,2"/></packet>')
    rows = [f":01:{t:<20}{y:>10}{a:>8}{b:>8}".encode() for t, y, a, b in (("2020-01-01T00:00", "1.5", "1", "2"), ("2020-01-01T00:01", "-1", "3", "-1e31"))]
    return head + kind + b"".join(rows)


def test_packet_streams(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(packet_stream())
    df = packets.read(spark, str(tmp_path))[1]
    assert [tuple(r) for r in df.collect()] == [("2020-01-01T00:00", 1.5, [1.0, 2.0]), ("2020-01-01T00:01", None, [3.0, None])]
    assert df.schema["b"].metadata["units"] == "nT" and delimited.info(df, "x")["parameters"][0]["type"] == "isotime"
    assert packets.render(df, ["x"]).count() == 2
    delimited.write_csv(df, f"{tmp_path}/out", lengths={"s": 2})
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["x (us2000)", "b (nT)", "s[0]", "s[1]"]
    for bad in (packet_stream()[:-3], b"[00]abc", packet_stream() + b":07:", packet_stream() + b"?what"):
        with pytest.raises(packets.StreamError):
            packets.parse(bad)


def test_streaming_bins(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 30) AS t, cast(id AS double) AS v FROM range(40)").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("t timestamp, v double").parquet(f"{tmp_path}/in")
    q = stream_bins.windowed(s, "t", 60, "v", late="0 seconds").writeStream.outputMode("append").format("memory").queryName("bins_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["bin"].minute: (r["mean"], r["n"]) for r in spark.table("bins_out").collect()}
    assert got[0] == (0.5, 2) and got[5] == (10.5, 2)


def canonical(rows, columns):
    one = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "part", "embeddings", "pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), columns) == canonical([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_union_packets_takes_every_kind(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"kind {i % 150:03d}", float(i)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalog.QUERIES["union_packets"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.execute(catalog.ORACLE_SQL["union_packets"]).fetchall()) and len(got) == 151
