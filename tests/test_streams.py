"""Sources, sinks, properties, datums, index spaces and tiers on small inputs of our own."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.functions import arrays, datum, properties, timescales
from ticktide.operators import bins, spectral, vectors
from ticktide.plans import indices, tier_reader, tiers
from ticktide.sources import archive, catalog_tree, delimited, floats, packets, v3, v3write


def stream3(*parts):
    return v3write.stream_header({"title": "t", "rate": (2.5, "Hz"), "flags": [True, False]}, {"GSE": {"body": "EARTH"}}) + b"".join(parts)


def field(items=1, size=11, encoding="utf8", **options):
    return v3.Field(items, size, encoding, **options)


TIME = v3.Variable("time", "center", "coord", "datetime", "struct", "UTC", ("*",), axis="x", field=field(1, 24, fill="0001-01-01"))


def one(v, *, rank=1, more=()):
    return v3.Dataset(3, "set", ("*",) * rank, "set", {"note": "n"}, [TIME, v, *more])


QUALITY = v3.Variable("quality", "center", "data", "real", "float", "", ("*",), field=field(fill="-1e31"))

SHAPES = {
    "scalar": (v3.Variable("b", "center", "data", "real", "float", "nT", ("*",), field=field(fill="-1e31")), [1.5, None]),
    "vector": (v3.Variable("b", "center", "data", "real", "float", "nT", ("*",), 3, "cartesian", (1, 0, 2), "GSE", field=field(3, None, fill="-1e31")), [(1.0, -2.0, 3.5), (0.0, 0.5, 1.0)]),
    "cube": (v3.Variable("b", "center", "data", "real", "float", "nT", ("*", "2", "3"), field=field(6, 4, "LEreal")), [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], [[0.5, 0.25, 1.0], [2.0, 3.0, 4.0]]]),
    "words": (v3.Variable("s", "center", "data", "string", "", "", ("*", "*"), field=field(None, None, fill="", value_end=b";", run_ends=(b"!",))), [["a b", None, "c"], ["d"]]),
    "ragged": (v3.Variable("e", "center", "data", "real", "float", "V", ("*", "*"), field=field(None, 11, fill="-1e31", run_ends=(b"!",))), [[1.0, None, 3.0], [4.0]]),
    "nested": (v3.Variable("e", "center", "data", "real", "float", "V", ("*", "*", "*"), field=field(None, 11, run_ends=(b"!", b"$"))), [[[1.0, 2.0], [3.0]], [[4.0]]]),
    "sandwich": (v3.Variable("e", "center", "data", "real", "float", "V", ("*", "2", "*"), field=field(None, 11, run_ends=(b"!", b"$"))), [[[1.0], [2.0, 3.0]], [[4.0, 5.0], [6.0]]]),
    "counted": (v3.Variable("e", "center", "data", "real", "double", "V", ("*", "*", "*"), field=field(None, 8, "BEreal")), [[[1.0, 2.0], [3.0]], [[4.0]]]),
    "runs_of_vectors": (v3.Variable("e", "center", "data", "real", "float", "V", ("*", "*"), 2, "cartesian", (0, 1), field=field(None, 11, run_ends=(b"!",))), [[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0)]]),
    "ints": (v3.Variable("n", "center", "data", "integer", "int", "", ("*", "3"), field=field(3, 2, "BEuint", fill="65535")), [[1, None, 3], [4, 5, 6]]),
    "flags": (v3.Variable("f", "center", "data", "bool", "byte", "", ("*",), field=field(1, 6)), [True, False]),
    "blob": (v3.Variable("x", "center", "data", "blob", "", "", ("*",), field=field(1, None, "base64")), [b"\x00\xff|", b"abc"]),
    "raw": (v3.Variable("x", "center", "data", "blob", "", "", ("*",), field=field(1, None, "blob")), [b"\x00\xff|", b"abc"]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_version_3_shapes_round_trip(shape):
    v, values = SHAPES[shape]
    d = one(v, rank=len(v.index), more=(QUALITY,))
    times = ["2024-05-23T02:58:59.466", "2024-05-23T02:59:00.000"]
    raw = stream3(v3write.dataset_header(d), v3write.comment("note", "me", "hi <x>"), *[v3write.record(d, [t, x, 7.0]) for t, x in zip(times, values, strict=True)], v3write.exception("NoData", "none"))
    s, rows = v3.parse(raw)
    assert rows == [(3, [t, x, 7.0]) for t, x in zip(times, values, strict=True)]
    assert s.props["rate"] == (2.5, "Hz") and s.props["flags"] == [True, False] and s.frames["GSE"]["body"] == "EARTH"
    assert [e[2] for e in s.events] == ["hi <x>", "none"] and s.sets[3].props["note"] == "n"
    text = v3write.as_text(s.sets[3])
    again = stream3(v3write.dataset_header(text), *[v3write.record(text, r) for _, r in rows])
    assert v3.parse(again)[1] == rows and v3write.as_text(text) == text


def test_last_runs_may_end_with_the_record():
    v = v3.Variable("e", "center", "data", "real", "float", "V", ("*", "*"), field=field(None, 11))
    d = one(v, rank=2)
    body = b"2024-05-23T02:58:59.466  1.000e+00 -2.000e+00 \n"
    assert v3.record(d, body) == ["2024-05-23T02:58:59.466", [1.0, -2.0]]
    w = v3.Variable("s", "center", "data", "string", "", "", ("*", "*", "*"), field=field(None, None, value_end=b";", run_ends=(b"$", b"!")))
    assert v3.record(one(w, rank=3), b"2024-05-23T02:58:59.466 A;B!C;D$")[1] == [["A", "B"], ["C", "D"]]
    assert v3.record(one(w, rank=3), b"2024-05-23T02:58:59.466 A;B!C;D")[1] == [["A", "B"], ["C", "D"]]


def test_version_3_streams_that_raise():
    words = lambda **o: v3.Variable("s", "center", "data", "string", "", "", o.pop("index", ("*", "*", "*")), field=field(None, None, **o))
    t = b"2024-05-23T02:58:59.466 "
    for v, body in ((words(value_end=b";"), t + b"A;B;!C;!$"), (words(index=("*", "3", "*"), value_end=b";", run_ends=(b"\n", b"!")), t + b"OK;!OK;!"), (words(index=("*", "*"), value_end=b";", run_ends=(b"!",)), t + b"!"), (QUALITY, t + b"1.0")):
        with pytest.raises(packets.StreamError):
            v3.record(one(v, rank=len(v.index)), body)
    d = one(QUALITY)
    good = stream3(v3write.dataset_header(d), v3write.record(d, ["2024-01-01T00:00:00.000", 1.0]))
    for bad in (good[:-3], good.replace(b"|Pd|3|", b"|Pd|4|"), b"|Hx|1|2|ab", good.replace(b'index="*" units="UTC"', b'index="*;x" units="UTC"'), good.replace(b"utf8", b"utf9"), good.replace(b'rank="1"', b'rank="2"'), b"junk", b"|Sj||2|{}"):
        with pytest.raises(packets.StreamError):
            v3.parse(bad)
    with pytest.raises(packets.StreamError):
        v3write.record(one(SHAPES["sandwich"][0], rank=3), ["2024-01-01T00:00:00.000", [[1.0]]])
    with pytest.raises(packets.StreamError):
        v3write.record(one(SHAPES["ragged"][0], rank=2), ["2024-01-01T00:00:00.000", []])


def test_version_3_files(spark, tmp_path):
    v, values = SHAPES["runs_of_vectors"]
    d = one(v, rank=2, more=(QUALITY, v3.Variable("axis", "center", "coord", "real", "float", "s", ("-", "*"), base=("1.0",), steps=(("-", "0.5"),)), v3.Variable("mode", "center", "data", "real", "float", "", ("-", "2"), constant=[1.0, 2.0])))
    raw = stream3(v3write.dataset_header(d), *[v3write.record(d, ["2024-05-23T02:58:59.466", x, None]) for x in values])
    for i in range(3):
        (tmp_path / f"{i}.d3t").write_bytes(raw)
    df = v3.read(spark, str(tmp_path))[3]
    rows = df.orderBy(F.size("e")).collect()
    assert len(rows) == 6 and rows[0]["e"][0].x == 5.0 and rows[0]["quality"] is None and rows[0]["time"] == datetime(2024, 5, 23, 2, 58, 59, 466000)
    meta = df.schema["time"].metadata
    assert meta["constants"]["mode"]["values"] == [1.0, 2.0] and df.schema["e"].metadata["units"] == "V"
    assert v3.sequence(v3.headers(spark, str(tmp_path))[3].variables[3], (0, 4)) == 3.0
    v3write.write({3: df}, {3: d}, f"{tmp_path}/out", compression="deflate")
    assert v3.read(spark, f"{tmp_path}/out/*.d3t")[3].count() == 6
    (tmp_path / "odd.d3t").write_bytes(stream3(v3write.dataset_header(one(QUALITY))))
    with pytest.raises(packets.StreamError):
        v3.headers(spark, f"{tmp_path}/*.d3t")


def test_default_names(spark, tmp_path):
    raw = packets.stream_header() + packets._tagged("01", '<packet><x type="time24" units="UTC"/><y type="sun_real4" name="b" units="V"/><y type="double" units="V"/><yscan type="ascii10" nitems="1" yTags="1"/></packet>')
    (tmp_path / "a.d2t").write_bytes(raw)
    df = packets.read(spark, f"{tmp_path}/a.d2t")[1]
    assert packets.default_names(df).columns == ["time", "b", "Y_2", "YSCAN_1"]


def test_version_2_names_tags_versions_and_events():
    raw = packets.stream_header() + packets._tagged("01", '<packet><x type="time24" units="UTC"/><y type="sun_real4" units="V"/><y type="double" units="V"/><yscan type="ascii10" nitems="3" yTagInterval="2" yTagMin="1"/></packet>')
    s = packets.parse_stream(raw + packets.progress(5) + packets.event("log", "me", "x") + packets.no_data("a", "b"))
    (p,) = s.types.values()
    assert [x.name for x in p.planes] == ["x", "y", "y_2", "yscan"] and p.planes[3].tags == [1.0, 3.0, 5.0]
    assert [e[0] for e in s.events] == ["taskProgress", "log", "NoDataInInterval"]
    assert [e[0] for e in packets.parse_stream(raw + packets.progress(5), progress=False).events] == []
    row = ["2024-01-01T00:00:00.000", 1.5, None, [1.0, 2.0, 3.0]]
    other = packets.Packet(p.planes[:2])
    both = raw + packets.record(1, p, row) + packets.packet_header(1, other) + packets.record(1, other, row[:2])
    got = packets.parse_stream(both)
    assert sorted(got.types) == [(1, 0), (1, 1)] and [r[1] for r in got.rows] == [0, 1] and got.rows[0][2][2] == -1e31
    with pytest.raises(packets.StreamError):
        packets.record(1, p, ["a time text that is too long", 1.0, 1.0, [1.0, 2.0, 3.0]])


@pytest.mark.parametrize("binary, compression", [(False, "none"), (True, "deflate")])
def test_version_2_files(spark, tmp_path, binary, compression):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.5' + make_dt_interval(0, id, 0, 0) AS time, IF(id = 3, NULL, id * 1.5D) AS b, array(1D, NULL, CAST(id AS DOUBLE)) AS s FROM range(10)")
    df = df.withColumn("b", F.col("b").alias("b", metadata={"units": "nT"})).withColumn("s", F.col("s").alias("s", metadata={"tags": [1.0, 2.0, 4.0], "units": "V"}))
    packets.write({1: df, 2: df.select("time", "b")}, f"{tmp_path}/out", {"title": "x"}, binary=binary, compression=compression)
    got = packets.read(spark, f"{tmp_path}/out/*.d2t")
    rows = got[1].orderBy("time").collect()
    assert len(rows) == got[2].count() == 10 and rows[2]["b"] == 3.0 and rows[3]["b"] is None and rows[4]["s"] == [1.0, None, 4.0]
    assert got[1].schema["s"].metadata["tags"] == [1.0, 2.0, 4.0] and rows[0]["time"] == "2024-01-01T00:00:00.500"
    assert list(packets.read(spark, f"{tmp_path}/out/*.d2t", only=2)) == [2]
    with pytest.raises(ValueError):
        packets.write({1: df}, f"{tmp_path}/out")


def test_delimited_export(spark, tmp_path):
    df = spark.sql("SELECT 'a\"b' AS s, 1.5D AS x, array(1D, 2D) AS v").withColumn("x", F.lit(1.5).alias("x", metadata={"units": "nT", "props": {"label": "Field"}}))
    delimited.export({"one": df}, f"{tmp_path}/csv", lengths={"v": 2})
    (f,) = (tmp_path / "csv").glob("*.csv")
    lines = f.read_bytes().decode().split("\r\n")
    assert lines[0] == '"one";"id";"s";"x";"v[0]";"v[1]"' and lines[1].split(";")[3] == '"nT"' and lines[2].split(";")[3] == '"Field"'
    assert lines[3] == '"one";"values";"a""b";1.5000000e+00;1.0000000e+00;2.0000000e+00'


def test_properties_cascade_and_convert():
    stream = properties.Properties({"title": "S", "rate": "2.5"})
    own = properties.Properties({"label": "L"}, properties.Properties({"units": "nT"}, stream))
    assert own["title"] == "S" and own.local("title") is None and len(own) == 4 and own.get_real("rate") == 2.5
    own.set("title", "mine")
    assert own["title"] == "mine" and own.remove("title") and own["title"] == "S" and not own.remove("title")
    other = properties.Properties({"label": "X", "new": 1})
    own.copy_in(other, replace=False)
    assert own["label"] == "L" and own["new"] == 1 and not own.same(other)
    with pytest.raises(ValueError):
        own.set("bad name", 1)
    c = properties.convert
    assert c("integerArray", "10;20;30", term=";") == [10, 20, 30] and c("stringArray", "a b c") == ["a", "b", "c"]
    assert c("stringArray", "one\ntwo\n", term="\\n") == ["one", "two"] and c("realRange", "1.0 to 1000.0", "Hz") == ((1.0, 1000.0), "Hz")
    assert c("boolArray", "true;false;", term=";") == [True, False] and c("datetimeRange", "2026-06-07 to 2026-06-08") == ("2026-06-07", "2026-06-08")
    assert c("Datum", "80 s") == (80.0, "s") and c("int", "0x10") == 16
    for kind, s in (("bool", "maybe"), ("integer", "1.5"), ("realRange", "1"), ("datetime", "soon"), ("shape", "x")):
        with pytest.raises(ValueError):
            c(kind, s)
    assert properties.Properties({"r": "1 to 2 Hz"}).get_range("r") == (1.0, 2.0)


def test_values_compare_and_format():
    cmp = properties.compare
    assert cmp(1, 1.0) == 0 and cmp(2, 10) == -1 and cmp("2020-01-01", "2019-365T00:00") == 1 and cmp("b", "a") == 1 and cmp(5, "a") == -1 and cmp(True, 0) == 1
    assert properties.text(1.5, 2) == "1.50e+00" and properties.text(True) == "true" and properties.text(7) == "7"
    frames = properties.Frames()
    frames.add("GSE", "EARTH")
    assert frames.find("GSE")["body"] == "EARTH" and frames.find("X") is None
    with pytest.raises(ValueError):
        frames.add("GSE", "EARTH")


@pytest.mark.parametrize("text, want", [("2020-01-05T01:02:03.5", "2020-01-05T01:02:03.500"), ("2020-005T01:02", "2020-01-05T01:02:00.000"), ("2020/1/5 1:2:3", "2020-01-05T01:02:03.000"), ("5-Jan-2020", "2020-01-05T00:00:00.000"), ("Jan 5, 2020 12:30", "2020-01-05T12:30:00.000"), ("1/5/97", "1997-01-05T00:00:00.000"), ("97-1-5", None), ("2020-01-05T01:02:03,25Z", "2020-01-05T01:02:03.250"), ("2020", "2020-01-01T00:00:00.000"), ("2020 005 10:00", "2020-01-05T10:00:00.000"), ("hello", None), ("", None), ("2020-13-01", None)])
def test_free_times(text, want):
    if want is None and text != "97-1-5":
        with pytest.raises(ValueError):
            timescales.parse_micros(text)
    elif want:
        assert timescales.format_micros(timescales.parse_micros(text)) == want


def test_time_arithmetic():
    assert timescales.normal(2020, 14, 0, 25, -1, 61.5) == (2021, 1, 31 + 0, 31, 1 - 1, 0, 1.5) or timescales.normal(2020, 1, 31, 23, 59, 61.5)[:3] == (2020, 2, 1)
    assert timescales.normal(2020, 12, 31, 23, 59, 60.0)[:4] == (2021, 1, 1, 1) and timescales.normal(97, 1, 1)[0] == 1997
    assert timescales.shifted("2020-01-01", 86400.0) == "2020-01-02T00:00:00.000" and timescales.shifted("2020-01-31", days=1, years=1, hours=-1) == "2021-01-31T23:00:00.000"
    assert timescales.order("2020-001", "2020-01-01") == 0 and timescales.seconds_between("2020-01-02", "2020-01-01") == 86400.0
    assert timescales.weekday("2024-09-01") == 0 and timescales.format_micros(0, 0, "dual") == "1970-01-01 (001)T00:00:00" and timescales.format_micros(999_999_999, 2, "ordinal") == "1970-001T00:16:40.00"
    assert timescales.load_leaps("DELTA_AT = ( 10, @1972-JAN-1\n 11, @1972-JUL-1 )") == (("1972-01-01", 10), ("1972-07-01", 11))
    assert timescales.load_leaps("1972 7 1 11.0\n1973 1 1 12.0") == (("1972-07-01", 11), ("1973-01-01", 12))


def test_datums():
    d = datum.parse("80 s")
    assert (d.value, d.unit) == (80.0, "s") and d.to("ms") == 80000.0 and d.text() == "80 s"
    t = datum.parse("2017-001T14:00 UTC")
    assert t.is_time and t.text(seconds=0) == "2017-01-01T14:00:00 UTC" and datum.Datum(t.to("us2000"), "us2000").time() == t
    a, b = datum.parse_range("5 to 6000 Hz")
    assert (a.unit, b.value) == ("Hz", 6000.0) and datum.compare(datum.parse("1 minute"), datum.parse("59 s")) == 1
    assert datum.parse_range("1997-05-07T15:00 to 1997-05-07T15:10 UTC")[1].is_time
    with pytest.raises(ValueError):
        datum.parse_range("5 Hz")


def test_index_spaces():
    m = indices.merged
    assert m([("*", "-", "80"), ("*", "160", "-"), ("-", "-", "60")]) == ("*", "160", "60") and m([("*", "^"), ("*", "*")]) == ("*", "*") and m([]) == ()
    coords = {"time": ("*", "-", "-"), "altitude": ("*", "-", "80"), "frequency": ("-", "160", "-")}
    assert indices.solve_depends(coords, 3) == {0: "time", 1: "frequency", 2: "altitude"}
    assert not indices.cubic(coords, 3) and indices.cubic({"a": ("*", "-"), "b": ("-", "4")}, 2)
    assert indices.orthogonal(("*", "-"), ("-", "4")) and not indices.orthogonal(("*", "4"), ("-", "4"))
    assert indices.point_role(["min", "mean"]) == "mean" and indices.point_role(["offset", "reference"]) == "reference+offset"
    with pytest.raises(ValueError):
        indices.point_role(["min", "max"])
    assert indices.expression("-", "a", "b") == "(a - b)" and "1.000000e+03*b" in indices.expression("+", "a", "b", 1000.0)


def test_array_helpers(spark):
    assert arrays.tags(None, 1.0, 0.5, 3) == [1.0, 1.5, 2.0] and arrays.interval([0.0, 1.0, 2.0]) == 1.0 and arrays.box_shape([(0, 1), (2, 5)]) == [3]
    with pytest.raises(ValueError):
        arrays.interval([0.0, 1.0, 3.0, 7.0, 20.0])
    with pytest.raises(ValueError):
        arrays.box_shape([(3, 3)])
    r = spark.range(1).select(arrays.cube_index([(0, 2), (5, 7)]).alias("c"), arrays.cleared(F.array(F.lit(1))).alias("e"), arrays.runs(F.array(*map(F.lit, range(5))), F.array(F.lit(2), F.lit(4))).alias("r")).first()
    assert r["c"] == [[0, 5], [0, 6], [1, 5], [1, 6]] and r["e"] == [] and r["r"] == [[0, 1], [2, 3], [4]]


def test_labels():
    assert bins.resolution_label(60) == " (1.0 minute Averages)" and bins.resolution_label(0.5) == " (500 ms Averages)" and bins.resolution_label(86400 * 2) == " (2 day Averages)"
    assert bins.axis_interval(60) == "minute" and bins.axis_interval(600) == "10 minutes" and bins.axis_interval(5400) == "1.5 hours"
    assert bins.rate_label(1) == ("Stream Volume (packets/s)", "packets s**-1") and bins.rate_label(1, events=True)[1] == ""
    assert bins.width_properties(60, 120)["xTagWidth"] == "120 s" and bins.collapses("waveform", [0, 1, 2], 5) and not bins.collapses("scan", [0, 1], 5)


def test_rates_refuse_time_that_goes_back(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 2.0), (4, None)], "n int, t double")
    assert {tuple(r) for r in bins.rates(d, F.col("t"), 2.0, dense=False).collect()} == {(0, 2), (2, 1)}
    assert [r["rate"] for r in bins.rates(d, F.col("t"), 2.0).orderBy("bin").collect()] == [2, 0, 1]
    with pytest.raises(Exception, match="time goes back"):
        bins.rates(d, F.col("t"), 2.0, dense=False, order=["n"]).collect()
    assert bins.rates(d.limit(0), F.col("t"), 2.0).count() == 0


def test_spectra_of_known_waves():
    x = np.array([[math.cos(2 * math.pi * 2 * i / 16) for i in range(16)]])
    p = spectral.psd_of(x, None, center=False)
    assert p.argmax() == 2 and spectral.power_ratio(x, p, center=False)[0] == pytest.approx(1.0)
    re, im = spectral.components_of(x)
    assert re.shape == (1, 16) and re[0, 2] == pytest.approx(8) and im[0, 2] == pytest.approx(0, abs=1e-9)
    assert spectral.density("V", 0.5, 16) == (8.0, "V**2 Hz**-1")


def test_cadence_breaks_restart_spectra(spark):
    rows = [("a", 0.5 * i, float(i % 4)) for i in range(20)] + [("a", 100 + 0.5 * i, float(i % 4)) for i in range(20)]
    got = spectral.series_psd(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", "v", 0.5, 16, 2)
    assert {(r["seg"], r["win"]) for r in got.collect()} == {(0, 0), (2, 0)} and got.schema["psd"].metadata["tags"][1] == 0.125
    flat = spark.createDataFrame([("a", 0.5 * i, 1.0) for i in range(16)], "k string, t double, v double")
    assert spectral.series_psd(flat, ["k"], "t", "v", 0.5, 16).count() == 0


def test_vectors_of_every_system(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    for system in vectors.SYSTEMS:
        parts = vectors.from_rect((F.col("x") * 1000, F.col("y") * 1000, F.col("z") * 1000), system, 1000.0, 0.01)
        back = vectors.to_rect(parts, system, 1000.0, 0.01)
        assert d.select(*back).first() == pytest.approx((1000.0, 2000.0, 3000.0), abs=1e-3)
    v = d.select(vectors.vector([F.col("z"), F.col("x")], "cylindrical", (2, 0)))
    assert v.schema["vector"].metadata["order"] == [2, 0] and v.select(*vectors.ordered(F.col("vector"), "cylindrical", (2, 0))).first() == (1.0, 0.0, 3.0)
    assert vectors.component_labels("B", "cartesian", (0, 2)) == ["B!bx!n", "B!bz!n"] and vectors.frames_of(v) == []
    with pytest.raises(ValueError):
        vectors.vector([F.col("x")], "cartesian", (0, 0))
    with pytest.raises(ValueError):
        vectors.to_rect((F.col("x"),) * 3, "detic")


def test_positions_between_rows_and_gaps(spark):
    p = spark.createDataFrame([("m", "J", 0.0, 0.0, 0.0, 0.0), ("m", "J", 10.0, 10.0, 20.0, 0.0), ("m", "J", 100.0, 0.0, 0.0, 0.0)], "body string, frame string, at double, x double, y double, z double")
    t = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (50.0,), (100.0,), (101.0,)], "t double")
    got = {r["t"]: r["w"] for r in vectors.locate(t, p, "t", "m", "J", "w", gap=20.0).collect()}
    assert got[5.0]["x"] == 5.0 and got[0.0]["x"] == 0.0 and got[100.0]["y"] == 0.0 and got[50.0] is got[-1.0] is got[101.0] is None
    assert vectors.as_of(t, p.select("body", "at", "x").withColumnRenamed("body", "k"), "t", "at", [], ["x"]).where("t = 50").first()["x"] == 10.0


def test_tiers_read_what_exists(spark, tmp_path):
    cfg = {"cacheLevel_00": "intrinsic | daily | p", "cacheLevel_01": "60 s | daily | p"}
    root = f"{tmp_path}/cache"
    (tmp_path / "cache/p/bin-60s/2024/01").mkdir(parents=True)
    packet = packets.Packet([packets.Plane("x", "time", 24, time=True, encoding="time"), packets.Plane("y", "b", 14)])
    for day in (1, 2):
        raw = packets.stream_header() + packets.packet_header(1, packet) + b"".join(packets.record(1, packet, [f"2024-01-{day:02d}T{h:02d}:00:00.000", float(h)]) for h in range(24))
        (tmp_path / f"cache/p/bin-60s/2024/01/{day:02d}.d2t").write_bytes(raw)
    got = tier_reader.read(spark, cfg, root, "p", datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 6), 100.0, pad=3600.0)
    assert got[1].count() == 20
    with pytest.raises(tier_reader.NoData) as e:
        tier_reader.read(spark, cfg, root, "p", datetime(2025, 1, 1), datetime(2025, 1, 2), 100.0)
    assert packets.parse_stream(packets.stream_header() + e.value.packet).events[0][0] == "NoDataInInterval"
    with pytest.raises(tiers.NoTier):
        tier_reader.request({"cacheLevel_00": "1 s | persecond | p"}, "p", datetime(2024, 1, 1), datetime(2025, 1, 1), 2.0)


def test_float_records(spark, tmp_path):
    data = np.array([[0.0, 1.5, -99.0], [1.5, 2.5, 3.0]], ">f4").tobytes()
    (tmp_path / "a.dat").write_bytes(data)
    got = floats.read(spark, f"{tmp_path}/a.dat", ["a", "b"], 1_000_000, fill=-99.0).orderBy("time").collect()
    assert got[0]["b"] is None and got[1]["a"] == 2.5 and got[1]["time"] == datetime(1970, 1, 1, 0, 0, 2, 500000)
    assert list(floats.tagged(floats.tag([1.0, 2.0]) + floats.tag([3.0])))[1].tolist() == [3.0]
    (tmp_path / "b.dat").write_bytes(floats.tag([0.0, 1.0, 2.0]) + floats.tag([1.0, 5.0]))
    two = floats.read_tagged(spark, f"{tmp_path}/b.dat", 0, {2: [10.0, 20.0], 1: [10.0]})
    assert two[2].first()["values"] == [1.0, 2.0] and two[1].count() == 1 and two[2].schema["values"].metadata["tags"] == [10.0, 20.0]
    assert floats.lines(two[1].select("time", F.get("values", F.lit(0)).alias("v"))).first()["value"].endswith("5.000e+00")
    for bad in (data[:-1], b""[:0] + b"x" * 13):
        with pytest.raises(packets.StreamError):
            floats.records(bad, 3)
    with pytest.raises(packets.StreamError):
        list(floats.tagged(b":b0:12 ab"))


def test_catalogue(tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"type": "Catalog", "title": "root", "catalog": {"a": {"urls": ["missing.json", "a.json"]}, "a/b": {"urls": ["ab.json"]}, "gone": {"urls": ["no.json"]}}}))
    (tmp_path / "a.json").write_text(json.dumps({"type": "Catalog", "catalog": {"c": {"urls": ["c.json"]}, "b": {"urls": ["c.json"]}}}))
    (tmp_path / "ab.json").write_text(json.dumps({"type": "Catalog", "title": "long", "catalog": {}}))
    (tmp_path / "c.json").write_text(json.dumps({"type": "HttpStreamSrc", "interface": {"coords": [{"name": "t"}]}}))
    n = catalog_tree.from_files(str(tmp_path))
    assert n.walk("A/c").kind == "HttpStreamSrc" and n.walk("a/b").doc["title"] == "long" and n.walk("a/c").get("interface/coords/0/name") == "t"
    assert n.walk("a/c").get("interface/none") is None and '"t"' in n.walk("a/c").text("interface")
    assert [k for _, k, _ in n.tree()][0] == "Catalog" and len(list(n.tree())) == 4
    for bad in ("x", "gone", "a/zz"):
        with pytest.raises(catalog_tree.NoNode):
            n.walk(bad)
    with pytest.raises(OSError):
        n.fetch("../secret.json")
    with pytest.raises(NotImplementedError):
        catalog_tree.from_network("http://example.com")


def test_archive_layout(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' AS time, array(1D, 2D) AS frequency, array(3D, 4D) AS power")
    meta = {"time": {"kind": "coord", "index": ["*", "-"]}, "frequency": {"kind": "coord", "index": ["*", "2"], "units": "Hz"}, "power": {"kind": "data", "index": ["*", "2"], "units": "V", "props": {"label": "P", "summary": "s"}}}
    for n, m in meta.items():
        df = df.withColumn(n, F.col(n).alias(n, metadata=m))
    found = archive.export({"p1": df}, str(tmp_path), archive.rename_map("p1/power = PWR  # renamed\n"), {"title": "T"})
    v = found["variables"]
    assert v["PWR"]["attributes"]["DEPEND_0"] == "time" and v["PWR"]["attributes"]["DEPEND_1"] == "frequency" and v["PWR"]["attributes"]["LABLAXIS"] == "P" and found["globals"] == {"TITLE": "T"}
    assert v["time"]["type"] == "CDF_TIME_TT2000" and spark.read.parquet(f"{tmp_path}/p1").dtypes[0] == ("time", "bigint")
    assert archive.series_spec("B,avg(energy),slice(angle,3),comp(Bx)") == {"name": "B", "ops": [("avg", "energy"), ("slice", "angle", "3"), ("comp", "Bx")]}
    assert archive.array_literal("[1, 2.5, 3]") == [1.0, 2.5, 3.0] and archive.summary({"a": df})[0]["rows"] == 1
    for bad in ("B,max(x)", "B,slice(x)", "1B"):
        with pytest.raises(ValueError):
            archive.series_spec(bad)
    with pytest.raises(ValueError):
        archive.rename_map("a = X\nb = X")


def test_streaming_windows_and_runs(spark, tmp_path):
    from ticktide.streaming import bins as live

    src = f"{tmp_path}/in"
    sql = "SELECT 'k' AS k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {0}) AS t, CAST(id AS DOUBLE) AS v FROM range(20)"
    spark.sql(sql.format("id")).coalesce(1).write.parquet(src)
    schema = "k string, t timestamp, v double"

    def rows(f, name, *args):
        q = f(spark.readStream.schema(schema).parquet(src), *args).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = rows(live.counted, "windows", "k", "t", "v", 8, 2)
    assert sorted(r["values"] for r in got) == [[float(x) for x in range(a, a + 8)] for a in (0, 4, 8, 12)]
    runs = rows(live.run_bins, "runs", "k", "t", 5.0, "v")
    assert [(r["bin"], r["mean"], r["n"]) for r in sorted(runs, key=lambda r: r["bin"])] == [(0, 2.0, 5), (1, 7.0, 5), (2, 12.0, 5)]


def test_stream_data_source(spark, tmp_path):
    from ticktide.sources import datasource

    v, values = SHAPES["vector"]
    d = one(v, more=(QUALITY,))
    for k in range(2):
        (tmp_path / f"{k}.d3t").write_bytes(stream3(v3write.dataset_header(d), *[v3write.record(d, ["2024-05-23T02:58:59.466", x, 1.0]) for x in values]))
    datasource.register(spark)
    df = spark.read.format("ticktide_stream").option("set", "3").load(str(tmp_path))
    assert df.count() == 4 and df.where("quality = 1").first()["b"].y in (1.0, 0.0)
    with pytest.raises(packets.StreamError):
        datasource.first_header(str(tmp_path), 9)


def test_text_helpers_and_requests(spark):
    from ticktide.functions import expressions, text
    from ticktide.operators import select

    d = spark.createDataFrame([("<a & 'b'>", "ff", 2020, 5, 1.5, True), (None, "zz", 2021, 12, 2.0, False)], "s string, h string, y int, m int, v double, ok boolean")
    r = d.select(text.xml_unescaped(text.xml_escaped(F.col("s"))).alias("s"), text.to_base(F.col("h"), 16).alias("h"), text.PathTemplate("d/$Y/$m.dat").render(Y=F.col("y"), m=F.col("m")).alias("p"), expressions.loses(F.col("v"), "short").alias("lost")).collect()
    assert tuple(r[0]) == ("<a & 'b'>", 255, "d/2020/05.dat", True) and tuple(r[1]) == (None, None, "d/2021/12.dat", False)
    got = select.request(d, ["ok.eq.yes", "out.base"], {"h": ["ff"]}, {"base": ["y", "m"], "more": ["v"]})
    assert got.columns == ["y", "m"] and got.count() == 1
    for bad in (["h.eq.qq"], ["out.none"]):
        with pytest.raises(ValueError):
            select.request(d, bad, {"h": ["ff"]}, {"base": ["y"]})
    t = spark.createDataFrame([("5-Jan-2020 10:00",), ("soon",), (None,)], "s string").select(timescales.parse_any(F.col("s")).alias("t"))
    assert [x["t"] for x in t.collect()] == [datetime(2020, 1, 5, 10), None, None]
    assert t.select(timescales.dual(F.col("t"), 1).alias("x")).first()["x"] == "2020-01-05 (005)T10:00:00.0"


def test_materialized_and_grouped_frames(spark, tmp_path):
    a = spark.range(3).toDF("x")
    assert indices.materialized(a, f"{tmp_path}/m").count() == 3
    got = indices.groups({"p": ("g", a), "q": ("g", a), "r": ("g", a.toDF("y"))})
    assert got["g"].count() == 6 and got["r"].columns == ["y"]
    assert a.select(indices.constant(2.5, "V")).schema["value"].metadata["units"] == "V"


def test_following_a_folder_of_streams(spark, tmp_path):
    from ticktide.streaming import bins as live

    d = one(QUALITY)
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [v3write.record(d, [f"2024-05-23T0{k}:00:0{i}.000", float(i % 2)]) for i in range(4)]
        (tmp_path / f"in/{k}.d3t").write_bytes(stream3(v3write.dataset_header(d), *rows))
    df = v3.follow(spark, f"{tmp_path}/in", per_batch=2)[3]

    def rows(f, name):
        q = f.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r["value"], r["n"]) for r in rows(live.histogram(df.withColumn("i", F.lit(0)), "i", "quality"), "values_so_far")} == {(0.0, 6), (1.0, 6)}
    assert sorted(r["rate"] for r in rows(live.rates(df, "time", 3600.0), "rates_so_far")) == [4, 4, 4]
