"""Vectors: coordinate systems in closed form, rotation by matrix, positions from ephemeris tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEMS = {"cartesian": ("x", "y", "z"), "cylindrical": ("ρ", "ϕ", "z"), "spherical": ("r", "θ", "ϕ"), "centric": ("r", "ϕ", "θ"), "detic": ("a", "ϕ", "θ"), "graphic": ("a", "ϕ", "θ")}


def cylindrical(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Radius, longitude from 0 to 360 degrees, height."""
    return F.hypot(x, y), _longitude(x, y), z


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Radius, colatitude and longitude (-180 to 180) in degrees."""
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.when(r > 0, F.degrees(F.acos(z / r))).otherwise(0.0), F.degrees(F.atan2(y, x))


def latitudinal(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Radius, longitude (-180 to 180) and latitude in degrees."""
    return F.sqrt(x * x + y * y + z * z), F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.hypot(x, y)))


def geodetic(x: Column, y: Column, z: Column, radius: float, flattening: float, rounds: int = 5) -> tuple[Column, ...]:
    """Altitude, longitude and geodetic latitude in degrees above an ellipsoid, by a fixed number of iterations."""
    e2 = flattening * (2 - flattening)
    p = F.hypot(x, y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(rounds):
        n = radius / F.sqrt(1 - e2 * F.sin(lat) ** 2)
        lat = F.atan2(z + e2 * n * F.sin(lat), p)
    n = radius / F.sqrt(1 - e2 * F.sin(lat) ** 2)
    alt = p * F.cos(lat) + (z + e2 * n * F.sin(lat)) * F.sin(lat) - n
    return alt, F.degrees(F.atan2(y, x)), F.degrees(lat)


def _longitude(x: Column, y: Column) -> Column:
    a = F.degrees(F.atan2(y, x))
    return F.when(a < 0, a + 360.0).otherwise(a)


def from_cylindrical(r: Column, lon: Column, z: Column) -> tuple[Column, ...]:
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon)), z


def from_spherical(r: Column, colat: Column, lon: Column) -> tuple[Column, ...]:
    s = F.sin(F.radians(colat))
    return r * s * F.cos(F.radians(lon)), r * s * F.sin(F.radians(lon)), r * F.cos(F.radians(colat))


def from_latitudinal(r: Column, lon: Column, lat: Column) -> tuple[Column, ...]:
    c = F.cos(F.radians(lat))
    return r * c * F.cos(F.radians(lon)), r * c * F.sin(F.radians(lon)), r * F.sin(F.radians(lat))


def rotated(v: tuple[Column, Column, Column], m: list[Column]) -> tuple[Column, ...]:
    """The 3 x 3 matrix, row by row, times v."""
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


#: Periods that a lookup without other keys cuts its table's time into.
PERIODS = 256


def _seconds(c: Column, kind) -> Column:
    return (F.unix_micros(c.cast("timestamp")) / 1e6) if kind.typeName().startswith("timestamp") else c.cast("double")


def as_of(df: DataFrame, table: DataFrame, time: str, at: str, keys: list[str], values: list[str], period: float | None = None) -> DataFrame:
    """df with the table's values of the latest row of the same keys at or before time; of nulls the latest value that is none.

    One union and one window over keys: no range join. With period (seconds, or units of time's
    numbers) each window spans one period of a key, and what a period begins with is carried over
    from a table of one row a period, so long series of few keys are many tasks. values must be no
    columns of df."""
    a = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys, F.col(time).alias("as_t"), F.lit(1).alias("as_o"), *[F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values])
    b = table.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *keys, F.col(at).alias("as_t"), F.lit(0).alias("as_o"), *values)
    u = a.unionByName(b)
    upto = Window.unboundedPreceding, 0
    if period is None:
        w = Window.partitionBy(*keys).orderBy("as_t", "as_o").rowsBetween(*upto)
        return u.select("row", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("row is not null").select("row.*", *values)
    u = u.withColumn("as_p", F.floor(_seconds(F.col("as_t"), u.schema["as_t"].dataType) / period))
    w = Window.partitionBy(*keys, "as_p").orderBy("as_t", "as_o").rowsBetween(*upto)
    within = u.select("row", *keys, "as_p", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("row is not null")
    ends = u.groupBy(*keys, "as_p").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("as_t"))).alias(f"end_{v}") for v in values])
    e = Window.partitionBy(*keys).orderBy("as_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.col("as_p").alias("end_p"), *[F.last(f"end_{v}", ignorenulls=True).over(e).alias(f"end_{v}") for v in values])
    on = F.col("as_p").eqNullSafe(F.col("end_p"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    return within.join(ends, on, "left").select("row.*", *[F.coalesce(v, f"end_{v}").alias(v) for v in values])


def _period(table: DataFrame, at: str) -> float:
    """A period that cuts the table's time into PERIODS; 1 for tables without extent."""
    low, high = table.agg(F.min(at), F.max(at)).first()
    return (float(high) - float(low)) / PERIODS or 1.0 if low is not None else 1.0


#: What a missing component is: radii of curved systems 1, others 0.
_MISSING = {"ρ": 1.0, "r": 1.0}
_TO_RECT = {"cylindrical": from_cylindrical, "spherical": from_spherical, "centric": from_latitudinal}
_FROM_RECT = {"cylindrical": cylindrical, "spherical": spherical, "centric": latitudinal}


def vector(parts: list[Column], system: str = "cartesian", order: tuple[int, ...] | None = None, frame: str = "", units: str = "") -> Column:
    """A vector column: a struct in the order given, its system, order, frame and units in the metadata."""
    names = SYSTEMS[system]
    order = tuple(range(len(parts))) if order is None else order
    if len(order) != len(parts) or len(set(order)) != len(order) or not set(order) <= {0, 1, 2}:
        raise ValueError(f"bad component order {order}")
    return F.struct(*[c.cast("double").alias(names[i]) for c, i in zip(parts, order, strict=True)]).alias("vector", metadata={"system": system, "order": list(order), "frame": frame, "units": units})


def ordered(v: Column, system: str, order: tuple[int, ...]) -> tuple[Column, ...]:
    """All three components in the system's own order; those the vector lacks are 0, radii 1."""
    names = SYSTEMS[system]
    return tuple(F.coalesce(v.getField(n), F.lit(_MISSING.get(n, 0.0))) if i in order else F.lit(_MISSING.get(n, 0.0) if system != "cartesian" else 0.0) for i, n in enumerate(names))


def component(v: Column, name: str) -> Column:
    """One component by name."""
    return v.getField(name)


def component_labels(name: str, system: str = "cartesian", order: tuple[int, ...] = (0, 1, 2), given: list[str] | None = None) -> list[str]:
    """Labels of a vector's parts: the given ones, else the name with each part's symbol as index."""
    if given:
        if len(given) != len(order):
            raise ValueError(f"{len(given)} labels for {len(order)} components")
        return list(given)
    return [f"{name}!b{SYSTEMS[system][i]}!n" for i in order]


def to_rect(parts: tuple[Column, ...], system: str, radius: float | None = None, flattening: float = 0.0) -> tuple[Column, ...]:
    """Cartesian components of any system; detic and graphic ones need the body's radius."""
    if system == "cartesian":
        return parts
    if system in ("detic", "graphic"):
        if radius is None:
            raise ValueError(f"{system} coordinates need a body's radius")
        alt, lon, lat = parts
        lon = -lon if system == "graphic" else lon
        e2 = flattening * (2 - flattening)
        n = radius / F.sqrt(1 - e2 * F.sin(F.radians(lat)) ** 2)
        p = (n + alt) * F.cos(F.radians(lat))
        return p * F.cos(F.radians(lon)), p * F.sin(F.radians(lon)), (n * (1 - e2) + alt) * F.sin(F.radians(lat))
    return _TO_RECT[system](*parts)


def from_rect(parts: tuple[Column, ...], system: str, radius: float | None = None, flattening: float = 0.0) -> tuple[Column, ...]:
    if system == "cartesian":
        return parts
    if system in ("detic", "graphic"):
        if radius is None:
            raise ValueError(f"{system} coordinates need a body's radius")
        alt, lon, lat = geodetic(*parts, radius, flattening)
        return alt, -lon if system == "graphic" else lon, lat
    return _FROM_RECT[system](*parts)


def rotate(df: DataFrame, name: str, matrices: DataFrame, time: str, out: str, out_frame: str, out_system: str = "cartesian", at: str = "at", shift: float = 0.0) -> DataFrame:
    """df with out: the vector column in out_frame, by the latest matrix (m0 to m8, row by row) at or before time + shift seconds.

    The vector's system, order and frame come from its metadata; curved systems are made Cartesian
    first. Rows without a matrix of its frame and the wanted one get null. matrices has from_frame,
    to_frame, at and m0 to m8, time in any numbers that time is of too."""
    meta = df.schema[name].metadata
    if out_system in ("detic", "graphic"):
        raise ValueError(f"a rotation has no {out_system} output")
    system, order = meta.get("system") or "cartesian", tuple(meta.get("order", (0, 1, 2)))
    cells = [f"m{i}" for i in range(9)]
    table = matrices.where((F.col("from_frame") == meta.get("frame", "")) & (F.col("to_frame") == out_frame)).select(F.lit(0).alias("k_"), F.col(at).alias("at_"), *[F.col(c).cast("double") for c in cells])
    d = as_of(df.withColumn("k_", F.lit(0)).withColumn("t_", F.col(time) + shift), table, "t_", "at_", ["k_"], cells, _period(table, "at_"))
    rect = to_rect(ordered(F.col(name), system, order), system)
    turned = from_rect(rotated(rect, [F.col(c) for c in cells]), out_system)
    made = F.when(F.col("m0").isNotNull() & F.col(name).isNotNull(), F.struct(*[c.alias(n) for c, n in zip(turned, SYSTEMS[out_system], strict=True)]))
    return d.withColumn(out, made.alias(out, metadata=dict(meta) | {"frame": out_frame, "system": out_system, "order": [0, 1, 2]})).drop("k_", "t_", *cells)


def locate(df: DataFrame, positions: DataFrame, time: str, body: str, frame: str, out: str, system: str = "cartesian", shift: float = 0.0, gap: float | None = None, radius: float | None = None, flattening: float = 0.0) -> DataFrame:
    """df with out: the body's position in the frame at time + shift, between the table's rows by a straight line.

    positions has body, frame, at, x, y and z. Beyond the table's ends, or where its rows lie over
    gap apart, the position is null. Two lookups, back and forth in time, cut by periods."""
    names = df.columns
    p = positions.where((F.col("body") == body) & (F.col("frame") == frame)).select(F.lit(0).alias("k_"), F.col("at").cast("double").alias("at_"), (-F.col("at").cast("double")).alias("ta_"), F.struct(F.col("at").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).alias("lo"))
    period = _period(p, "at_")
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.lit(0).alias("k_"), (F.col(time) + shift).cast("double").alias("at"))
    d = as_of(d, p, "at", "at_", ["k_"], ["lo"], period).withColumn("ta", -F.col("at"))
    u = as_of(d, p.withColumnRenamed("lo", "hi"), "ta", "ta_", ["k_"], ["hi"], period)
    lo, hi = F.col("lo"), F.col("hi")
    part = F.when(hi["t"] > lo["t"], (F.col("at") - lo["t"]) / (hi["t"] - lo["t"])).otherwise(0.0)
    rect = tuple(lo[c] + part * (hi[c] - lo[c]) for c in "xyz")
    ok = lo.isNotNull() & hi.isNotNull() & (F.lit(True) if gap is None else hi["t"] - lo["t"] <= gap)
    made = F.when(ok, F.struct(*[c.alias(n) for c, n in zip(from_rect(rect, system, radius, flattening), SYSTEMS[system], strict=True)]))
    return u.select("row_.*", made.alias(out, metadata={"frame": frame, "system": system, "order": [0, 1, 2], "units": "km", "body": body}))


def frames_of(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, frame, system) of every vector column."""
    return [(f.name, f.metadata["frame"], f.metadata.get("system", "")) for f in df.schema.fields if f.metadata.get("frame")]
