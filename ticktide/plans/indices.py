"""Index-space reasoning before a plan is made: shapes, broadcast, dependence, and which coordinate stands for which index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extent markers; a number is an extent.
RAGGED, BORROWED, UNUSED = "*", "^", "-"
#: Coordinates preferred for an index, in order.
PREFERRED = ("time", "altitude", "frequency", "energy")
#: Roles that can stand for a dimension's points, best first.
POINT_ROLES = ("center", "mean", "median", "mode")


def merge(a: str, b: str) -> str:
    """The extent of an index two variables share: ragged beats numbers, of which the lesser counts, then borrowed, then unused."""
    if RAGGED in (a, b):
        return RAGGED
    numbers = [int(x) for x in (a, b) if x.isdigit()]
    if numbers:
        return str(min(numbers))
    return BORROWED if BORROWED in (a, b) else UNUSED


def merged(shapes: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The shape of an index space from its variables' shapes."""
    rank = max((len(s) for s in shapes), default=0)
    out = [UNUSED] * rank
    for s in shapes:
        for i, x in enumerate(s):
            out[i] = merge(out[i], x)
    return tuple(out)


def degenerate(index: tuple[str, ...], i: int) -> bool:
    """Whether a variable is the same all along index i."""
    return i >= len(index) or index[i] == UNUSED


def depends_on(index: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(i for i in range(len(index)) if not degenerate(index, i))


def orthogonal(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two variables share no index."""
    return not set(depends_on(a)) & set(depends_on(b))


def cubic(coords: dict[str, tuple[str, ...]], rank: int) -> bool:
    """Whether each index has a coordinate of its own, which depends on that index alone."""
    own = {depends_on(s)[0] for s in coords.values() if len(depends_on(s)) == 1}
    return own == set(range(rank))


def point_role(roles: list[str]) -> str:
    """Which of a dimension's variables stands for its points; reference with offset counts as center."""
    for r in POINT_ROLES:
        if r in roles:
            return r
    if "reference" in roles and "offset" in roles:
        return "reference+offset"
    raise ValueError(f"no point variable among {roles}")


def solve_depends(coords: dict[str, tuple[str, ...]], rank: int) -> dict[int, str]:
    """One coordinate for each index.

    Coordinates of the lowest last index choose first, of equal ones those that depend on fewest
    indices, then preferred names, then in order. Each takes the last free index it depends on; an
    index left over gets no entry."""
    def key(item):
        k, (name, s) = item
        d = depends_on(s)
        best = next((i for i, p in enumerate(PREFERRED) if name == p or name.startswith(p + "_")), len(PREFERRED))
        return (max(d, default=rank), len(d), best, k)

    out: dict[int, str] = {}
    for _, (name, s) in sorted(enumerate(coords.items()), key=key):
        for i in reversed(depends_on(s)):
            if i not in out:
                out[i] = name
                break
    return dict(sorted(out.items()))


def groups(frames: dict[str, tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Frames of one join group as one, where their columns agree by name and type; others stay apart under their own names."""
    out: dict[str, DataFrame] = {}
    for name, (group, df) in frames.items():
        if group in out and sorted(out[group].dtypes) == sorted(df.dtypes):
            out[group] = out[group].unionByName(df)
        else:
            out[name if group in out else group] = df
    return out


def merge_streams(frames: list[DataFrame], by: str) -> DataFrame:
    """Streams of the same columns in one, each output partition a range of by and sorted within: no total sort in one task."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.repartitionByRange(F.col(by)).sortWithinPartitions(by)


def broadcast_to(value: Column, index: tuple[str, ...], like: Column, i: int = 1) -> Column:
    """A variable against an array over index i: repeated along it where the variable is degenerate there."""
    return F.transform(like, lambda _: value) if degenerate(index, i) else value


def long_form(df: DataFrame, arrays: dict[str, tuple[str, ...]], rank: int) -> DataFrame:
    """One row per index of an index space: i1, i2, ... and each array's item there.

    Only indices that some array uses are opened; arrays that are degenerate in one are repeated
    along it, in place, without a join."""
    used = [i for i in range(1, rank) if any(not degenerate(s, i) for s in arrays.values())]
    out, now = df, {n: F.col(n) for n in arrays}
    for i in used:
        lead = next(n for n, s in arrays.items() if not degenerate(s, i))
        out = out.select("*", F.posexplode(now[lead]).alias(f"i{i}", f"_v{i}"))
        for n, s in arrays.items():
            if not degenerate(s, i):
                out = out.withColumn(n, F.col(f"_v{i}") if n == lead else F.get(F.col(n), F.col(f"i{i}")))
        out = out.drop(f"_v{i}")
        now = {n: F.col(n) for n in arrays}
    return out


def replaced(df: DataFrame, name: str, values: Column) -> DataFrame:
    """df with another array for a variable, its metadata kept."""
    return df.withColumn(name, values.alias(name, metadata=df.schema[name].metadata))


def expression(op: str, left: str, right: str, factor: float = 1.0) -> str:
    """Printable form of a binary variable, the right side's unit factor shown where it isn't 1."""
    return f"({left} {op} {right})" if factor == 1.0 else f"({left} {op} {factor:.6e}*{right})"


def materialized(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back: what it is derived from isn't computed again; path is one that all machines share."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def constant(value, units: str = "", name: str = "value") -> Column:
    """The same value at any index, with its units."""
    return F.lit(value).alias(name, metadata={"units": units, "index": []})
