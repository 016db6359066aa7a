"""Typed, unit-aware arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units

RANGE = {"ubyte": (0, 255), "byte": (-128, 127), "ushort": (0, 65535), "short": (-32768, 32767), "uint": (0, 2**32 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1)}
STORAGE = {"ubyte": "smallint", "byte": "tinyint", "ushort": "int", "short": "smallint", "uint": "bigint", "int": "int", "ulong": "decimal(20,0)", "long": "bigint", "float": "float", "double": "double", "text": "string", "time": "timestamp_ntz", "blob": "binary"}
FILL = {"ubyte": 255, "byte": -128, "ushort": 65535, "short": -32767, "uint": 2**32 - 1, "int": -(2**31) + 1, "ulong": 2**64 - 1, "long": -(2**63) + 1, "float": -1e31, "double": -1e31}
_SMALL = frozenset(("ubyte", "byte", "ushort", "short", "float"))
_NUMERIC = frozenset(RANGE) | {"ulong", "float", "double"}


def promote(left: str, op: str, right: str) -> str | None:
    """Value type of left op right, None where they don't go together. The table is symmetric."""
    if left == right == "time":
        return "double" if op == "-" else None
    if left == "time":
        return "time" if op in "+-" and right in _NUMERIC else None
    if left in _NUMERIC and right in _NUMERIC:
        return "float" if left in _SMALL and right in _SMALL else "double"
    return None


def binary(a: Column, op: str, b: Column, units_a: str = "", units_b: str = "") -> tuple[Column, str]:
    """a op b with b scaled to a's units where they must agree; nulls (fill) spread; the result's units."""
    if op in ("**", "^"):
        return F.pow(a, b), ""
    out, factor = units.merged(units_a, op, units_b)
    b = b if factor == 1 else b * factor
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op], out


_UNARY = {"-": F.negative, "ln": F.ln, "log": F.log10, "sqrt": F.sqrt, "√": F.sqrt, "curt": F.cbrt, "∛": F.cbrt}


def unary(op: str, a: Column) -> Column:
    """One of - ln log sqrt curt, or a power such as ^2, ², **3, ^-1."""
    if op in _UNARY:
        return _UNARY[op](a)
    power = {"²": 2, "³": 3}.get(op) or int(op.removeprefix("**").removeprefix("^"))
    return F.pow(a, F.lit(power))


def checked(c: Column, to: str, overflow: str = "fill") -> Column:
    """Cast to a storage type; values out of its range become null, or raise with overflow="error"."""
    if to in RANGE:
        low, high = RANGE[to]
        inside = (c >= F.lit(low)) & (c <= F.lit(high))
        if overflow == "error":
            return F.when(c.isNull() | inside, c).otherwise(F.raise_error(F.lit(f"value out of range of {to}"))).cast(STORAGE[to])
        return F.when(inside, c).cast(STORAGE[to])
    return c.cast(STORAGE[to]) if overflow == "error" else c.try_cast(STORAGE[to])


def is_fill(c: Column, fill: float) -> Column:
    """The relative test: within 1e-5 of the fill value, or 0 where that is 0. NaN is data."""
    return F.coalesce((c == 0) if fill == 0 else (F.abs((F.lit(fill) - c) / F.lit(fill)) < 1e-5) & ~F.isnan(c.cast("double")), F.lit(False))


def to_null(c: Column, fill: float) -> Column:
    return F.when(~is_fill(c, fill), c)


def to_fill(c: Column, fill: float) -> Column:
    return F.coalesce(c, F.lit(fill))


def loses(col: Column, to: str) -> Column:
    """Whether a value in range changes when cast to a type of this module's names and back: it has digits the type lacks."""
    cast = checked(col, to)
    return F.coalesce(cast.cast("double") != col.cast("double"), F.lit(False))
