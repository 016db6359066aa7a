"""String functions: normalised parameters, versions, path templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_params(s: Column) -> Column:
    """Sorted, joined parameters: options keep their value as -x_value; blank gives _noparam."""
    tied = F.regexp_replace(F.trim(s), r"(^|\s)(-\w)\s+(?=[^-\s])", "$1$2_")
    joined = F.array_join(F.array_sort(F.split(tied, r"\s+")), "_")
    return F.when(F.trim(F.coalesce(s, F.lit(""))) == "", "_noparam").otherwise(joined)


def version_key(v: Column, kind: str = "sep") -> Column:
    """Sort key of a version: numbers between separators, one number, or the text itself."""
    if kind == "alpha":
        return v
    if kind == "int":
        return v.try_cast("long")
    return F.transform(F.split(v, "[.p_-]"), lambda x: x.try_cast("int"))


FIELDS = {"Y": r"(\d{4})", "m": r"(\d{2})", "d": r"(\d{2})", "j": r"(\d{3})", "H": r"(\d{2})", "M": r"(\d{2})", "S": r"(\d{2})", "v": r"(\d[\w.]*?)", "x": r"([^/]*?)"}


WIDTHS = {"Y": 4, "m": 2, "d": 2, "j": 3, "H": 2, "M": 2, "S": 2}
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escaped(s: Column) -> Column:
    for sign, name in _ESCAPES:
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


def xml_unescaped(s: Column) -> Column:
    for sign, name in reversed(_ESCAPES):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return s


def to_base(s: Column, base: int) -> Column:
    """Whole numbers written in a base from 2 to 36, with or without 0x; null for others."""
    clean = F.regexp_replace(F.lower(F.trim(s)), "^0x", "") if base == 16 else F.lower(F.trim(s))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    return F.when(clean.rlike(f"^-?[{digits}]+$"), F.conv(clean, base, -10).cast("long"))


class PathTemplate:
    """Paths with $Y $m $d $j $H $M $S, $v (greatest version wins) and $x (last in order wins)."""

    def __init__(self, pattern: str):
        self.pattern, self.names, out, at = pattern, [], "", 0
        for m in re.finditer(r"\$(?:\{|\()?([A-Za-z])[^/${}()]*?(?:\}|\)|(?=[^A-Za-z]|$)|)", pattern):
            out += re.escape(pattern[at : m.start()]) + FIELDS[m[1]]
            self.names.append(m[1])
            at = m.end()
        self.regex = "^" + out + re.escape(pattern[at:]) + "$"

    def fields(self, path: Column) -> dict[str, Column]:
        return {n: F.regexp_extract(path, self.regex, i + 1) for i, n in enumerate(self.names)}

    def render(self, **values: Column) -> Column:
        """The path of given fields; numbers of a date or time are padded with zeros to their width."""
        parts = re.split(r"\$(?:\{|\()?([A-Za-z])[^/${}()]*?(?:\}|\)|(?=[^A-Za-z]|$)|)", self.pattern)
        padded = lambda n: F.lpad(values[n].cast("string"), WIDTHS[n], "0") if n in WIDTHS else values[n].cast("string")
        return F.concat(*[padded(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])

    def matches(self, path: Column) -> Column:
        return path.rlike(self.regex)
