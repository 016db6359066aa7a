"""Typed properties that cascade from column to packet to stream, and values by type: parse, format, compare."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from .timescales import parse_micros

KINDS = ("string", "bool", "integer", "real", "datetime")
_TYPES = {"int": "integer", "double": "real", "boolean": "bool", "time": "datetime", "str": "string", "datum": "real", "timerange": "datetimeRange", "datumrange": "realRange", "doublearray": "realArray"}


def to_bool(s: str) -> bool:
    """true, false, yes, no, 1 or 0 in any case; anything else raises."""
    t = s.strip().lower()
    if t in ("true", "t", "yes", "y", "1"):
        return True
    if t in ("false", "f", "no", "n", "0"):
        return False
    raise ValueError(f"{s!r} is no truth value")


def to_int(s: str, base: int = 0) -> int:
    """Decimal, or 0x, 0o and 0b forms; another base is given."""
    return int(s.strip(), base)


def to_real(s: str) -> float:
    return float(s.strip())


def value(kind: str, s: str):
    """The value of a text of one of KINDS; calendar times are ISO texts that parse."""
    if kind == "bool":
        return to_bool(s)
    if kind == "integer":
        return to_int(s)
    if kind == "real":
        return to_real(s)
    if kind == "datetime":
        parse_micros(s)
        return s.strip()
    if kind == "string":
        return s
    raise ValueError(f"unknown kind {kind!r}")


def text(v, digits: int = 6) -> str:
    """The text of a value by its type; floats in exponent form with that many digits."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v:.{digits}e}"
    return str(v)


def items(s: str, term: str | None = None) -> list[str]:
    """The items of an array text: split at white space, or at term, each stripped; a last empty one is dropped."""
    if not term:
        return s.split()
    out = [x.strip() for x in s.split({"\\n": "\n", "\\t": "\t"}.get(term, term))]
    return out[:-1] if out and not out[-1] else out


def convert(kind: str, s: str, units: str | None = None, term: str | None = None):
    """A property's value: one, a list for ...Array kinds, a (low, high) pair for ...Range kinds; units make it (value, units)."""
    kind = _TYPES.get(kind.lower(), kind)
    if kind.endswith("Array"):
        out = [value(kind[:-5], x) for x in items(s, term)]
    elif kind.endswith("Range"):
        low, _, high = s.partition(" to ")
        if not high:
            raise ValueError(f"{s!r} is no range")
        if units is None and (m := re.fullmatch(r"(\S+)\s+(\S.*)", high.strip())):
            high, units = m[1], m[2]
        out = (value(kind[:-5], low), value(kind[:-5], high))
    else:
        if kind == "real" and units is None and (m := re.fullmatch(r"\s*([-+0-9.eE]+)\s+(\S.*?)\s*", s)):
            s, units = m[1], m[2]
        out = value(kind, s)
    return (out, units) if units else out


class Properties(Mapping):
    """Own properties over a parent's: a missing key is looked for upwards."""

    def __init__(self, own: dict | None = None, parent: Properties | None = None):
        self.own, self.parent = dict(own or {}), parent

    def __getitem__(self, key: str):
        if key in self.own:
            return self.own[key]
        if self.parent is None:
            raise KeyError(key)
        return self.parent[key]

    def __iter__(self):
        yield from self.own
        if self.parent is not None:
            yield from (k for k in self.parent if k not in self.own)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def local(self, key: str, default=None):
        return self.own.get(key, default)

    def set(self, key: str, v, units: str | None = None) -> None:
        """Own value; with units a (value, units) pair."""
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.:-]*", key):
            raise ValueError(f"bad property name {key!r}")
        self.own[key] = (v, units) if units else v

    def remove(self, key: str) -> bool:
        return self.own.pop(key, None) is not None

    def copy_in(self, other: Mapping, *, replace: bool = True) -> None:
        """Takes the other's own properties, its parents' not."""
        for k, v in (other.own if isinstance(other, Properties) else other).items():
            if replace or k not in self.own:
                self.own[k] = v

    def same(self, other: Properties) -> bool:
        """Equal own properties, whatever the parents."""
        return self.own == other.own

    def _bare(self, key: str, default):
        v = self.get(key, default)
        return v[0] if isinstance(v, tuple) and len(v) == 2 and isinstance(v[1], str) else v

    def get_bool(self, key: str, default: bool = False) -> bool:
        v = self._bare(key, default)
        return to_bool(v) if isinstance(v, str) else bool(v)

    def get_int(self, key: str, default: int = 0) -> int:
        v = self._bare(key, default)
        return to_int(v) if isinstance(v, str) else int(v)

    def get_real(self, key: str, default: float = math.nan) -> float:
        v = self._bare(key, default)
        return to_real(v) if isinstance(v, str) else float(v)

    def get_list(self, key: str) -> list:
        v = self.get(key, [])
        return items(v) if isinstance(v, str) else list(v)

    def get_range(self, key: str):
        """(low, high) of a range, parsed from its text if need be."""
        v = self.get(key)
        if isinstance(v, str):
            v = convert("datetimeRange" if re.match(r"\s*\d{4}-", v) else "realRange", v)
        return v[0] if isinstance(v, tuple) and isinstance(v[0], tuple) else v


def of_column(df, name: str, packet: dict | None = None, stream: dict | None = None) -> Properties:
    """The properties of a column: its metadata, then its packet's and the stream's."""
    return Properties(df.schema[name].metadata.get("props", df.schema[name].metadata), Properties(packet, Properties(stream)))


def compare(a, b) -> int:
    """-1, 0 or 1 for values of any kinds: numbers by value, times by instant, else texts; numbers precede texts."""
    def key(v):
        if isinstance(v, (bool, int, float)):
            return (0, float(v) if not isinstance(v, int) else v, "")
        try:
            return (1, parse_micros(str(v)), "")
        except ValueError:
            return (2, 0, str(v))

    x, y = key(a), key(b)
    return (x > y) - (x < y)


class Frames:
    """Reference frames of a stream by name."""

    MOST = 12

    def __init__(self):
        self.by_name: dict[str, dict] = {}

    def add(self, name: str, body: str, **props) -> dict:
        if name in self.by_name:
            raise ValueError(f"frame {name!r} exists")
        if len(self.by_name) >= self.MOST:
            raise ValueError(f"more than {self.MOST} frames")
        self.by_name[name] = {"name": name, "body": body} | props
        return self.by_name[name]

    def find(self, name: str) -> dict | None:
        return self.by_name.get(name)

    def rows(self, spark):
        """name and body of every frame, as a frame to list or join with."""
        return spark.createDataFrame([(f["name"], f["body"]) for f in self.by_name.values()], "name string, body string")
