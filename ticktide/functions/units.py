"""Unit algebra on the driver: parsing, products and powers, reduction to base units, conversion factors.

Only the resulting factor or affine pair enters a query plan."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

PREFIX = {"y": -24, "z": -21, "a": -18, "f": -15, "p": -12, "n": -9, "u": -6, "μ": -6, "µ": -6, "m": -3, "c": -2, "d": -1, "da": 1, "h": 2, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18, "Z": 21, "Y": 24}
PREFIX_NAME = {"yocto": -24, "zepto": -21, "atto": -18, "femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "centi": -2, "deci": -1, "deca": 1, "hecto": 2, "kilo": 3, "mega": 6, "giga": 9, "tera": 12, "peta": 15, "exa": 18, "zetta": 21, "yotta": 24}
SYMBOL = {"meter": "m", "gram": "g", "second": "s", "ampere": "A", "kelvin": "K", "mole": "mol", "candela": "cd", "radian": "rad", "steradian": "sr", "hertz": "Hz", "newton": "N", "pascal": "Pa", "joule": "J", "watt": "W", "coulomb": "C", "volt": "V", "farad": "F", "ohm": "Ω", "siemens": "S", "weber": "Wb", "tesla": "T", "henry": "H", "electronvolt": "eV", "day": "day", "hour": "hour", "minute": "min", "sec": "s", "hr": "hour", "Ohm": "Ω", "days": "day", "hours": "hour", "minutes": "min", "seconds": "s", "degree": "degrees", "deg": "degrees"}
#: Units read as a multiple of another.
ADHOC = {"day": (86400, "s", 1), "hour": (3600, "s", 1), "min": (60, "s", 1), "Hz": (1, "s", -1)}
PREFIXABLE = frozenset("m g s A K mol cd rad sr Hz N Pa J W C V F Ω S Wb T H eV".split())
#: Calendar units: (units a microsecond since 2000, value at 2000-01-01T00:00, unit of their differences).
EPOCHS = {"us2000": (1.0, 0.0, "μs"), "t2000": (1e-6, 0.0, "s"), "t1970": (1e-6, 946684800.0, "s"), "ns1970": (1e3, 9.466848e17, "ns"), "mj1958": (1 / 86400e6, 15340.0, "day"), "UTC": (1e-6, 0.0, "s"), "TT2000": (1e3, None, "ns"), "ET2000": (1e-6, None, "s")}


class UnitError(ValueError):
    """Units that don't allow what is asked of them."""


Parts = tuple[tuple[str, Fraction], ...]
_TOKEN = re.compile(r"\s*([/*])?\s*([^\s/*^()0-9][^\s/*^()]*?|[^\s/*^()]+?)\s*(?:(?:\*\*|\^)\s*\(?\s*(-?\d+(?:/\d+)?)\s*\)?)?(?=\s|/|\*(?!\*)|$)")


def _name(n: str) -> str:
    n = n.replace("µ", "μ").replace("Ω", "Ω")
    for x in (n, n.removesuffix("s")):
        if x in SYMBOL:
            return SYMBOL[x]
        for p in PREFIX_NAME:
            if x.startswith(p) and x[len(p) :] in SYMBOL:
                short = next(k for k, v in PREFIX.items() if v == PREFIX_NAME[p] and k != "u")
                return short + SYMBOL[x[len(p) :]]
    return "μ" + n[1:] if n[:1] == "u" and n[1:] in PREFIXABLE else n


@lru_cache(4096)
def parse(text: str) -> Parts:
    """Components with rational powers, in order; "" is dimensionless. A / inverts the component after it."""
    out: dict[str, Fraction] = {}
    at, text = 0, (text or "").strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise UnitError(f"can't read units {text!r} at {text[at:]!r}")
        power = Fraction(m[3] or 1) * (-1 if m[1] == "/" else 1)
        if m[2] != "1":
            n = _name(m[2])
            out[n] = out.get(n, Fraction(0)) + power
        at = m.end()
        while text[at : at + 1].isspace():
            at += 1
    return tuple((n, p) for n, p in out.items() if p)


def text(parts: Parts) -> str:
    """Positive powers first, each part as name or name**power."""
    ordered = [x for x in parts if x[1] > 0] + [x for x in parts if x[1] < 0]
    power = lambda p: "" if p == 1 else f"**{p}" if p.denominator == 1 else f"**({p})"
    return " ".join(n + power(p) for n, p in ordered)


def label(units: str) -> str:
    """Plot label with raised exponents in !a..!n markup."""
    return " ".join(n if p == 1 else f"{n}!a{p}!n" for n, p in parse(units))


def _plain(units: str) -> Parts:
    if units in EPOCHS:
        raise UnitError(f"{units} is a calendar unit")
    return parse(units)


def multiply(a: str, b: str) -> str:
    out = dict(_plain(a))
    for n, p in _plain(b):
        out[n] = out.get(n, Fraction(0)) + p
    return text(tuple((n, p) for n, p in out.items() if p))


def power(a: str, k: int | Fraction) -> str:
    return text(tuple((n, p * k) for n, p in _plain(a) if p * k))


def invert(a: str) -> str:
    return power(a, -1)


def root(a: str, k: int) -> str:
    return power(a, Fraction(1, k))


def divide(a: str, b: str) -> str:
    return multiply(a, invert(b))


def interval(a: str) -> str:
    """The unit of differences."""
    return EPOCHS[a][2] if a in EPOCHS else a


@lru_cache(4096)
def reduce(units: str) -> tuple[Parts, float]:
    """Base components in name order, and the factor to them."""
    out, factor = {}, 1.0
    for n, p in _plain(units):
        scale = 0
        if n not in ADHOC and n not in PREFIXABLE:
            for pre, e in sorted(PREFIX.items(), key=lambda x: -len(x[0])):
                if n.startswith(pre) and n[len(pre) :] in PREFIXABLE:
                    n, scale = n[len(pre) :], e
                    break
            else:
                for pre, e in PREFIX_NAME.items():
                    if n.startswith(pre) and len(n) > len(pre):
                        n, scale = n[len(pre) :], e
                        break
        factor *= 10.0 ** float(scale * p)
        if n in ADHOC:
            k, n, q = ADHOC[n]
            factor *= float(k) ** float(p)
            p = p * q
        out[n] = out.get(n, Fraction(0)) + p
    return tuple(sorted((n, p) for n, p in out.items() if p)), factor


def can_convert(a: str, b: str) -> bool:
    if a == b:
        return True
    if a in EPOCHS or b in EPOCHS:
        return a in EPOCHS and b in EPOCHS
    return reduce(a)[0] == reduce(b)[0]


def affine(a: str, b: str) -> tuple[float, float]:
    """(m, c) with value_in_b = m * value_in_a + c; leap-second scales are not affine and raise."""
    if a == b:
        return 1.0, 0.0
    if not can_convert(a, b):
        raise UnitError(f"can't convert {a!r} to {b!r}")
    if a in EPOCHS:
        (ka, za, _), (kb, zb, _) = EPOCHS[a], EPOCHS[b]
        if za is None or zb is None:
            raise UnitError(f"{a} to {b} takes the leap-second table")
        return kb / ka, zb - za * kb / ka
    return reduce(a)[1] / reduce(b)[1], 0.0


def convert(col, a: str, b: str):
    """A column's values from unit a in unit b; constants are folded on the driver."""
    m, c = affine(a, b)
    out = col if m == 1 else col * m
    return out if c == 0 else out + c


def can_merge(left: str, op: str, right: str) -> bool:
    """Whether units allow left op right; a calendar unit takes only differences, on its right."""
    if left in EPOCHS:
        return op == "-" and right in EPOCHS or op in "+-" and right not in EPOCHS and can_convert(interval(left), right)
    if right in EPOCHS:
        return False
    return op in ("*", "/") or op in "+-" and can_convert(left, right)


def merged(left: str, op: str, right: str) -> tuple[str, float]:
    """Result units of left op right, and the factor that the right side is scaled by first."""
    if not can_merge(left, op, right):
        raise UnitError(f"{left!r} {op} {right!r}")
    if left in EPOCHS:
        return (interval(left), 1.0) if right in EPOCHS else (left, affine(right, interval(left))[0])
    if op in "+-":
        return left, affine(right, left)[0]
    return (multiply if op == "*" else divide)(left, right), 1.0
