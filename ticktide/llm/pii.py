"""Personal data: base detectors, and detectors on a deobfuscated text whose spans map back to the source."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+\.[0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(t: str):
    """As the leftmost non-overlapping matches of local@labels: every match takes the whole run before its @."""
    at, end = t.find("@"), 0
    while at >= 0:
        a = at
        while a > end and _LOCAL.match(t, a - 1):
            a -= 1
        m = _DOMAIN.match(t, at) if a < at else None
        if m:
            end = m.end()
            yield a, end
        at = t.find("@", max(at + 1, end))


def ips(t: str):
    for chunk in _DOTTED.finditer(t):
        if chunk[0].count(".") >= 3:
            for m in _IP.finditer(t, chunk.start(), chunk.end()):
                if all(int(x) <= 255 if len(x) < 8 else not x.strip("0") or int(x.lstrip("0")[:4]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split(".")):
                    yield m.span()


def cards(t: str):
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(t: str):
    at = t.find("+")
    while at >= 0:
        m = _PHONE.match(t, at)
        if m and 9 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()
        at = t.find("+", m.end() if m else at + 1)


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(t: str) -> list[tuple[int, int, str]]:
    return [(a, b, k) for k, f in DETECTORS.items() for a, b in f(t)]


# The transducers: each reads the text before it as (characters, source starts, source ends).

_LOOKALIKE = dict(zip("аеорсухіѕјһԁԛԝпгтвмнкАЕОРСУХІЅЈВМНКТΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαεικνρτυχγωɡɑıℓ", "aeopcyxisjhdqwnrtbmhkAEOPCYXISJBMHKTABEZHIKMNOPTYXoaeiknptuxywgail", strict=True))
_SIGN = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "｡": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "＋": "+", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " ", "（": "(", "）": ")", "＿": "_"}
_GONE = frozenset("​‌‍⁠﻿­᠎")
_NUMBER = {w: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, w in enumerate(words.split())} | {"oh": "0"}
#: Spelled digits in a row from which they are read as a number where no figure or plus sign is beside them.
SPELLED = 4
_BESIDE = re.compile(r"[0-9+][ .(-]{0,2}\Z")
_AFTER = re.compile(r"[ .)-]{0,2}[0-9]")
_WORD_RUN = re.compile(r"(?<![^\W_])(?:%s)(?:(?:[ ,.-]|, )(?:%s|dot|point|dash|hyphen|plus|punkt|punto))*(?![^\W_])" % (("|".join(sorted(_NUMBER, key=len, reverse=True)),) * 2), re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[ -](?=[0-9])", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_AT = re.compile(r"\s*(?:[\[({<]\s*(?:at|@|arroba|chez|ät)\s*[\])}>]|(?<=\s)(?:_at_|-at-|/at/|\*at\*)(?=\s))\s*", re.I)
_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]|(?<=\s)(?:_dot_|-dot-|/dot/|\*dot\*)(?=\s))\s*", re.I)
_PLAIN = re.compile(r"(?<![^\s(<\"'])([A-Za-z0-9._%+-]+(?:\s+(?:dot|punkt|punto)\s+[A-Za-z0-9._%+-]+)*)(\s+(?:at|arroba|@)\s+|@)((?:[A-Za-z0-9-]+(?:\s+(?:dot|punkt|punto)\s+|\s+\.\s+|\.))+)([A-Za-z]{2,})(?![A-Za-z0-9])", re.I)
_SPELLED_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s+(?:dot|point|punkt|punto)\s+[0-9]{1,3}){3}(?![\w.]*[0-9])", re.I)
_IP_DOT = re.compile(r"\s+(?:dot|point|punkt|punto)\s+", re.I)
_PLAIN_AT, _PLAIN_DOT = re.compile(r"\s+(?:at|arroba|@)\s+", re.I), re.compile(r"\s+(?:dot|punkt|punto|\.)\s+", re.I)
# What any edit of a transducer contains, so that a text without it needs no pass: tests compare with all characters and rules.
_ODD = re.compile("[%s！-～\U0001d400-\U0001d7ff]|(?![0-9])\\d" % "".join(map(re.escape, [*_GONE, *_SIGN, *_LOOKALIKE])))
_SIGNED = re.compile(r"[\[({<]\s*(?:at|@|arroba|chez|ät|dot|\.|punkt|punto|point)\s*[\])}>]|(?<=\s)(?:_at_|-at-|/at/|\*at\*|_dot_|-dot-|/dot/|\*dot\*)(?=\s)", re.I)
_SPACED = re.compile(r"\s(?:dot|point|punkt|punto|[.@])\s", re.I)


class Tape:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.a, self.b = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of this tape, in order; each new character stands for its whole span."""
        if not edits:
            return
        text, a, b, at = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[at:s], new)
            a += self.a[at:s]
            a += [self.a[s] if s < e else at] * len(new)
            b += self.b[at:s]
            b += [self.b[e - 1] if s < e else at] * len(new)
            at = e
        self.text, self.a, self.b = "".join([*text, self.text[at:]]), [*a, *self.a[at:]], [*b, *self.b[at:]]


def _characters(t: str):
    for i, c in enumerate(t):
        if c < " ":
            continue
        if c in _GONE:
            yield i, i + 1, ""
        elif c in _SIGN or c in _LOOKALIKE:
            yield i, i + 1, _SIGN.get(c) or _LOOKALIKE[c]
        elif (d := unicodedata.decimal(c, None)) is not None:
            yield i, i + 1, str(d)
        elif "！" <= c <= "～":
            yield i, i + 1, chr(ord(c) - 0xFEE0)
        elif "\U0001d400" <= c <= "\U0001d7ff" and len(n := unicodedata.normalize("NFKC", c)) == 1:
            yield i, i + 1, n


def _spelled(t: str):
    for m in _WORD_RUN.finditer(t):
        words = _WORD.findall(m[0])
        if sum(w.lower() in _NUMBER for w in words) < SPELLED and not (_BESIDE.search(t, max(0, m.start() - 3), m.start()) or _AFTER.match(t, m.end())):
            continue
        out, last = [], m.start()
        for w in _WORD.finditer(t, m.start(), m.end()):
            new = _NUMBER.get(w[0].lower()) or {"plus": "+", "dash": "-", "hyphen": "-"}.get(w[0].lower(), ".")
            out.append((last, w.end(), new))
            last = w.end()
        yield from out


def _plain(t: str):
    for m in _PLAIN.finditer(t):
        if not (_PLAIN_DOT.search(m[3] + m[4]) or "@" in m[2] and m[2] != "@"):
            continue
        edits = [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(t, m.start(1), m.end(1))]
        edits += [(m.start(2), m.end(2), "@")] if m[2] != "@" else []
        edits += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(t, m.start(3), m.end(4))]
        yield from edits


def deobfuscate(text: str) -> Tape:
    """The normalised tape: look-alikes and odd digits, spelled digits, then disguised at and dot signs."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(list(_characters(tape.text)))
    tape.rewrite(list(_spelled(tape.text)))
    tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    # Bracketed signs count only in an identifier's place: between characters of one.
    for pattern, sign in ((_AT, "@"), (_DOT, ".")) if _SIGNED.search(tape.text) else ():
        t = tape.text
        tape.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(t) if m.start() and m.end() < len(t) and _LOCAL.match(t, m.start() - 1) and _LOCAL.match(t, m.end())])
    if _SPACED.search(tape.text):
        tape.rewrite([(d.start(), d.end(), ".") for m in _SPELLED_IP.finditer(tape.text) for d in _IP_DOT.finditer(tape.text, m.start(), m.end())])
        tape.rewrite(list(_plain(tape.text)))
    return tape


def added(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Source spans that only the deobfuscated text shows."""
    tape = deobfuscate(text)
    if tape.text == text:
        return []
    have = set(base)
    spans = {(tape.a[a], tape.b[b - 1], k) for a, b, k in detect(tape.text)}
    # A span inside a base one of its kind says nothing new.
    return sorted(s for s in spans if s not in have and not any(k == s[2] and a <= s[0] and s[1] <= b for a, b, k in base))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_OUT = pa.schema([("base", pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))), ("added", pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])))])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the arrays pii_base and pii_added of (kind, a, b): code points, b exclusive.

    Nulls and empty texts have no spans. Texts are read whole; repeated rows each for itself. Base
    spans of different kinds may overlap; an added span is dropped where a base one of its kind
    covers it. Columns with those two names are replaced; an empty table stays empty."""
    base = docs.drop("pii_base", "pii_added")
    names = base.columns

    def run(batches):
        row = lambda spans: [{"kind": k, "a": a, "b": b} for a, b, k in spans]
        for b in batches:
            x, y = [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                found = detect(t) if t else []
                x.append(row(found))
                y.append(row(added(t, found)) if t else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, _OUT.field(0).type), pa.array(y, _OUT.field(1).type)], [*names, "pii_base", "pii_added"])

    span = "array<struct<kind:string,a:bigint,b:bigint>>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kinds}, pii_base {span}, pii_added {span}")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""

    def run(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = detect(t) if t else []
                more = added(t, base) if t else []
                rows.append((d, *[sum(k == x for _, _, k in base) for x in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span of text replaced by [KIND]; overlapping spans go by the first and longest."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base = detect(t)
                    end, parts = 0, []
                    for a, e, k in sorted(base + added(t, base), key=lambda s: (s[0], -s[1])):
                        if a >= end:
                            parts += (t[end:a], f"[{k.upper()}]")
                            end = e
                    t = "".join([*parts, t[end:]])
                out.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return op5(table(spark, sf_dir, "documents"))
