"""Version 3 packet streams: typed headers with index maps, records of fixed and ragged fields.

A stream is |Sx||n| and an XML body, then |Hx|id|n| headers and |Pd|id|n| records in any order, with
|Cx| comments and |Ex| exceptions between. A variable's index says which of the dataset's indices it
runs over: a number, * (ragged), ^ (as long as others) or - (the same all along)."""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import properties
from ..operators.vectors import SYSTEMS
from .packets import StreamError

MOST_SETS, MOST_RANK = 100, 8
TAG = re.compile(rb"\s*\|([A-Z][a-z])\|([^|]*)\|(\d+)\|")
COUNT = re.compile(rb"\[([i-p])\|(\d+)\]")
LENGTH = re.compile(rb"\{(\d+)\}")
ROLES = ("center", "min", "max", "width", "mean", "median", "mode", "reference", "offset", "max_error", "min_error", "uncertainty", "std_dev", "point_spread", "weight", "norm")


@dataclass
class Field:
    """How a record holds a variable: items is None for *, size None for *."""

    items: int | None
    size: int | None
    encoding: str
    fill: str | None = None
    value_end: bytes = b""
    run_ends: tuple[bytes, ...] = ()


@dataclass
class Variable:
    dim: str
    role: str
    kind: str
    semantic: str
    storage: str
    units: str
    index: tuple[str, ...]
    parts: int = 1
    system: str = ""
    order: tuple[int, ...] = ()
    frame: str = ""
    axis: str = ""
    field: Field | None = None
    constant: list | None = None
    base: tuple[str, ...] = ()
    steps: tuple[tuple[str, ...], ...] = ()
    props: dict = made(default_factory=dict)

    @property
    def name(self) -> str:
        return self.dim if self.role == "center" else f"{self.dim}_{self.role}"

    @property
    def extents(self) -> list[int | None]:
        """Nested array levels of one record, None for ragged ones."""
        return [int(x) if x.isdigit() else None for x in self.index[1:] if x not in ("-", "")]

    @property
    def components(self) -> tuple[str, ...]:
        known = SYSTEMS.get(self.system, ())
        order = self.order or tuple(range(self.parts))
        return tuple(known[i] if i < len(known) else f"c{i}" for i in order[: self.parts])


@dataclass
class Dataset:
    id: int
    name: str
    index: tuple[str, ...]
    group: str
    props: dict
    variables: list[Variable]

    @property
    def rank(self) -> int:
        return len(self.index)

    @property
    def recorded(self) -> list[Variable]:
        return [v for v in self.variables if v.field]


@dataclass
class Stream:
    props: dict = made(default_factory=dict)
    frames: dict[str, dict] = made(default_factory=dict)
    sets: dict[int, Dataset] = made(default_factory=dict)
    events: list[tuple[str, str, str]] = made(default_factory=list)


def _unescape(s: str) -> bytes:
    return {"\\n": b"\n", "\\r": b"\r", "\\t": b"\t", "\\0": b"\0"}.get(s, s.encode())


def _props(e: ET.Element) -> dict:
    return {p.get("name"): properties.convert(p.get("type", "string"), p.text or "", p.get("units"), p.get("term")) for x in e.findall("properties") for p in x.findall("p")}


def _index(s: str | None, rank: int, where: str) -> tuple[str, ...]:
    out = tuple(x.strip() for x in (s or "*").split(";"))
    if len(out) > rank or not all(re.fullmatch(r"[*^-]|\d+", x) for x in out):
        raise StreamError(f"bad index {s!r} of {where}")
    return out


def _field(e: ET.Element, where: str) -> Field:
    count = lambda a: None if e.get(a, "1") == "*" else int(e.get(a, "1"))
    encoding = e.get("encoding", "utf8")
    if encoding not in ("utf8", "byte", "ubyte", "BEint", "LEint", "BEuint", "LEuint", "BEreal", "LEreal", "blob", "base64"):
        raise StreamError(f"unknown encoding {encoding!r} of {where}")
    if e.get("mime"):
        raise StreamError(f"{where} needs a decoder for {e.get('mime')}")
    ends = tuple(_unescape(x) for x in e.get("idxTerm", "").split(",")) if e.get("idxTerm") else ()
    return Field(count("numItems"), count("itemBytes"), encoding, e.get("fill"), _unescape(e.get("valTerm", "")), ends)


def _variable(e: ET.Element, dim: ET.Element, rank: int) -> Variable:
    name = dim.get("name") or dim.get("physDim") or dim.get("axis") or "var"
    where = f"{name}.{e.get('use', 'center')}"
    role = e.get("use", "center")
    if role not in ROLES:
        raise StreamError(f"unknown role {role!r} of {name}")
    parts = int(e.get("components", 1)) if e.tag == "vector" else 1
    order = tuple(int(x) for x in e.get("sysorder", "").split(";") if x.strip())
    v = Variable(name, role, dim.tag, e.get("semantic", "real"), e.get("storage", ""), e.get("units", ""), _index(e.get("index"), rank, where), parts, e.get("system", "") if parts > 1 else "", order, dim.get("frame", ""), dim.get("axis", ""), props=_props(dim) | _props(e))
    packet, values, steps = e.find("packet"), e.find("values"), e.findall("sequence")
    if packet is not None:
        v.field = _field(packet, where)
        if v.semantic == "integer" and v.field.encoding in ("base64", "blob"):
            raise StreamError(f"{where} is declared integer and encoded {v.field.encoding}")
        _plan(v)
    elif values is not None:
        text = values.text or ""
        v.constant = [_value(v, x) for x in (text.split(";") if v.semantic == "string" and ";" in text else text.split())]
    elif steps:
        v.base = tuple(s.get("minval", "0") for s in steps)
        v.steps = tuple(tuple(s.get("interval", "0").split(";")) for s in steps)
    else:
        raise StreamError(f"{where} has no packet, values or sequence")
    return v


def dataset(k: int, body: bytes) -> Dataset:
    """One |Hx| body."""
    root = _xml(body)
    index = _index(root.get("index"), MOST_RANK, "the dataset")
    if root.get("rank") and int(root.get("rank")) != len(index):
        raise StreamError(f"rank {root.get('rank')} and index {root.get('index')!r} differ")
    found = [_variable(e, dim, len(index)) for dim in root if dim.tag in ("coord", "data") for e in dim if e.tag in ("scalar", "vector")]
    if not found:
        raise StreamError(f"dataset {k} has no variables")
    return Dataset(k, root.get("name") or f"set{k}", index, root.get("groupId") or root.get("name") or "", _props(root), found)


def _xml(body: bytes) -> ET.Element:
    try:
        return ET.fromstring(body.strip())
    except ET.ParseError as e:
        raise StreamError(f"bad header: {e}") from None


def _plan(v: Variable) -> tuple[list[int | None], list[bytes], int]:
    """Extents, terminator of each level (empty: by count) and the innermost ragged level; -1 for none."""
    extents = v.extents
    ragged = [i for i, x in enumerate(extents) if x is None]
    if not ragged:
        return extents, [b""] * len(extents), -1
    deep, ends, by_level = ragged[-1], v.field.run_ends, [b""] * len(extents)
    if ends:
        if len(ends) == len(ragged):
            levels = ragged
        elif len(ends) == deep + 1:
            levels = list(range(deep + 1))
        else:
            raise StreamError(f"{v.name} has {len(ends)} run terminators and needs {len(ragged)} or {deep + 1}")
        for level, end in zip(levels, ends, strict=True):
            by_level[level] = end
    return extents, by_level, deep


def _value(v: Variable, text: str):
    text = text.strip()
    try:
        if v.semantic == "real":
            return float(text)
        if v.semantic == "integer":
            return int(text)
    except ValueError:
        raise StreamError(f"{text!r} is no {v.semantic} value of {v.name}") from None
    if v.semantic == "bool":
        return text.lower() in ("true", "1", "t", "y", "yes")
    return text


_BINARY = {("BEreal", 4): ">f", ("BEreal", 8): ">d", ("LEreal", 4): "<f", ("LEreal", 8): "<d", ("byte", 1): "b", ("ubyte", 1): "B"} | {(f"{e}{s}", n): ("<" if e == "LE" else ">") + c for e in ("LE", "BE") for s, codes in (("int", "bhiq"), ("uint", "BHIQ")) for n, c in zip((1, 2, 4, 8), codes, strict=True)}


class Reader:
    """Fields of one record, in order."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int, what: str) -> bytes:
        if self.at + n > len(self.raw):
            raise StreamError(f"short record at {what}")
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out

    def scalar(self, v: Variable):
        f = v.field
        if f.encoding == "utf8":
            if f.size is not None:
                text = self.take(f.size, v.name)
            elif f.value_end:
                # A run's last value may leave its own end out: the run's terminator, or the record's edge, ends it.
                end, mark = min(((i, e) for e in (f.value_end, *f.run_ends) if (i := self.raw.find(e, self.at)) >= 0), default=(len(self.raw), b""))
                text, self.at = self.raw[self.at : end], end + len(mark) * (mark == f.value_end)
            else:
                m = re.compile(rb"\s*(\S+)").match(self.raw, self.at)
                if not m:
                    raise StreamError(f"short record at {v.name}")
                text, self.at = m[1], m.end()
            out = text.decode().strip()
            if f.fill is not None and (out == f.fill or out == f.fill.strip()):
                return None
            out = _value(v, out)
            return None if v.semantic == "real" and f.fill and out == float(f.fill) else out
        if f.encoding in ("blob", "base64"):
            n = f.size
            if n is None:
                m = LENGTH.match(self.raw, self.at)
                if not m:
                    raise StreamError(f"no length of {v.name}")
                n, self.at = int(m[1]), m.end()
            out = self.take(n, v.name)
            return base64.b64decode(out) if f.encoding == "base64" else out
        code = _BINARY.get((f.encoding, f.size))
        if not code:
            raise StreamError(f"{f.encoding} of {f.size} bytes is unreadable")
        (out,) = struct.unpack(code, self.take(f.size, v.name))
        if f.fill and out == (struct.unpack(code, struct.pack(code, float(f.fill)))[0] if "real" in f.encoding else int(float(f.fill))):
            return None
        return float(out) if v.semantic == "real" else out

    def atom(self, v: Variable):
        if v.parts == 1:
            return self.scalar(v)
        out = tuple(self.scalar(v) for _ in range(v.parts))
        return None if all(x is None for x in out) else out

    def block(self, v: Variable, extents: list[int]):
        return self.atom(v) if not extents else [self.block(v, extents[1:]) for _ in range(extents[0])]

    def variable(self, v: Variable, last: bool):
        extents, ends, deep = _plan(v)
        if deep < 0:
            return self.block(v, extents)
        if any(ends):
            out = self._ended(v, extents, ends, deep, 0, last)
            return out
        if COUNT.match(self.raw, self.at):
            return self._counted(v, extents, deep, 0)
        if not last or deep > 0:
            raise StreamError(f"runs of {v.name} have neither terminators nor counts")
        out = []
        while self.raw[self.at :].strip(b"\n\r" if v.field.encoding == "utf8" else b""):
            out.append(self.block(v, extents[1:]))
        return self._filled(v, out)

    @staticmethod
    def _filled(v: Variable, run: list) -> list:
        if not run:
            raise StreamError(f"an empty run of {v.name}")
        return run

    def _counted(self, v: Variable, extents, deep: int, d: int):
        if extents[d] is not None:
            return [self._counted(v, extents, deep, d + 1) for _ in range(extents[d])]
        m = COUNT.match(self.raw, self.at)
        if not m:
            raise StreamError(f"no count of a run of {v.name}")
        self.at = m.end()
        inner = (lambda: self.block(v, extents[d + 1 :])) if d == deep else (lambda: self._counted(v, extents, deep, d + 1))
        return self._filled(v, [inner() for _ in range(int(m[2]))])

    def _ended(self, v: Variable, extents, ends, deep: int, d: int, last: bool):
        outer = [e for e in ends[:d] if e]
        out = []
        while True:
            here = self.raw[self.at :]
            if ends[d] and here.startswith(ends[d]):
                self.at += len(ends[d])
                break
            if not ends[d] and len(out) == extents[d]:
                break
            # An outer run's end, or the record's for the last variable, also ends this one.
            if out and any(here.startswith(e) for e in outer) or last and not here.strip(b"\r\n"):
                break
            if not here:
                raise StreamError(f"a run of {v.name} has no end")
            out.append(self.block(v, extents[d + 1 :]) if d == deep else self._ended(v, extents, ends, deep, d + 1, last))
        if extents[d] is not None and len(out) != extents[d]:
            raise StreamError(f"{len(out)} runs of {v.name} and {extents[d]} declared")
        return self._filled(v, out)


def packets(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(tag, id, body) of a whole stream, inflated where its header says so; the stream header comes first."""
    at, first = 0, True
    while at < len(data):
        m = TAG.match(data, at)
        if not m:
            if not data[at:].strip():
                return
            raise StreamError(f"unknown tag {data[at : at + 8]!r} at byte {at}")
        tag, size = m[1].decode(), int(m[3])
        if tag[1] == "j":
            raise StreamError("JSON headers aren't supported")
        if first and tag != "Sx":
            raise StreamError("the stream header must come first")
        body = data[m.end() : m.end() + size]
        if len(body) < size:
            raise StreamError(f"short {tag} packet at byte {at}")
        at, first = m.end() + size, False
        yield tag, int(m[2] or 0), body
        if tag == "Sx" and _xml(body).get("compression") in ("deflate", "zlib"):
            data, at = zlib.decompress(data[at:]), 0


def header(s: Stream, tag: str, k: int, body: bytes) -> None:
    """Takes one packet that is no record into the stream."""
    if tag == "Sx":
        root = _xml(body)
        s.props = _props(root) | {"version": root.get("version"), "type": root.get("type")}
        s.frames = {f.get("name"): _props(f) | {"body": f.get("body")} for f in root.findall("frame")}
    elif tag == "Hx":
        if k not in s.sets and len(s.sets) >= MOST_SETS:
            raise StreamError(f"more than {MOST_SETS} datasets")
        s.sets[k] = dataset(k, body)
    elif tag in ("Cx", "Ex"):
        root = _xml(body)
        s.events.append((("comment", "exception")[tag == "Ex"] + ":" + (root.get("type") or root.tag), root.get("source", ""), (root.text or root.get("message", "")).strip()))
    else:
        raise StreamError(f"unknown packet |{tag}|")


def record(d: Dataset, body: bytes) -> list:
    """The recorded variables' values; nulls for fill."""
    r, held = Reader(body), d.recorded
    return [r.variable(v, v is held[-1]) for v in held]


def parse(data: bytes) -> tuple[Stream, list[tuple[int, list]]]:
    """A whole stream in memory: headers and records (id, values)."""
    s, rows = Stream(), []
    for tag, k, body in packets(data):
        if tag != "Pd":
            header(s, tag, k, body)
        elif k not in s.sets:
            raise StreamError(f"record of unknown dataset {k}")
        else:
            rows.append((k, record(s.sets[k], body)))
    return s, rows


def column_type(v: Variable) -> T.DataType:
    """Nested arrays over a record's own indices; vectors as structs by component."""
    atom: T.DataType = {"real": T.DoubleType(), "integer": T.LongType(), "bool": T.BooleanType(), "blob": T.BinaryType()}.get(v.semantic, T.StringType())
    if v.parts > 1:
        atom = T.StructType([T.StructField(c, atom) for c in v.components])
    for _ in v.extents:
        atom = T.ArrayType(atom)
    return atom


def schema(d: Dataset) -> T.StructType:
    """Recorded variables as columns; units, role, frame and the like are their metadata, header constants the first column's."""
    constants = {v.name: {"values": v.constant or [], "base": list(v.base), "steps": [";".join(x) for x in v.steps], "index": list(v.index), "units": v.units} for v in d.variables if not v.field}
    out = []
    for i, v in enumerate(d.recorded):
        meta = {"units": v.units, "role": v.role, "dim": v.dim, "kind": v.kind, "index": list(v.index), "frame": v.frame, "system": v.system, "semantic": v.semantic, "props": {k: str(x) for k, x in v.props.items()}}
        if i == 0:
            meta |= {"constants": constants, "dataset": d.name, "group": d.group}
        out.append(T.StructField(v.name, column_type(v), True, meta))
    return T.StructType(out)


def headers(spark: SparkSession, path: str) -> dict[int, Dataset]:
    """Datasets of all streams at path: executors read the files, distinct header texts (at most 100 a stream) reach the driver.

    Files whose headers of one id differ raise."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = [(k, body) for tag, k, body in packets(raw) if tag == "Hx"]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["id", "body"])

    found: dict[int, bytes] = {}
    for r in files.mapInArrow(run, "id long, body binary").distinct().collect():
        if found.setdefault(r["id"], r["body"]) != r["body"]:
            raise StreamError(f"dataset {r['id']} has several headers; read such files apart")
    return {k: dataset(k, bytes(x)) for k, x in sorted(found.items())}


def decode(spark: SparkSession, path: str, sets: dict[int, Dataset] | None = None, files: DataFrame | None = None) -> tuple[DataFrame, dict[int, Dataset]]:
    """One frame of all records, set (id) and a struct column per dataset, decoded once; and the datasets.

    files may give the streams' bytes in its column content, unbounded too."""
    sets = headers(spark, path) if sets is None else sets
    files = spark.read.format("binaryFile").load(path).select("content") if files is None else files.select("content")
    kind = T.StructType([T.StructField("set", T.LongType()), *[T.StructField(f"d{k}", schema(d)) for k, d in sets.items()]])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows: list[dict] = []
                for tag, k, body in packets(raw):
                    if tag == "Pd" and k in sets:
                        rows.append({"set": k, f"d{k}": {v.name: _plain(v, x, len(v.extents)) for v, x in zip(sets[k].recorded, record(sets[k], body), strict=True)}})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, kind), sets


def _plain(v: Variable, x, depth: int):
    """Vectors as records by component."""
    if v.parts == 1 or x is None:
        return x
    return [_plain(v, y, depth - 1) for y in x] if depth else dict(zip(v.components, x, strict=True))


def read(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    """A frame per dataset; calendar values become timestamps."""
    return _frames(*decode(spark, path))


def follow(spark: SparkSession, path: str, sets: dict[int, Dataset] | None = None, per_batch: int = 100) -> dict[int, DataFrame]:
    """A streaming frame per dataset of the files that come to a folder, at most per_batch of them a batch.

    sets are the datasets to expect, those of the files already there by default; records of others are left out."""
    sets = headers(spark, path) if sets is None else sets
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(path)
    return _frames(*decode(spark, path, sets, files))


def _frames(rows: DataFrame, sets: dict[int, Dataset]) -> dict[int, DataFrame]:
    out = {}
    for k, d in sets.items():
        s = schema(d)
        cols = []
        for f, v in zip(s.fields, d.recorded, strict=True):
            c = F.col(f"d{k}").getField(f.name)
            cols.append((F.to_timestamp_ntz(c) if v.semantic == "datetime" and not v.extents else c).alias(f.name, metadata=f.metadata))
        out[k] = rows.where(F.col("set") == k).select(*cols)
    return out


def sequence(v: Variable, at: tuple[int, ...]):
    """A sequence variable's value at an index: base plus each step times its index."""
    out = []
    for base, steps in zip(v.base, v.steps, strict=True):
        out.append(float(base) + sum(float(m) * i for m, i in zip(steps, at, strict=True) if m.strip() not in ("-", "")))
    return out[0] if len(out) == 1 else tuple(out)
