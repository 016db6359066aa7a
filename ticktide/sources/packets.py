"""Version 2 packet streams: a reader of tagged packets, text or binary, and a writer of the same form.

The stream opens with a header packet [00], each record type with a header packet [NN], both with a
six-digit length and an XML body; records follow as :NN: and fixed-width fields, comments and
exceptions as [xx]. An id whose header comes again begins a new version of its type."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zlib
from dataclasses import asdict, dataclass, field
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions.expressions import is_fill
from .files import write_bytes

MOST_TYPES, MOST_PLANES = 100, 100


class StreamError(ValueError):
    """A malformed stream."""


@dataclass
class Plane:
    kind: str
    name: str
    width: int
    items: int = 1
    units: str = ""
    fill: float = -1e31
    time: bool = False
    tags: list[float] = field(default_factory=list)
    encoding: str = "ascii"
    props: dict = field(default_factory=dict)
    unnamed: bool = False

    @property
    def numpy(self) -> str | None:
        """The type of binary items; None for text."""
        return {"be": ">", "le": "<"}[self.encoding] + f"f{self.width}" if self.encoding in ("be", "le") else None


@dataclass
class Packet:
    planes: list[Plane]

    @property
    def width(self) -> int:
        return sum(p.width * p.items for p in self.planes)


@dataclass
class Stream:
    """Properties, record types by (id, version), records (id, version, fields), and comments (type, source, text)."""

    props: dict = field(default_factory=dict)
    types: dict[tuple[int, int], Packet] = field(default_factory=dict)
    rows: list[tuple[int, int, list]] = field(default_factory=list)
    events: list[tuple[str, str, str]] = field(default_factory=list)


_REAL = {"sun_real4": ("be", 4), "float": ("be", 4), "sun_real8": ("be", 8), "double": ("be", 8), "little_endian_real4": ("le", 4), "little_endian_real8": ("le", 8)}


def _plane(e: ET.Element, unnamed: str) -> Plane:
    kind = e.tag.lower()
    encoding, width = _REAL.get(e.get("type", ""), ("", 0))
    if not encoding:
        form = re.fullmatch(r"(ascii|time)(\d+)", e.get("type", ""))
        if not form or not 2 <= int(form[2]) <= 127:
            raise StreamError(f"unreadable type {e.get('type')!r}")
        encoding, width = form[1], int(form[2])
    props = {k.rpartition(":")[2]: v for x in e.iter("properties") for k, v in x.attrib.items()}
    fill = float(props.get("zFill" if kind in ("z", "yscan") else "yFill", props.get("fill", -1e31)))
    items = int(e.get("nitems", 1)) if kind == "yscan" else 1
    tags: list[float] = []
    if kind == "yscan":
        listed = [float(v) for v in re.split(r"[,\s]+", e.get("yTags", "").strip()) if v]
        step = e.get("yTagInterval")
        if listed or step:
            tags = arrays.tags(listed, float(e.get("yTagMin", 0)), float(step or 0), items)
        elif e.get("yTagMax"):
            low, high = float(e.get("yTagMin", 0)), float(e.get("yTagMax"))
            tags = arrays.tags(None, low, (high - low) / max(1, items - 1), items)
    units = e.get("zUnits" if kind == "yscan" else "units", "")
    return Plane(kind, e.get("name") or unnamed, width, items, units, fill, encoding == "time", tags, encoding, props)


def _planes(root: ET.Element) -> list[Plane]:
    """Unnamed planes have their kind for a name; names that clash get their place too."""
    out: list[Plane] = []
    for e in root:
        kind = e.tag.lower()
        if kind in ("x", "y", "z", "yscan"):
            p = _plane(e, kind)
            p.unnamed = not e.get("name")
            if any(p.name.lower() == o.name.lower() for o in out):
                p.name = f"{p.name}_{len(out)}"
            out.append(p)
    return out


def packets(data: bytes):
    """(tag, id, body) of a whole stream; tag is header, type, event or record. Record bodies need the types, so they come by send()."""
    at, widths = 0, {}
    while at < len(data):
        tag = data[at : at + 4]
        if m := re.fullmatch(rb"\[(\d\d|xx)\]", tag):
            try:
                size = int(data[at + 4 : at + 10])
            except ValueError:
                raise StreamError(f"bad length at byte {at}") from None
            body = data[at + 10 : at + 10 + size]
            at += 10 + size
            if m[1] == b"xx":
                yield "event", -1, _xml(body)
                continue
            root = _xml(body)
            if m[1] == b"00":
                yield "header", 0, root
                if root.get("compression") in ("deflate", "zlib"):
                    data, at = zlib.decompress(data[at:]), 0
            else:
                k, planes = int(m[1]), _planes(root)
                if not planes or len(planes) > MOST_PLANES or len(widths) >= MOST_TYPES:
                    raise StreamError("too many or no planes or packet types")
                widths[k] = Packet(planes)
                yield "type", k, widths[k]
        elif m := re.fullmatch(rb":(\d\d):", tag):
            k = int(m[1])
            if k not in widths:
                raise StreamError(f"record of unknown type {k} at byte {at}")
            raw = data[at + 4 : at + 4 + widths[k].width]
            if len(raw) < widths[k].width:
                raise StreamError(f"short record at byte {at}")
            at += 4 + len(raw)
            yield "record", k, raw
        elif tag.strip() == b"":
            break
        else:
            raise StreamError(f"unknown tag {tag!r} at byte {at}")


def _xml(body: bytes) -> ET.Element:
    try:
        return ET.fromstring(re.sub(rb"(<[/]?)\w+:", rb"\1", re.sub(rb"(\s)(\w+):(\w+)=", rb"\1\3=", body)).strip())
    except ET.ParseError as e:
        raise StreamError(f"bad header: {e}") from None


def parse_stream(data: bytes, keep_events: bool = True, progress: bool = True) -> Stream:
    """A whole stream in memory.

    keep_events off drops comments and exceptions, progress off those on task size and progress
    only. More than the allowed types or planes, unknown tags and short records raise."""
    s, version = Stream(), {}
    for tag, k, body in packets(data):
        if tag == "header":
            s.props = {n: v for x in body.iter("properties") for n, v in x.attrib.items()} | dict(body.attrib)
        elif tag == "type":
            if k not in version or s.types[k, version[k]] != body:
                version[k] = version.get(k, -1) + 1
            s.types[k, version[k]] = body
        elif tag == "event":
            kind = body.get("type", body.tag)
            if keep_events and (progress or kind not in ("taskProgress", "taskSize")):
                s.events.append((kind, body.get("source", ""), body.get("value") or body.get("message") or ""))
        else:
            s.rows.append((k, version[k], _fields(s.types[k, version[k]], body)))
    return s


def parse(data: bytes) -> tuple[dict[str, str], dict[int, Packet], list[tuple[int, list]]]:
    """Stream properties, the last version of each packet type by id, and the records (id, fields)."""
    s = parse_stream(data)
    return s.props, {k: p for (k, _), p in sorted(s.types.items())}, [(k, f) for k, _, f in s.rows]


def _fields(packet: Packet, raw: bytes) -> list:
    out, at = [], 0
    for p in packet.planes:
        cut = raw[at : at + p.width * p.items]
        at += len(cut)
        if p.numpy:
            cells = np.frombuffer(cut, p.numpy).astype(float).tolist()
        else:
            text = cut.decode()
            cells = [text[i * p.width : (i + 1) * p.width].strip() for i in range(p.items)]
            cells = cells if p.time else list(map(float, cells))
        out.append(cells if p.kind == "yscan" else cells[0])
    return out


def schema(packet: Packet) -> T.StructType:
    """Columns of a packet type, units, fill, role and tags in their metadata."""
    cols = []
    for p in packet.planes:
        kind = T.StringType() if p.time else T.ArrayType(T.DoubleType()) if p.kind == "yscan" else T.DoubleType()
        cols.append(T.StructField(p.name, kind, True, {"units": p.units, "fill": p.fill, "role": p.kind, "tags": p.tags, "unnamed": p.unnamed}))
    return T.StructType(cols)


def default_names(df: DataFrame) -> DataFrame:
    """df with its unnamed columns as time, Y_1, Z_1, YSCAN_1 and so on, by place among those of their kind."""
    seen: dict[str, int] = {}
    cols = []
    for f in df.schema.fields:
        kind = f.metadata.get("role", "")
        seen[kind] = seen.get(kind, 0) + 1
        given = ("time" if seen[kind] == 1 else f"X_{seen[kind]}") if kind == "x" else f"{kind.upper()}_{seen[kind]}"
        cols.append(F.col(f"`{f.name}`").alias(given if f.metadata.get("unnamed") else f.name, metadata=f.metadata))
    return df.select(*cols)


def _cleared(fill: float):
    return lambda v: F.when(~is_fill(v, fill), v)


def _number(digits: int, fill: float):
    return lambda c: F.lpad(F.format_string(f"%.{digits}e", F.coalesce(c.cast("double"), F.lit(fill))), digits + 8, " ")


def heads(spark: SparkSession, path: str | list[str]) -> dict[tuple[int, int], Packet]:
    """Record types by (id, version) over all streams at path.

    Executors read the files; of each stream only its type headers reach the driver, equal ones once.
    A type that differs between streams gets the next version."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(1).to_pylist():
                got = [(k, json.dumps(asdict(p), sort_keys=True)) for (k, _), p in parse_stream(raw).types.items()]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], ["id", "type"])

    out: dict[tuple[int, int], Packet] = {}
    for r in files.mapInArrow(run, "id long, type string").distinct().orderBy("id", "type").collect():
        p = Packet([Plane(**x) for x in json.loads(r["type"])["planes"]])
        out[r["id"], sum(k == r["id"] for k, _ in out)] = p
    return out


def decode(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, dict[tuple[int, int], Packet]]:
    """One frame of all records, decoded once: type (id), version and a struct column per type; and the types."""
    types = heads(spark, path)
    name = lambda k: f"p{k[0]}_{k[1]}"
    kind = T.StructType([T.StructField("type", T.LongType()), T.StructField("version", T.LongType()), *[T.StructField(name(k), schema(p)) for k, p in types.items()]])
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            for raw in b.column(0).to_pylist():
                s = parse_stream(raw)
                at = {(k, v): next(w for (j, w), q in types.items() if j == k and q == p) for (k, v), p in s.types.items()}
                rows = []
                for k, v, f in s.rows:
                    w = at[k, v]
                    rows.append({"type": k, "version": w, name((k, w)): dict(zip([p.name for p in types[k, w].planes], f, strict=True))})
                for i in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 1000], arrow)

    return files.mapInArrow(run, kind), types


def read(spark: SparkSession, path: str | list[str], only: int | None = None) -> dict[int, DataFrame]:
    """A frame per packet type of all streams at path; fill becomes null.

    Further versions of a type have its id plus 100 for each. only selects one id."""
    rows, types = decode(spark, path)
    out = {}
    for (k, v), packet in types.items():
        if only is not None and k != only:
            continue
        cols = []
        for f in schema(packet).fields:
            fill, at = f.metadata["fill"], F.col(f"p{k}_{v}").getField(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.metadata["role"] != "x":
                at = F.when(~is_fill(at, fill), at)
            elif isinstance(f.dataType, T.ArrayType):
                at = F.transform(at, _cleared(fill))
            cols.append(at.alias(f.name, metadata=f.metadata))
        out[k + 100 * v] = rows.where((F.col("type") == k) & (F.col("version") == v)).select(*cols)
    return out


def stream_header(props: dict | None = None, compression: str = "none", source: str = "ticktide") -> bytes:
    """The [00] packet; the source id is added where there is none."""
    given = {"sourceId": source} | (props or {})
    attrs = "".join(f" {k}={quoteattr(str(v))}" for k, v in given.items() if k not in ("version", "compression"))
    return _tagged("00", f'<stream compression="{compression}" version="2.2">\n  <properties{attrs}/>\n</stream>\n')


def packet_header(k: int, packet: Packet) -> bytes:
    """The [NN] packet of a type."""
    out = []
    for p in packet.planes:
        name = {"ascii": f"ascii{p.width}", "time": f"time{p.width}", "be": f"sun_real{p.width}", "le": f"little_endian_real{p.width}"}[p.encoding]
        unit = f" yTags={quoteattr(','.join(map(repr, p.tags)))} nitems={quoteattr(str(p.items))} zUnits={quoteattr(p.units)}" if p.kind == "yscan" else f" units={quoteattr(p.units)}"
        fills = "" if p.kind == "x" else f" {'zFill' if p.kind in ('z', 'yscan') else 'yFill'}={quoteattr(repr(p.fill))}"
        own = "".join(f" {n}={quoteattr(v)}" for n, v in p.props.items() if n not in ("zFill", "yFill"))
        out.append(f'  <{p.kind} name={quoteattr(p.name)} type="{name}"{unit}>\n    <properties{fills}{own}/>\n  </{p.kind}>\n')
    return _tagged(f"{k:02d}", "<packet>\n" + "".join(out) + "</packet>\n")


def _tagged(tag: str, body: str) -> bytes:
    raw = body.encode()
    return f"[{tag}]{len(raw):06d}".encode() + raw


def event(kind: str, source: str, message: str, exception: bool = False) -> bytes:
    """A comment or exception packet."""
    what = f"exception type={quoteattr(kind)} message" if exception else f"comment type={quoteattr(kind)} source={quoteattr(source)} value"
    return _tagged("xx", f"<{what}={quoteattr(message)}/>\n")


def no_data(begin: str, end: str, source: str = "ticktide") -> bytes:
    return event("NoDataInInterval", source, f"No data in interval {begin} to {end}", exception=True)


def query_error(message: str) -> bytes:
    return event("IllegalArgument", "ticktide", message, exception=True)


def server_error(message: str) -> bytes:
    return event("ServerError", "ticktide", message, exception=True)


def progress(done: int, source: str = "ticktide") -> bytes:
    return event("taskProgress", source, str(done))


def record(k: int, packet: Packet, values: list) -> bytes:
    """One :NN: record; None is the plane's fill, and a text field that doesn't fit raises."""
    out = [f":{k:02d}:".encode()]
    for p, v in zip(packet.planes, values, strict=True):
        cells = list(v) if p.kind == "yscan" else [v]
        if len(cells) != p.items:
            raise StreamError(f"{len(cells)} items for {p.name}, which has {p.items}")
        if p.numpy:
            out.append(np.array([p.fill if c is None else c for c in cells], p.numpy).tobytes())
            continue
        for i, c in enumerate(cells):
            if p.time:
                text = str(c).ljust(p.width)
            else:
                text = f"{p.fill if c is None else c:.{max(0, p.width - 8)}e}".rjust(p.width - 1) + " "
            if p is packet.planes[-1] and i == len(cells) - 1:
                text = text[:-1] + "\n" if text[-1] == " " else text
            if len(text) != p.width:
                raise StreamError(f"{c!r} doesn't fit {p.width} characters of {p.name}")
            out.append(text.encode())
    return b"".join(out)


def packet_of(df: DataFrame, digits: int = 5, second_digits: int = 3, binary: bool = False) -> Packet:
    """A record type for a frame: times and strings as text, numbers as text of so many digits or as doubles."""
    planes = []
    for i, f in enumerate(df.schema.fields):
        scan = isinstance(f.dataType, T.ArrayType)
        timed = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.StringType))
        kind = f.metadata.get("role") if f.metadata.get("role") in ("x", "y", "z", "yscan") else "yscan" if scan else "x" if i == 0 else "y"
        tags = [float(x) for x in f.metadata.get("tags", [])]
        if scan and not tags:
            raise StreamError(f"{f.name} has no tags in its metadata, which give its length")
        encoding, width = ("time", 20 + (second_digits + 1 if second_digits else 0)) if timed else ("be", 8) if binary else ("ascii", digits + 9)
        planes.append(Plane(kind, f.name, width, len(tags) if scan else 1, f.metadata.get("units", "UTC" if timed else ""), float(f.metadata.get("fill", -1e31)), timed, tags, encoding))
    return Packet(planes)


def write(frames: dict[int, DataFrame], path: str, props: dict | None = None, digits: int = 5, second_digits: int = 3, binary: bool = False, compression: str = "none") -> None:
    """A folder of streams, one file a partition, each whole in itself: headers, then the partition's records.

    Executors encode; order within a partition is kept, so range-partition by time for files that
    follow each other. compression "deflate" deflates what follows the stream header."""
    types = {k: packet_of(df, digits, second_digits, binary) for k, df in frames.items()}
    head = stream_header(props, compression)
    tables = b"".join(packet_header(k, p) for k, p in types.items())
    parts = None
    for k, df in frames.items():
        cols = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * second_digits if second_digits else "")).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`") for f in df.schema.fields]

        def encode(batches, k=k, packet=types[k]):
            import pyarrow as pa

            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array([record(k, packet, list(r)) for r in zip(*cols, strict=True)], pa.binary())], ["value"])

        part = df.select(*cols).mapInArrow(encode, "value binary")
        parts = part if parts is None else parts.unionByName(part)
    write_bytes(parts, path, ".d2t", head, tables, compression == "deflate")


def render(df: DataFrame, order: list, digits: int = 5) -> DataFrame:
    """One text line a record, each partition a range of order: fields of fixed width, null as the column's fill."""
    cells = []
    for f in df.schema.fields:
        fill = float(f.metadata.get("fill", -1e31))
        number = _number(digits, fill)
        if isinstance(f.dataType, T.ArrayType):
            cells.append(F.array_join(F.transform(f.name, number), " "))
        elif isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType)):
            cells.append(F.col(f.name).cast("string"))
        else:
            cells.append(number(F.col(f.name)))
    return df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws(" ", *cells).alias("value"))
