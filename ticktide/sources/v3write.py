"""Version 3 packet streams written: headers, records with ragged runs, comments and exceptions."""

from __future__ import annotations

import base64
import struct
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.properties import text
from .files import write_bytes
from .packets import StreamError
from .v3 import _BINARY, Dataset, Field, Variable, _plan


def packet(tag: str, k: int | None, body: bytes) -> bytes:
    return f"|{tag}|{'' if k is None else k}|{len(body)}|".encode() + body


def _properties(props: dict, indent: str) -> str:
    if not props:
        return ""
    rows = []
    for name, v in props.items():
        units = ""
        if isinstance(v, tuple) and len(v) == 2 and isinstance(v[1], str) and not isinstance(v[0], str):
            v, units = v[0], f" units={quoteattr(v[1])}"
        kind = "Array" if isinstance(v, list) else "Range" if isinstance(v, tuple) else ""
        one = v[0] if kind and v else v
        base = "bool" if isinstance(one, bool) else "integer" if isinstance(one, int) else "real" if isinstance(one, float) else "string"
        out = ";".join(map(text, v)) + ";" if kind == "Array" else " to ".join(map(text, v)) if kind else text(v)
        rows.append(f'{indent}  <p name={quoteattr(name)} type="{base}{kind}"{units}{" term=" + quoteattr(";") if kind == "Array" else ""}>{escape(out)}</p>')
    return f"{indent}<properties>\n" + "\n".join(rows) + f"\n{indent}</properties>\n"


def stream_header(props: dict | None = None, frames: dict[str, dict] | None = None, compression: str = "none", source: str = "ticktide") -> bytes:
    """The |Sx| packet; the source id is added where there is none."""
    given = {"sourceId": source} | {k: v for k, v in (props or {}).items() if k not in ("version", "type")}
    inside = "".join(f"  <frame name={quoteattr(n)} body={quoteattr(str(p.get('body', '')))}>\n{_properties({k: v for k, v in p.items() if k != 'body'}, '    ')}  </frame>\n" for n, p in (frames or {}).items())
    squeeze = "" if compression == "none" else f' compression="{compression}"'
    return packet("Sx", None, f'<stream type="das-basic-stream" version="3.0"{squeeze}>\n{_properties(given, "  ")}{inside}</stream>\n'.encode())


_NAMES = {b"\n": "\\n", b"\r": "\\r", b"\t": "\\t", b"\0": "\\0"}


def _name(end: bytes) -> str:
    return _NAMES.get(end, end.decode())


def dataset_header(d: Dataset) -> bytes:
    """The |Hx| packet of a dataset, its variables in order."""
    out = [f'<dataset name={quoteattr(d.name)} rank="{d.rank}" index="{";".join(d.index)}" groupId={quoteattr(d.group or d.name)}>\n{_properties(d.props, "  ")}']
    for v in d.variables:
        frame, axis = (f" {n}={quoteattr(x)}" if x else "" for n, x in (("frame", v.frame), ("axis", v.axis)))
        kind = "vector" if v.parts > 1 else "scalar"
        vec = f' components="{v.parts}" system="{v.system}" sysorder="{";".join(map(str, v.order or range(v.parts)))}"' if v.parts > 1 else ""
        storage = f' storage="{v.storage}"' if v.storage else ""
        out.append(f'  <{v.kind} physDim={quoteattr(v.dim)} name={quoteattr(v.dim)}{frame}{axis}>\n    <{kind}{vec} use="{v.role}" semantic="{v.semantic}"{storage} index="{";".join(v.index)}" units={quoteattr(v.units)}>\n{_properties(v.props, "      ")}')
        if f := v.field:
            star = lambda x: "*" if x is None else str(x)
            fill = "" if f.fill is None else f" fill={quoteattr(f.fill)}"
            ends = (f" valTerm={quoteattr(_name(f.value_end))}" if f.value_end else "") + (f" idxTerm={quoteattr(','.join(map(_name, f.run_ends)))}" if f.run_ends else "")
            out.append(f'      <packet numItems="{star(f.items)}" itemBytes="{star(f.size)}" encoding="{f.encoding}"{ends}{fill}/>\n')
        elif v.constant is not None:
            out.append("      <values>" + escape(" ".join(map(str, v.constant))) + "</values>\n")
        else:
            out += [f'      <sequence minval="{b}" interval="{";".join(s)}"/>\n' for b, s in zip(v.base, v.steps, strict=True)]
        out.append(f"    </{kind}>\n  </{v.kind}>\n")
    return packet("Hx", d.id, ("".join(out) + "</dataset>\n").encode())


def comment(kind: str, source: str, message: str) -> bytes:
    return packet("Cx", None, f"<comment type={quoteattr(kind)} source={quoteattr(source)}>{escape(message)}</comment>\n".encode())


def exception(kind: str, message: str) -> bytes:
    return packet("Ex", None, f"<exception type={quoteattr(kind)}>{escape(message)}</exception>\n".encode())


def _number(x: float, size: int | None) -> str:
    """Exponent form with as many digits as fit a blank before them, else the shortest form."""
    if size is None:
        return f"{x:.6e}"
    for digits in range(max(0, size - 8), -1, -1):
        if len(s := f"{x:.{digits}e}") < size:
            return s
    for digits in range(size, 0, -1):
        if len(s := f"{x:.{digits}g}") < size:
            return s
    raise StreamError(f"{x!r} doesn't fit {size} bytes")


def _scalar(v: Variable, x) -> bytes:
    f = v.field
    if f.encoding == "utf8":
        if x is None:
            s = f.fill if f.fill is not None else "-1e31" if v.semantic == "real" else ""
        elif v.semantic == "real":
            s = _number(x, f.size)
        elif v.semantic == "bool":
            s = "true" if x else "false"
        else:
            s = str(x)
        raw = s.encode()
        if f.size is not None:
            if len(raw) > f.size:
                if v.semantic not in ("datetime", "real"):
                    raise StreamError(f"{s!r} doesn't fit {f.size} bytes of {v.name}")
                raw = _number(float(s), f.size).encode() if v.semantic == "real" else raw[: f.size]
            return raw.rjust(f.size) if v.semantic in ("real", "integer") else raw.ljust(f.size)
        if f.value_end:
            if f.value_end in raw or any(e and raw.startswith(e) for e in f.run_ends):
                raise StreamError(f"{s!r} holds a terminator of {v.name}")
            return raw + f.value_end
        return b" " + raw
    if f.encoding in ("blob", "base64"):
        raw = bytes(x or b"")
        raw = base64.b64encode(raw) if f.encoding == "base64" else raw
        return raw if f.size is not None else f"{{{len(raw)}}}".encode() + raw
    code = _BINARY[f.encoding, f.size]
    if x is None:
        x = float(f.fill) if f.fill else -1e31 if "real" in f.encoding else 0
    return struct.pack(code, x if "real" in f.encoding else int(x))


def _atom(v: Variable, x) -> bytes:
    return _scalar(v, x) if v.parts == 1 else b"".join(_scalar(v, c) for c in (x if x is not None else [None] * v.parts))


def variable(v: Variable, x, last: bool) -> bytes:
    """The bytes of one variable in a record: runs end by terminators, else have counts; the last one's single run may just end."""
    extents, ends, deep = _plan(v)
    counted = deep >= 0 and not any(ends) and not (last and deep == 0)

    def put(y, d: int) -> bytes:
        if d == len(extents):
            return _atom(v, y)
        if extents[d] is not None and len(y) != extents[d]:
            raise StreamError(f"{len(y)} items of {v.name} at index {d + 1} and {extents[d]} declared")
        if d <= deep and not len(y):
            raise StreamError(f"an empty run of {v.name}")
        inside = b"".join(put(z, d + 1) for z in y)
        if counted and extents[d] is None:
            return f"[{'ijklmnop'[d + 1]}|{len(y)}]".encode() + inside
        return inside + (ends[d] if d <= deep else b"")

    return put(x, 0)


def record(d: Dataset, values: list) -> bytes:
    """One |Pd| packet; None is fill."""
    held = d.recorded
    return packet("Pd", d.id, b"".join(variable(v, x, v is held[-1]) for v, x in zip(held, values, strict=True)))


def as_text(d: Dataset, digits: int = 6, second_digits: int = 3) -> Dataset:
    """The dataset with all fields as text: what a binary stream becomes when it is made readable.

    Ragged runs get terminators if they have none; text fields stay as they are, so doing it twice
    changes nothing."""
    from dataclasses import replace

    out = []
    for v in d.variables:
        f = v.field
        if f and f.encoding not in ("utf8", "base64"):
            ragged = sum(x is None for x in v.extents)
            size = 20 + second_digits + 1 if v.semantic == "datetime" else digits + 9 if v.semantic == "real" else 21
            f = Field(f.items, None, "base64", f.fill) if f.encoding == "blob" else Field(f.items, size, "utf8", f.fill, b"", f.run_ends or tuple(b"!$%&;"[i : i + 1] for i in range(ragged)))
        elif f and f.items is None and not f.run_ends and v.extents != [None]:
            f = replace(f, run_ends=tuple(b"!$%&;"[i : i + 1] for i in range(sum(x is None for x in v.extents))))
        out.append(replace(v, field=f))
    return replace(d, variables=out)


def write(frames: dict[int, DataFrame], sets: dict[int, Dataset], path: str, props: dict | None = None, frames_of: dict[str, dict] | None = None, compression: str = "none") -> None:
    """A folder of streams, one file for each partition with records, whole in itself; columns are those of v3.read."""
    tables = b"".join(dataset_header(sets[k]) for k in frames)
    parts = None
    for k, df in frames.items():
        held = sets[k].recorded
        cols = [F.date_format(f"`{v.name}`", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(v.name) if dict(df.dtypes)[v.name].startswith("timestamp") else F.col(f"`{v.name}`") for v in held]

        def encode(batches, d=sets[k]):
            import pyarrow as pa

            for b in batches:
                rows = zip(*[[_tuples(v, x) for x in c.to_pylist()] for v, c in zip(d.recorded, b.columns, strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([record(d, list(r)) for r in rows], pa.binary())], ["value"])

        part = df.select(*cols).mapInArrow(encode, "value binary")
        parts = part if parts is None else parts.unionByName(part)
    write_bytes(parts, path, ".d3t", stream_header(props, frames_of, compression), tables, compression != "none")


def _tuples(v: Variable, x):
    if v.parts == 1 or x is None:
        return x
    return [_tuples(v, y) for y in x] if isinstance(x, list) else tuple(x[c] for c in v.components)
