"""Archive layout: frames as named variables with global and own attributes, each index with the variable it depends on."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timescales import tt2000
from ..plans import indices

#: Attributes by the property that gives them.
ATTRIBUTES = {"label": "LABLAXIS", "summary": "CATDESC", "info": "VAR_NOTES", "description": "CATDESC", "title": "TITLE", "units": "UNITS", "fill": "FILLVAL", "validMin": "VALIDMIN", "validMax": "VALIDMAX", "scaleMin": "SCALEMIN", "scaleMax": "SCALEMAX", "scaleType": "SCALETYP", "format": "FORMAT", "compLabel": "LABL_PTR_1", "frame": "COORDINATE_SYSTEM"}
GLOBALS = {"title": "TITLE", "sourceId": "Generated_by", "Mission_group": "Mission_group", "Discipline": "Discipline", "instrument": "Instrument", "summary": "TEXT"}


def attribute(name: str, scope: str = "variable") -> str:
    """An attribute's name for a property; unknown ones keep theirs with signs made _."""
    table = ATTRIBUTES if scope == "variable" else GLOBALS
    return table.get(name) or re.sub(r"\W", "_", name)


def rename_map(text: str) -> dict[str, str]:
    """packet/variable to name lines of a configuration, # for comments; a name given twice raises."""
    out: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(\S+)\s*(?:=|:|\s)\s*(\S+)", line)
        if not m:
            raise ValueError(f"line {n}: {line!r}")
        if m[2] in out.values():
            raise ValueError(f"line {n}: {m[2]!r} is taken")
        out[m[1]] = m[2]
    return out


def variable_name(packet: str, column: str, names: Mapping[str, str], several: bool) -> str:
    """The given name of packet/column or of column, else the column's, with the packet's before it where there are several."""
    plain = re.sub(r"\W", "_", column)
    return names.get(f"{packet}/{column}") or names.get(column) or (f"{packet}_{plain}" if several else plain)


def layout(frames: Mapping[str, DataFrame], names: Mapping[str, str] | None = None, props: Mapping[str, str] | None = None) -> dict:
    """Variables of all frames with kind, dependences and attributes, and the global attributes; a JSON-ready description.

    Coordinates are the columns whose metadata says kind coord or role x, else the first; which one
    an index depends on is solved from their indices."""
    out = {"globals": {attribute(k, "global"): v for k, v in (props or {}).items()}, "variables": {}}
    for packet, df in frames.items():
        fields = {f.name: f for f in df.schema.fields}
        shape = {n: tuple(f.metadata.get("index") or ["*", *["*"] * _rank(f.dataType)]) for n, f in fields.items()}
        coords = {n: s for n, s in shape.items() if fields[n].metadata.get("kind") == "coord" or fields[n].metadata.get("role") == "x"} or {next(iter(fields)): shape[next(iter(fields))]}
        rank = max(len(s) for s in shape.values())
        depends = indices.solve_depends(coords, rank)
        constants = next((f.metadata["constants"] for f in fields.values() if f.metadata.get("constants")), {})
        for n, f in fields.items():
            meta = f.metadata
            attrs = {attribute(k): v for k, v in (meta.get("props") or {}).items()} | {k: meta[m] for m, k in (("units", "UNITS"), ("fill", "FILLVAL"), ("frame", "COORDINATE_SYSTEM")) if meta.get(m) not in (None, "")}
            attrs["VAR_TYPE"] = "support_data" if n in coords else "data"
            mine = indices.depends_on(shape[n])
            attrs |= {f"DEPEND_{k}": variable_name(packet, depends[i], names or {}, len(frames) > 1) for k, i in enumerate(mine) if i in depends and depends[i] != n}
            if isinstance(_inner(f.dataType), T.StructType):
                attrs["REPRESENTATION_1"] = list(_inner(f.dataType).names)
            out["variables"][variable_name(packet, n, names or {}, len(frames) > 1)] = {"packet": packet, "column": n, "type": "CDF_TIME_TT2000" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else _inner(f.dataType).simpleString(), "attributes": attrs}
        for n, c in constants.items():
            out["variables"][variable_name(packet, n, names or {}, len(frames) > 1)] = {"packet": packet, "column": None, "type": "double", "values": c, "attributes": {"VAR_TYPE": "support_data", "UNITS": c.get("units", "")}}
    return out


def _inner(kind: T.DataType) -> T.DataType:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def _rank(kind: T.DataType) -> int:
    return 1 + _rank(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def export(frames: Mapping[str, DataFrame], path: str, names: Mapping[str, str] | None = None, props: Mapping[str, str] | None = None) -> dict:
    """A Parquet folder per packet with variables under their archive names, times as TT2000 nanoseconds, and layout.json's contents returned.

    The description is written as one text row by the cluster, so no machine's own disk is used."""
    found = layout(frames, names, props)
    spark = None
    for packet, df in frames.items():
        spark = df.sparkSession
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            c = tt2000(c) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else c
            cols.append(c.alias(variable_name(packet, f.name, names or {}, len(frames) > 1)))
        df.select(*cols).write.mode("overwrite").parquet(f"{path}/{packet}")
    if spark is not None:
        spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")
    return found


_SPEC = re.compile(r"(?P<name>[A-Za-z_]\w*)(?:,(?P<rest>.*))?\Z")
_OP = re.compile(r"(?P<op>sum|avg|slice|comp)\((?P<args>[^()]*)\)\Z")


def series_spec(spec: str) -> dict:
    """A variable request NAME,op(args),...: sum(coord), avg(coord), slice(coord,value) and comp(name) in order."""
    m = _SPEC.fullmatch(spec.strip())
    if not m:
        raise ValueError(f"bad variable {spec!r}")
    ops = []
    for part in re.findall(r"[^,()]+\([^()]*\)|[^,]+", m["rest"] or ""):
        o = _OP.fullmatch(part.strip())
        if not o:
            raise ValueError(f"bad operation {part!r} of {m['name']}")
        args = [a.strip() for a in o["args"].split(",") if a.strip()]
        if len(args) != (2 if o["op"] == "slice" else 1):
            raise ValueError(f"{o['op']} takes {2 if o['op'] == 'slice' else 1} arguments")
        ops.append((o["op"], *args))
    return {"name": m["name"], "ops": ops}


def array_literal(s: str) -> list[float]:
    """[a, b, ...] of a configuration; nested brackets or other text raise."""
    m = re.fullmatch(r"\s*\[\s*([^\[\]]*?)\s*,?\s*\]\s*", s)
    if not m:
        raise ValueError(f"{s!r} is no array")
    return [float(x) for x in re.split(r"[,\s]+", m[1]) if x]


def summary(frames: Mapping[str, DataFrame]) -> list[dict]:
    """Rows and column types of every frame: what loading a stream says of it. One count a frame."""
    return [{"name": str(n), "rows": df.count(), "columns": dict(df.dtypes)} for n, df in frames.items()]
