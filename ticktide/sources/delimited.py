"""Delimited export: header rows from column metadata, arrays spread over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """Arrays of known length as columns name[0], name[1], ...; vectors as name.component."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols += [F.get(f.name, F.lit(i)).alias(f"{f.name}[{i}]") for i in range((lengths or {})[f.name])]
        elif isinstance(f.dataType, T.StructType):
            cols += [F.col(f.name)[x].alias(f"{f.name}.{x}") for x in f.dataType.names]
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def header(df: DataFrame) -> list[str]:
    """Column titles with units where the metadata has them."""
    return [f.name + (f" ({f.metadata['units']})" if f.metadata.get("units") else "") for f in df.schema.fields]


def write_csv(df: DataFrame, path: str, delimiter: str = ",", lengths: dict[str, int] | None = None, fill: str = "", titles: bool = True) -> None:
    """A folder of delimited files, nulls as fill; written by the executors."""
    d = flat(df, lengths)
    d = d.toDF(*header(d)) if titles else d
    d.write.mode("overwrite").option("header", titles).option("delimiter", delimiter).option("nullValue", fill).csv(path)


def info(df: DataFrame, time: str) -> dict:
    """A JSON-ready description: parameters with type, units, fill and size, the time column first."""
    kinds = {T.DoubleType: "double", T.FloatType: "double", T.IntegerType: "integer", T.LongType: "double", T.StringType: "string"}
    out = []
    for f in sorted(df.schema.fields, key=lambda f: f.name != time):
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        p = {"name": f.name, "type": "isotime" if f.name == time else kinds.get(type(inner), "string"), "units": f.metadata.get("units") or ("UTC" if f.name == time else None), "fill": None if f.name == time else str(f.metadata.get("fill", -1e31))}
        if f.metadata.get("tags"):
            p |= {"size": [len(f.metadata["tags"])], "bins": [{"name": "tags", "centers": f.metadata["tags"]}]}
        out.append(p)
    return {"parameters": out}


def header_rows(df: DataFrame, dataset: str, lengths: dict[str, int] | None = None) -> list[list[str]]:
    """Three rows over the flattened columns: ids, units and labels, led by the dataset's id and the row's kind."""
    ids, units, labels = [], [], []
    for f in df.schema.fields:
        meta = f.metadata
        label = (meta.get("props") or {}).get("label") or f.name
        names = [f.name]
        if isinstance(f.dataType, T.ArrayType):
            tags = meta.get("tags") or []
            names = [f"{f.name}[{i}]" for i in range((lengths or {}).get(f.name) or len(tags))]
        elif isinstance(f.dataType, T.StructType):
            names = [f"{f.name}.{x}" for x in f.dataType.names]
        ids += names
        units += [meta.get("units", "")] * len(names)
        labels += [label] * len(names)
    return [[dataset, kind, *row] for kind, row in (("id", ids), ("units", units), ("label", labels))]


def _text(f: T.StructField, digits: int, second_digits: int):
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * second_digits if second_digits else ""))
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.format_string(f"%.{digits}e", c.cast("double"))
    if isinstance(f.dataType, T.StringType):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return c.cast("string")


def rows(df: DataFrame, dataset: str, sep: str = ";", digits: int = 7, second_digits: int = 3, fill: str = "", lengths: dict[str, int] | None = None) -> DataFrame:
    """One text column: the dataset's id, "values" and the flattened record, separated; only columns that vary by record belong in df."""
    d = flat(df, lengths)
    cells = [F.coalesce(_text(f, digits, second_digits), F.lit(fill)) for f in d.schema.fields]
    return d.select(F.concat_ws(sep, F.lit(f'"{dataset}"'), F.lit('"values"'), *cells).alias("value"))


def export(frames: dict[str, DataFrame], path: str, sep: str = ";", digits: int = 7, second_digits: int = 3, fill: str = "", titles: bool = True, lengths: dict[str, int] | None = None) -> None:
    """A folder of delimited files with CRLF line ends, each with the three header rows of every dataset it holds records of."""
    from .files import write_bytes

    out, head = None, []
    for name, df in frames.items():
        head += [sep.join('"' + x.replace('"', '""') + '"' for x in row) for row in header_rows(df, name, lengths)] if titles else []
        part = rows(df, name, sep, digits, second_digits, fill, lengths)
        out = part if out is None else out.unionByName(part)
    write_bytes(out.select(F.concat(F.col("value"), F.lit("\r\n")).cast("binary").alias("value")), path, ".csv", "".join(x + "\r\n" for x in head).encode())


def hapi_rows(df: DataFrame, time: str, begin: str | None = None, end: str | None = None, names: list[str] | None = None, second_digits: int = 3, digits: int = 6) -> DataFrame:
    """One text column of comma-separated records in [begin, end): time first with Z, fill as NaN; names choose the other columns.

    The rows keep the input's order and partitions."""
    keep = [f for f in df.schema.fields if f.name != time and (names is None or f.name in names)]
    if names and set(names) - {f.name for f in keep} - {time}:
        raise ValueError(f"no columns {sorted(set(names) - {f.name for f in keep} - {time})}")
    t = F.col(time)
    d = df
    for bound, test in ((begin, lambda x: t >= x), (end, lambda x: t < x)):
        d = d if bound is None else d.where(test(F.to_timestamp_ntz(F.lit(bound))))
    number = lambda c: F.coalesce(F.format_string(f"%.{digits}e", c.cast("double")), F.lit("NaN"))
    cells = [F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss." + "S" * second_digits), F.lit("Z"))]
    for f in keep:
        c = F.col(f"`{f.name}`")
        cells.append(F.array_join(F.transform(c, number), ",") if isinstance(f.dataType, T.ArrayType) else F.coalesce(c, F.lit("")) if isinstance(f.dataType, T.StringType) else number(c))
    return d.select(F.concat_ws(",", *cells).alias("value"))


def fixed_table(df: DataFrame, time: str, begin: str | None = None, end: str | None = None, relative_to: str | None = None, width: int = 15) -> DataFrame:
    """One text column of fixed-width records in [begin, end): the time as ISO text, or in seconds since relative_to, then numbers."""
    t = F.col(time)
    d = df
    if begin is not None:
        d = d.where(t >= F.to_timestamp_ntz(F.lit(begin)))
    if end is not None:
        d = d.where(t < F.to_timestamp_ntz(F.lit(end)))
    first = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS") if relative_to is None else F.format_string(f"%{width}f", (F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.lit(relative_to).cast("timestamp"))) / 1e6)
    number = lambda c: F.format_string(f"%{width}e", c.cast("double"))
    cells = [F.array_join(F.transform(f.name, number), " ") if isinstance(f.dataType, T.ArrayType) else number(F.col(f"`{f.name}`")) for f in df.schema.fields if f.name != time]
    return d.select(F.concat_ws(" ", first, *cells).alias("value"))
