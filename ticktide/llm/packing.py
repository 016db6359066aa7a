"""Best-fit packing: local best fit per partition, then a tree of merges of the underfull sequences."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteBpe, default_path
from .common import stage

SIZE = 1024
#: Neighbouring groups joined in a merge round.
FAN_IN = 16


def best_fit(sizes: list[int], capacity: int = SIZE) -> tuple[list[int], list[int], list[int]]:
    """Best fit decreasing: each item's bin and place in it, and the bins' fill. Ties go by input order."""
    bins, places, used = [0] * len(sizes), [0] * len(sizes), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        s = sizes[i]
        if m := free >> s:
            r = s + (m & -m).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                free ^= 1 << r
        else:
            b, r = len(used), capacity
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += s
        if r - s:
            stacks[r - s].append(b)
            free |= 1 << (r - s)
    return bins, places, used


def carried(used: np.ndarray, capacity: int, groups: int) -> np.ndarray:
    """Which sequences go on to the next round, where so many groups are left.

    Best fit leaves a group at most one sequence of half the capacity or less, as two would fit
    together, and two longer ones never do; so each later join takes such a short one, and there are
    no more joins to come than groups. If a short sequence fits any sequence of this group, it also
    fits an emptier one, so the groups + 1 emptiest are all that can ever be needed: handing on more
    saves no sequence."""
    open_ = used < capacity
    if groups <= 1:
        return np.zeros(len(used), bool)
    if open_.sum() > groups + 1:
        at = np.flatnonzero(open_)
        open_[at[np.argsort(used[at], kind="stable")[groups + 1 :]]] = False
    return open_


def _schema(doc_id: T.DataType, with_ids: bool) -> T.StructType:
    s = T.StructType([T.StructField("doc_id", doc_id), T.StructField("piece", T.IntegerType())])
    for n in ("start", "length", "ids_crc32", "sequence_id", "offset", "part", "fill"):
        s = s.add(n, "long")
    return s.add("ids", "binary") if with_ids else s


_MERGED = "part long, sequence_id long, fill long, to_id long, shift long, carried boolean"


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = 2, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as uint32 bytes).

    Only documents longer than size are cut; all but their first piece fill a sequence. Each
    partition packs its own pieces by best fit decreasing and writes them. Of its underfull
    sequences it hands on those that a later join may need (see carried): rows of id and fill, no
    pieces. Neighbouring groups' sequences are packed again as items, round by round, until one group
    is left; a merged sequence follows in the one that it joined. At the end the moves, at most one a
    partition, are applied to the pieces. Every round is written to the shared folder, so a lost
    executor repeats its own tasks only; ids come from partition numbers and stay the same then.
    Memory: the pieces of one partition, or the sequences handed on by FAN_IN groups.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself, a null id
    stays null, ties go by input order, and other columns are ignored; an empty table gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = tokenizer or default_path()
    schema = _schema(docs.schema[id_col].dataType, with_ids)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def local(batches):
        from pyspark import TaskContext

        bpe, end = ByteBpe.of(path), struct.pack("<I", end_id)
        cols: dict[str, list] = {n: [] for n in schema.names}
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.ids(t) + end
                n = len(ids) // 4
                a, k = 0, 0
                while a < n:
                    e = a + ((n - a) % size or size)
                    x = ids[4 * a : 4 * e]
                    for c, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (d, k, a, e - a, zlib.crc32(x)), strict=True):
                        cols[c].append(v)
                    if with_ids:
                        cols["ids"].append(x)
                    a, k = e, k + 1
        if not cols["length"]:
            return
        part = TaskContext.get().partitionId()
        bins, places, used = best_fit(cols["length"], size)
        cols["sequence_id"] = [(part << 40) + x for x in bins]
        cols["offset"], cols["part"], cols["fill"] = places, [part] * len(bins), np.array(used)[bins].tolist()
        out = pa.table({f.name: pa.array(cols[f.name], kind) for f, kind in zip(schema.fields, kinds, strict=True)})
        yield from out.to_batches(max_chunksize=50_000)

    pieces = stage(docs.select(id_col, text).mapInArrow(local, schema), "packed")
    groups = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    # The piece at offset 0 stands for its sequence, so no piece is shuffled.
    now = pieces.where((F.col("offset") == 0) & (F.col("fill") < size)).select("part", "sequence_id", "fill")
    moves = None
    while groups > 1:
        after = -(-groups // FAN_IN)
        grouped = now.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part")
        merged = stage(grouped.applyInPandas(_merger(size, after, groups), _MERGED), "merged")
        new = merged.where(F.col("to_id") != F.col("sequence_id")).select(F.col("sequence_id").alias("from_id"), "to_id", "shift")
        if moves is None:
            moves = new
        else:
            then = new.toDF("mid", "then_id", "more")
            moves = moves.join(then, F.col("to_id") == F.col("mid"), "left").select("from_id", F.coalesce("then_id", "to_id").alias("to_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(new)
        now, groups = merged.where("carried").select("part", F.col("to_id").alias("sequence_id"), "fill"), after
    if moves is None:
        return pieces.drop("part", "fill")
    moves = stage(moves, "moves")
    out = pieces.drop("part", "fill").join(moves, F.col("sequence_id") == F.col("from_id"), "left")
    return out.withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("sequence_id", F.coalesce("to_id", "sequence_id")).drop("from_id", "to_id", "shift")


def _merger(size: int, groups: int, before: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "sequence_id"], kind="stable")
        # Of each group the emptiest that may be needed were not yet chosen in the first round; choosing again changes nothing.
        rows = rows.iloc[: (before + 1) * FAN_IN]
        keys, fill = rows.sequence_id.to_numpy(), rows.fill.to_numpy()
        bins, places, used = (np.array(x) for x in best_fit(fill.tolist(), size))
        name = np.zeros(len(used), np.int64)
        name[bins[places == 0]] = keys[places == 0]
        # A sequence made of several goes on once, as its first one.
        go = carried(used, size, groups)[bins] & (places == 0)
        return pd.DataFrame({"part": rows.part.to_numpy(), "sequence_id": keys, "fill": used[bins], "to_id": name[bins], "shift": places, "carried": go})

    return merge


def op8(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns for every piece of every document."""
    return pack(docs, tokenizer)
