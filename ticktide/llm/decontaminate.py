"""Benchmark decontamination: a broadcast hash set of item n-grams against every token window."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, stage

SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

#: Words in a window.
WINDOW = 10
#: Bytes that the index of one broadcast may hold, as arrays; a larger benchmark goes through in blocks of this size.
BROADCAST_BYTES = 128 << 20
#: Bytes of index for a word of an item, beside its text: place, window hash, its place and item.
WORD_BYTES = 20
#: Word hashes remembered by a worker; forgotten when full.
VOCAB = 300_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCAB:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


#: One a worker process, kept between tasks.
_hashes = _Hashes()


class Windows:
    """The windows of a block of items in flat arrays: words' text and places, and per length the sorted hashes with place and item.

    It is built once on the driver and broadcast, so that tasks only read it; a hit by hash is
    verified on the words themselves."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.names = [item for item, _ in items]
        per = [words_of(text) for _, text in items]
        counts = np.array([len(w) for w in per], np.int64)
        flat = [w for ws in per for w in ws]
        self.text = b" ".join(flat)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.at = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.uint32 if len(self.text) < 1 << 31 else np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        hashes = np.fromiter((_hashes[w] for w in flat), np.uint64, len(flat))
        lengths: dict[int, list] = {}
        for i, n in enumerate(np.minimum(counts, window).tolist()):
            if n:
                lengths.setdefault(n, []).append(i)
        self.lengths = {}
        for n, ids in lengths.items():
            place = np.concatenate([np.arange(first[i], first[i + 1] - n + 1) for i in ids]).astype(np.uint32)
            owner = np.repeat(np.array(ids, np.uint32), [counts[i] - n + 1 for i in ids])
            h = self._roll(hashes, n)[place]
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << 16, bool)
            table[h >> np.uint64(48)] = True
            self.lengths[n] = (h[order], place[order], owner[order], table)

    @staticmethod
    def _roll(words: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n consecutive word hashes."""
        h = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += words[k : k + len(h)]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list]:
        """Hit spans of word positions, end exclusive and merged, and the items that occur."""
        get = _hashes.__getitem__
        hashed = np.fromiter(map(get, words), np.uint64, len(words))
        spans: list[tuple[int, int]] = []
        found: dict[int, None] = {}
        for n, (hashes, place, owner, table) in self.lengths.items():
            if len(hashed) < n:
                continue
            h = self._roll(hashed, n)
            at = np.flatnonzero(table[h >> np.uint64(48)])
            if not len(at):
                continue
            low = np.searchsorted(hashes, h[at])
            hit = hashes[np.minimum(low, len(hashes) - 1)] == h[at]
            known: dict[bytes, list[int]] = {}
            for i, k in zip(at[hit].tolist(), low[hit].tolist(), strict=True):
                window = b" ".join(words[i : i + n])
                if window not in known:
                    end = int(np.searchsorted(hashes, hashes[k], "right"))
                    known[window] = [int(owner[j]) for j in range(k, end) if self.text[self.at[place[j]] : int(self.at[int(place[j]) + n]) - 1] == window]
                    found.update(dict.fromkeys(known[window]))
                if known[window]:
                    spans.append((i, i + n))
        return merge(spans), list(dict.fromkeys(self.names[i] for i in found))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, text: str, limit: int) -> int:
    """How many blocks of at most about limit bytes the items' index needs: 0 for none, 1 where all may be broadcast."""
    words = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = benchmark.select(F.sum(F.octet_length(text) + WORD_BYTES * words)).first()[0]
    return 0 if not total else -(-int(total) // limit)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, hits (word spans, end exclusive, merged) and items (ids that occur).

    The item set is broadcast only after the bytes of its index are summed; beyond the limit the
    items go in hashed blocks of that size, each broadcast in turn over a staged result, so every
    window is tried. Nulls: a null text or item has no words; a null item id is reported as an item
    like any other. Ties: a window of several items reports all, equal ids once. Repeated rows are
    marked each for itself; empty tables give empty or unmarked ones. A long text is scanned
    whole, in memory of its own size. Columns named n_words, hits or items are replaced."""
    ids = T.ArrayType(benchmark.schema[item_id].dataType)
    base = docs.drop("n_words", "hits", "items")
    names = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))), T.StructField("items", ids)])
    n = max(1, blocks(benchmark, item_text, limit))
    out = base
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(item_text), F.lit(n)) == k)
        rows = sorted((tuple(r) for r in part.select(item_id, item_text).where(F.col(item_text).isNotNull()).collect()), key=str)
        held = docs.sparkSession.sparkContext.broadcast(Windows(rows, window))
        out = out.mapInArrow(_marker(held, text, names, k > 0, to_arrow_type(ids)), schema)
        if k < n - 1:
            out = stage(out, "marked")
    return out


def _marker(held, text: str, names: list[str], again: bool, kind: pa.DataType):
    def run(batches):
        known = held.value
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            old = b.select(["n_words", "hits", "items"]).to_pylist() if again else None
            counts, hits, items = [], [], []
            per = [words_of(t) for t in column.to_pylist()]
            for i, words in enumerate(per):
                spans, found = known.scan(words)
                if old:
                    spans = merge(spans + [(x["a"], x["b"]) for x in old[i]["hits"]])
                    found = list(dict.fromkeys(old[i]["items"] + found))
                counts.append(len(words))
                hits.append([{"a": a, "b": e} for a, e in spans])
                items.append(found)
            arrays = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(hits, SPANS), pa.array(items, kind)], [*names, "n_words", "hits", "items"])

    return run


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every document; an item of null id counts, and is the empty string in items_sha256."""
    m = mark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    ids = F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    return m.select("doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or with their hit words' spans cut out of the text.

    mode "documents" drops every row with a hit; "spans" keeps all rows and deletes, per hit
    span, the characters from the first hit word's start to the last one's end."""
    clash = [c for c in docs.columns if c.lower() in ("n_words", "hits", "items")]
    renamed = dict(zip(clash, fresh(docs, *clash), strict=True))
    back = {v: k for k, v in renamed.items()}
    d = docs.withColumnsRenamed(renamed)
    text = renamed.get(options.get("text", "text"), options.get("text", "text"))
    m = mark(d, benchmark, **(options | {"text": text}))
    if mode == "documents":
        return m.where(F.size("hits") == 0).select(*d.columns).withColumnsRenamed(back)
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    names, find = d.columns, re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the words before A-Z are lower-cased

    def cut(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index("hits")).to_pylist(), strict=True):
                if spans:
                    where = [x.span() for x in find.finditer(t)]
                    for s in reversed(spans):
                        t = t[: where[s["a"]][0]] + t[where[s["b"] - 1][1] :]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(b.schema.get_field_index(c)) for c in names], names)

    return m.select(*names, "hits").mapInArrow(cut, d.schema).withColumnsRenamed(back)
