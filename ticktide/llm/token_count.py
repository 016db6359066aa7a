"""Token counts: batches balanced by bytes, lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TWO_SPACES, ByteBpe, default_path, safe_pieces

#: Bytes of text encoded at once, and words whose counts a worker remembers; they are forgotten when full.
BATCH_BYTES, CACHE_WORDS = 1 << 20, 300_000


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Batches of (row, piece) of at most about limit bytes each; a longer text goes in pieces cut at safe boundaries."""
    batch: list[tuple[int, str]] = []
    held = 0
    for i, t in enumerate(texts):
        size = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        for piece in safe_pieces(t, limit // 4) if size > limit // 4 else (t,):
            n = size if piece is t else len(piece.encode("utf-8", "surrogatepass"))
            if held and held + n > limit:
                yield batch
                batch, held = [], 0
            batch.append((i, piece))
            held += n
    if batch:
        yield batch


class _ByWords:
    """Counts by a byte-level tokenizer that splits at spaces: the batch's new words are encoded in one call, each once.

    A single space or newline between other characters always ends a pre-token, so a piece without
    two adjacent white-space characters counts as the sum of its space-led words; other pieces, and
    those with a special string in them, are encoded whole in the same call."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode_batch_fast
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.first: dict[str, int] = {"": 0}
        self.later: dict[str, int] = {}
        self.newline = self._lengths(["\n"])[0]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encode(texts, add_special_tokens=False)] if texts else []

    def __call__(self, pieces: list[str]) -> list[int]:
        if len(self.first) + len(self.later) > CACHE_WORDS:
            self.first, self.later = {"": 0}, {}
        out, whole, split, first, later = [0] * len(pieces), [], [], set(), set()
        for i, t in enumerate(pieces):
            if not t:
                continue
            if TWO_SPACES.search(t) or any(s in t for s in self.special):
                whole.append(i)
                continue
            lines = t.split("\n")
            heads, tails = [], []
            for line in lines:
                words = line.split(" ")
                heads.append(words[0])
                tails += words[1:]
            split.append((i, len(lines) - 1, heads, tails))
            first.update(heads)
            later.update(tails)
        new_first, new_later = list(first - self.first.keys()), list(later - self.later.keys())
        lengths = self._lengths([*[pieces[i] for i in whole], *new_first, *[" " + w for w in new_later]])
        a, b = len(whole), len(whole) + len(new_first)
        for i, n in zip(whole, lengths[:a], strict=True):
            out[i] = n
        self.first.update(zip(new_first, lengths[a:b], strict=True))
        self.later.update(zip(new_later, lengths[b:], strict=True))
        for i, breaks, heads, tails in split:
            out[i] = breaks * self.newline + sum(map(self.first.__getitem__, heads)) + sum(map(self.later.__getitem__, tails))
        return out


@lru_cache(4)
def _counter(path: str):
    """A function from a batch of pieces to their token counts, for any of the public tokenizer files; one a worker and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        raw = ByteBpe._ranks(path.replace(".tiktoken", ".json"))
        return lambda texts: [len(x) for x in raw.encode_ordinary_batch(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path) as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return _ByWords(tokenizer)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _splits(path: str) -> bool:
    """Whether a text's count is the sum of its safe pieces' counts: not for sentence models, whose pieces may span words."""
    return not path.endswith(".model")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the column out, the token count of text; other columns pass through untouched.

    Texts are encoded in batches balanced by bytes, long ones split where a pre-token ends anyway
    (by sentence models whole), and only lengths leave the worker. Null and empty texts count 0.
    Repeated rows are counted each for itself; an empty table gives an empty table. A column
    already named out, in any case, is replaced. Memory: one Arrow batch, encoded by pieces."""
    path = tokenizer or default_path()
    kept = docs.drop(*[c for c in docs.columns if c.lower() == out.lower() and c != text])
    at = kept.columns.index(text)
    names = [c for c in kept.columns if c.lower() != out.lower()]

    def run(batches):
        count = _counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            lengths = [0] * len(texts)
            for batch in by_bytes(texts) if _splits(path) else by_bytes(texts, 1 << 62):
                for (i, _), n in zip(batch, count([p for _, p in batch]), strict=True):
                    lengths[i] += n
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lengths, pa.int64())], [*names, out])

    schema = T.StructType([*[kept.schema[n] for n in names], T.StructField(out, T.LongType())])
    return kept.mapInArrow(run, schema)


def op10(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """The contract's columns for every document."""
    found = count_tokens(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), tokenizer)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
