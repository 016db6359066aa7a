"""Byte-level BPE ids as little-endian uint32 bytes, word by word from a bounded cache.

A single space or newline between other characters always ends a pre-token of the byte-level
pattern, so text without two adjacent white-space characters is the concatenation of its
space-led words, and each distinct word is encoded once. Everything else goes to the library."""

from __future__ import annotations

import base64
import os
import re
import struct
from functools import lru_cache

TWO_SPACES = re.compile(r"\s\s")
#: Letters and signs on whose classes all regular-expression libraries agree.
PLAIN = re.compile(r"[\x00-\x7f\xa1-ſ]*")
#: Words remembered per table; the table is emptied when full.
CACHE_WORDS = 200_000


class _Words(dict):
    def __init__(self, lead: str, encode):
        self.lead, self.encode = lead, encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word) if self.lead + word else b""
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """ids(text) equals tokenizers' encode(text, add_special_tokens=False).ids, as uint32 bytes."""

    @staticmethod
    @lru_cache(4)
    def of(path: str) -> ByteBpe:
        """The worker's own for a file, kept with its words between tasks."""
        return ByteBpe(path)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = self._ranks(path)
        self.first, self.later = _Words("", self._encode), _Words(" ", self._encode)
        self.newline = self._encode("\n")

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary for the quicker library, where its file lies beside the first."""
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks == path or not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self.fast is not None and PLAIN.fullmatch(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if TWO_SPACES.search(text):
            return b"".join(self._encode(x) for x in safe_pieces(text))
        out, first, later, newline = [], self.first, self.later, self.newline
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            if len(words) > 1:
                out.extend(map(later.__getitem__, words[1:]))
            out.append(newline)
        out.pop()
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """Empty for null."""
        if not text:
            return b""
        if self.split is not None and any(s in text for s in self.special):
            return b"".join(struct.pack("<I", self.special[x]) if x in self.special else self._segment(x) for x in self.split.split(text))
        return self._segment(text)


#: Before a space that follows a letter or sign and leads one: a pre-token always ends there.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_pieces(text: str, size: int = 1 << 15):
    """Splits a long text at safe boundaries into pieces of about size characters; joined they are the text."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
