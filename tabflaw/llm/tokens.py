"""Byte-pair token counts by heap and linked list, without token identifiers.

A pre-token (a match of the vocabulary's split pattern) starts as its UTF-8
bytes, one symbol each, in a doubly linked list.  A heap holds the adjacent
pairs that have a merge rank; the pair of lowest rank (leftmost first) is
popped, its two symbols become one, and the pairs with the new neighbours are
pushed.  Popped pairs whose symbols have changed meanwhile are skipped.  The
count is the number of initial symbols minus the merges: the symbols' names
are all that is kept, identifiers are never looked up.  A pre-token of n bytes
takes O(n log n), so a megabyte without blanks is no problem.

Counts of pre-tokens are kept in a table per worker, emptied when it is full,
so its memory is bounded and every pre-token is still counted exactly.

The strings of a vocabulary's special tokens are one token each wherever they
stand in a text, as the vocabulary's library does by default; the text between
them is split and merged on its own.

Defined results: null counts as the empty text, 0 bytes and 0 tokens.  Extra
columns are ignored, repeated rows are counted one by one.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct_type, text_udf

#: Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 800_000                 # pre-tokens a worker remembers
CACHED_CHARS = 64                # longer ones are counted anew
WHOLE = 1 << 20                  # texts up to this length are split at once, longer ones match by match


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding applies to ``symbols``."""
    n = len(symbols)
    own = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        if (r := ranks.get((own[i], own[i + 1]))) is not None:
            heap.append((r, i, own[i], own[i + 1]))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if own[i] != left or j < 0 or own[j] != right:
            continue                                    # one of them has been merged since
        own[i], own[j] = left + right, ""
        done += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((own[i], own[k]))) is not None:
                heapq.heappush(heap, (r, i, own[i], own[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((own[h], own[i]))) is not None:
            heapq.heappush(heap, (r, h, own[h], own[i]))
    return done


class Counter(dict):
    """Token counts of pre-tokens and texts under one vocabulary."""

    def __init__(self, ranks: dict[tuple[str, str], int], specials: list[str]):
        super().__init__()
        self.ranks = ranks
        self.symbol = byte_symbols()
        self.pieces = regex.compile(SPLIT)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) \
            if specials else None

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "replace")
        n = len(data) - merges_needed([self.symbol[b] for b in data], self.ranks)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n

    def _plain(self, text: str) -> int:
        count = self.__getitem__
        if len(text) <= WHOLE:
            return sum(map(count, self.pieces.findall(text)))
        return sum(count(m.group()) for m in self.pieces.finditer(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total, at = total + self._plain(text[at:m.start()]) + 1, m.end()
        return total + self._plain(text[at:] if at else text)


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a byte-level vocabulary file (.json), kept by the worker."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"])
    return Counter({(a, b): k for k, (a, b) in enumerate(pairs)}, [t["content"] for t in whole["added_tokens"]])


def count_tokens(text: Column, vocabulary: str) -> Column:
    """Struct (n_bytes, n_tokens) of a text column; ``vocabulary`` is a file that every executor has."""
    def run(texts: list) -> list:
        c = counter(vocabulary)
        return [{"n_bytes": len((t or "").encode("utf-8", "replace")), "n_tokens": c.count(t)} for t in texts]

    kind = struct_type([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    return text_udf(run, "n_bytes bigint, n_tokens bigint", kind)(text)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), count_tokens(F.col(text), vocabulary).alias("c")) \
        .select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
