"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are maximal runs of letters a-z (after lower-casing A-Z), digits and
non-ASCII characters.  All items' word sequences go into one suffix automaton
(a new item starts at the root, so no path crosses from one item into the
next).  Training texts stream through it word by word; at each word the
automaton holds the longest suffix of the text so far that is a part of some
item.  A *window* is ``window`` consecutive words of an item (an item of fewer
words, but not none, is one window of its own).  Wherever the longest match
reaches a window's length, the window's words are *hit*, and the items that own
the window are noted.  Words that no item holds end every match, so stretches
between them that are shorter than the shortest window are skipped at once.

Hit words form spans.  ``clean`` cuts spans out of a text, and drops texts of
which more than ``max_coverage`` of the words are hit.

The automaton is broadcast.  Its size is bounded: items are dealt into parts of
at most ``part_words`` words (a longer item is cut into overlapping stretches,
which hold the same windows), and if there are several parts the texts pass one
automaton after another, with what was found so far written in between.  Any
number of items is thus matched exactly within the same memory.

Defined results: null texts and items have no words.  Items without words have
no windows.  Repeated items each count.  Null item ids are named ``null``.
Empty tables give no hits.  Extra columns are ignored by ``contamination`` and
kept by ``clean``.
"""

from __future__ import annotations


from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, struct_type, text_udf, written

WINDOW = 10
#: Of a document's words, the share that may be benchmark passages; above it, a document is more benchmark than text.
MAX_COVERAGE = 0.2
PART_WORDS = 200_000             # words per automaton: about 0.25 GB in a worker and on the driver (8,000 words here)
#: Every byte that is no part of a word becomes a blank, A-Z become a-z.
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows of every item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, ws in items:
            if ws:
                coded.append((name, [self.number.setdefault(w, len(self.number)) for w in ws]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        self._mark(coded)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of length one more than p's for the suffixes of q that short."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The longest match after one more word."""
        after = self.next[state].get(c)
        while after is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
            after = self.next[state].get(c)
        return after, matched + 1

    def _ending(self, state: int, k: int) -> int:
        """The state of the last k words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """owners[state]: items by window length, of the windows that are a suffix of the state's words."""
        own: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            k = min(self.window, len(codes))
            state = matched = 0
            for i, c in enumerate(codes):
                state, matched = self.step(state, matched, c)
                if i + 1 >= k:
                    own.setdefault(self._ending(state, k), {}).setdefault(k, set()).add(name)
        #: per state its windows and the nearest state up the suffix links that has some
        self.owners = {s: [(k, sorted(names)) for k, names in by.items()] for s, by in own.items()}
        self.up = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[s]
            self.up[s] = above if above in self.owners else self.up[above]

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end) and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.shortest or len(ws) < self.shortest:
            return spans, names
        codes = [*map(self.number.get, ws), None]
        at = -1
        for end, c in enumerate(codes):
            if c is None:
                if end - at - 1 >= self.shortest:
                    self._stretch(codes, at + 1, end, spans, names)
                at = end
        return spans, names

    def _stretch(self, codes: list, start: int, end: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        after, link, length, shortest = self.next, self.link, self.length, self.shortest
        state = matched = 0
        for i in range(start, end):
            c = codes[i]
            new = after[state].get(c)
            while new is None:                              # every word is some item's, so the root goes on
                state = link[state]
                matched = length[state]
                new = after[state].get(c)
            state, matched = new, matched + 1
            if matched < shortest:
                continue
            s, longest = (state if state in self.owners else self.up[state]), 0
            while s >= 0:
                for k, who in self.owners[s]:
                    if k <= matched:
                        longest = max(longest, k)
                        names.update(who)
                s = self.up[s]
            if longest:
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of both lists, merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_parts(items: DataFrame, item_id: str, text: str, window: int, part_words: int) -> Iterator[list]:
    """Items as (name, words), dealt into parts of at most ``part_words`` words; always at least one part.

    They come to the driver a part at a time, and a part has a fixed size.
    """
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    part, size = [], 0
    for r in rows.toLocalIterator():
        ws = words(r["t"])
        for at in range(0, max(len(ws), 1), max(1, part_words - window)):
            piece = ws[at:at + part_words]
            if at and len(piece) < window:
                break                                       # its windows are in the stretch before
            if size + len(piece) > part_words and part:
                yield part
                part, size = [], 0
            part.append((r["i"], piece))
            size += len(piece)
    yield part


_FOUND = struct_type([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "n_words bigint, spans array<array<bigint>>, items array<string>"


def find_in(text: Column, automaton) -> Column:
    """Struct (n_words, spans of hit words, items) of a text column under one broadcast automaton."""
    def run(texts: list) -> list:
        a, out = automaton.value, []
        for t in texts:
            ws = words(t)
            spans, names = a.find(ws)
            out.append({"n_words": len(ws), "spans": spans, "items": sorted(names)})
        return out

    return text_udf(run, _FOUND_SQL, _FOUND)(text)


def _pairwise(fn, returns: str, kind: pa.DataType):
    """Arrow UDF of two columns, value by value."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], type=kind)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def match(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = WINDOW, part_words: int = PART_WORDS, found: str = "__found") -> DataFrame:
    """``docs`` with a struct ``found``: n_words, spans (word positions, end exclusive), items."""
    spark, more = docs.sparkSession, free_name([*docs.columns, found], "more_found")
    out, merge = None, _pairwise(union, "array<array<bigint>>", pa.list_(pa.list_(pa.int64())))
    for part in item_parts(items, item_id, item_text, window, part_words):
        automaton = spark.sparkContext.broadcast(Automaton(part, window))
        if out is None:
            out = docs.withColumn(found, find_in(F.col(quoted(text)), automaton))
            continue
        # the next part of the items: what is known so far is written, so only one automaton is in memory
        out = written(out, "decontam").withColumn(more, find_in(F.col(quoted(text)), automaton))
        out = out.withColumn(found, F.struct(
            F.col(f"{found}.n_words").alias("n_words"), merge(F.col(f"{found}.spans"), F.col(f"{more}.spans")).alias("spans"),
            F.array_union(f"{found}.items", f"{more}.items").alias("items"))).drop(more)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the spans of every row."""
    found = match(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), items, **options)
    n_hit = F.aggregate("__found.spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    names = F.array_sort(F.array_distinct("__found.items"))
    return found.select("doc_id", "__found.n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                        F.array_join(F.transform("__found.spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",").alias("spans"))


def cut(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans (and what stands between them); a line break joins the rest."""
    if not text or not spans:
        return text
    data = text.encode("utf-8", "replace")
    flat = data.translate(_BYTES)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    keep, at = [], 0
    for s, e in spans:
        keep.append(data[at:starts[s]].rstrip(b" "))
        at = ends[e - 1]
    keep.append(data[at:].lstrip(b" "))
    return b"\n".join(keep).decode("utf-8", "replace")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", min_span: int = 1, max_coverage: float = MAX_COVERAGE,
          **options) -> DataFrame:
    """``docs`` without benchmark passages.

    Spans of ``min_span`` or more hit words are cut out of the text, and the
    joined text is matched again until it holds none; rows of which more than
    ``max_coverage`` of the words were hit in all go.  Other rows are returned
    as they are.  Null and empty texts, and all rows if there are no items,
    stay; repeated rows are treated alike.
    """
    found, before, gone = (free_name(docs.columns, n) for n in ("found", "words_before", "words_cut"))
    spans = F.filter(F.col(f"{found}.spans"), lambda s: s[1] - s[0] >= min_span)
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    shorter = _pairwise(cut, "string", pa.string())
    columns = [F.col(quoted(c)) for c in docs.columns]
    first = match(docs, items, text=text, found=found, **options)
    untouched = first.filter(F.size(spans) == 0).select(*columns)
    hit = first.filter(F.size(spans) > 0).select("*", F.col(f"{found}.n_words").alias(before), F.lit(0).cast("bigint").alias(gone))
    done = []
    while True:                                        # texts only get shorter; few rows go into a second round
        hit = written(hit.withColumn(gone, F.col(gone) + n_hit).filter(F.col(gone) <= F.col(before) * F.lit(float(max_coverage)))
                      .withColumn(text, shorter(F.col(quoted(text)), spans)).drop(found), "decontam-cut")
        hit = written(match(hit, items, text=text, found=found, **options), "decontam-again")
        done.append(hit.filter(F.size(spans) == 0).select(*columns))
        hit = hit.filter(F.size(spans) > 0)
        if hit.isEmpty():
            break
    for part in done:
        untouched = untouched.unionAll(part)
    return untouched
