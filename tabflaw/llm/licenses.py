"""Licence scans by conditional compression.

Candidate blocks are windows of words about cues.  The cues follow from the
templates: every form is cut into one part more than words may differ, so one
part stands unchanged wherever the form does, and each part gives one of its
words as a cue (CUE adds further licence words).  A stretch about cues is
covered by overlapping blocks of BLOCK words, so that any part lies whole in
one of them.

Each block is compressed on its own and with each template as a raw Zstandard
dictionary; the templates are ranked by how many bytes they save.  Those that
save MIN_SAVED or more are the block's winners, whatever their number; only
they are confirmed, from the parts of their forms that stand in the block: a
licence counts if no word is missing or added within a short form, or at most
one in ten of a long one, aligned with the fewest differences, from left to
right.  A form may run on beyond the block.  With MIN_SAVED at minus
infinity all templates are compared in all blocks, which finds what a search
without compression finds.

Of forms that overlap, the one with more words stays (then the one that saves
the larger share of its block), so "version 3" of a longer name is not also
taken for another licence.

Templates are an argument: names, openings and texts (see license_texts).

Positions are code points, ends exclusive.

Defined results: null is the empty text, without blocks.  Extra columns are
ignored, repeated rows are scanned one by one.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import struct_type, text_udf

CUE = re.compile(r"licen[cs]|copyright|warrant|permission|redistribut|spdx|unencumbered|creative commons|\bcc0\b|\bcc by\b|gpl", re.I | re.A)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
LONG = 20                        # words from which a form may differ a little
DIFFER = 10                      # one word in so many
BLOCK = 2 * LONG                 # words of a block; half of it is shared with the next, so a part of up to LONG words lies whole in one
MIN_SAVED = 1                    # bytes that a winner saves in a block, so it makes the block smaller (figures in the README)
LEVEL = 19                       # lower levels find too few matches in blocks of a few words


class Template:
    """A licence's forms as word lists, and the compressor that has them all as its dictionary."""

    def __init__(self, name: str, forms: list[str]):
        self.name = name
        self.forms = sorted({tuple(words(f)) for f in forms}, key=lambda f: (-len(f), f))
        raw = "\n".join(" ".join(f) for f in self.forms).encode()
        own = zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)


def words(text: str) -> list[str]:
    return " ".join(WORD.findall(text)).lower().split()


@functools.cache
def default_templates() -> tuple[Template, ...]:
    out = []
    for name, spelled in license_texts.NAMES.items():
        forms = [f"{o} {s}" for o in license_texts.OPENINGS for s in spelled + license_texts.IDENTIFIERS[name]]
        forms += license_texts.TEXTS.get(name, [])
        out.append(Template(name, forms))
    return tuple(out)


def blocks(text: tuple[str, ...], cues: frozenset[str]) -> list[tuple[int, int]]:
    """Overlapping word ranges (start, end) that cover LONG words to either side of every cue."""
    spans: list[list[int]] = []
    for at, w in enumerate(text):
        if w in cues or CUE.search(w):
            lo, hi = max(0, at - LONG), min(len(text), at + LONG + 1)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
    return [(at, min(at + BLOCK, hi)) for lo, hi in spans for at in range(lo, max(hi - BLOCK // 2, lo + 1), BLOCK // 2)]


def rank(block: tuple[str, ...], templates: tuple[Template, ...]) -> list[tuple[int, float, int]]:
    """(bytes saved, their share of the block's compressed size, template's number), best first (then by number)."""
    data = " ".join(block).encode()
    alone = len(zstandard.ZstdCompressor(level=LEVEL).compress(data))
    saved = [alone - len(t.packer.compress(data)) for t in templates]
    return sorted(((s, s / alone, k) for k, s in enumerate(saved)), key=lambda r: (-r[0], r[2]))


def allowed(form: tuple[str, ...]) -> int:
    """Words of a form that may be missing or added."""
    return len(form) // DIFFER if len(form) >= LONG else 0


def units(form: tuple[str, ...]) -> list[tuple[int, tuple[str, ...]]]:
    """(offset, words) of the form's parts: one more than words may differ, so a place of the form has one unchanged."""
    n = allowed(form) + 1
    ends = [len(form) * k // n for k in range(n + 1)]
    return [(a, form[a:b]) for a, b in zip(ends, ends[1:])]


#: by a unit's first and second word ("" if it has none): units with their owners (template's number, offset, form)
Index = dict[str, dict[str, dict[tuple[str, ...], list[tuple[int, int, tuple[str, ...]]]]]]


def index_of(templates: tuple[Template, ...]) -> Index:
    out: Index = {}
    for k, t in enumerate(templates):
        for form in t.forms:
            for offset, unit in units(form) if form else []:
                second = unit[1] if len(unit) > 1 else ""
                out.setdefault(unit[0], {}).setdefault(second, {}).setdefault(unit, []).append((k, offset, form))
    return out


def cues_of(index: Index) -> frozenset[str]:
    """A word of every part: the longest of its licence words, else its longest word."""
    return frozenset(max(unit, key=lambda w: (bool(CUE.search(w)), len(w), w))
                     for by_second in index.values() for by_unit in by_second.values() for unit in by_unit)


def aligned(part: tuple[str, ...], form: tuple[str, ...], most: int) -> tuple[int, int, int, int] | None:
    """(start, end, missing, added) of the place with the fewest differences, the first of such; None above ``most``."""
    none = most + 1
    costs, starts = [0] * (len(part) + 1), list(range(len(part) + 1))
    for i, w in enumerate(form, 1):
        new, begun = [i], [0]
        for j, v in enumerate(part):
            cost, start = costs[j + 1] + 1, starts[j + 1]          # the form's word is missing
            if new[j] + 1 < cost:
                cost, start = new[j] + 1, begun[j]                 # the part's word is added
            if v == w and costs[j] <= cost:
                cost, start = costs[j], starts[j]
            new.append(cost)
            begun.append(start)
        costs, starts = new, begun
        if min(costs) >= none:
            return None
    best = min(costs)
    end = costs.index(best)
    start = starts[end]
    added = (best + (end - start) - len(form)) // 2
    return start, end, best - added, added


#: a block's range and the share that each of its winners saves, by template's number
Won = tuple[int, int, dict[int, float]]


def places(text: tuple[str, ...], index: Index, won: list[Won]) -> list[tuple[int, int, int, float, int, int]]:
    """(start, end, template's number, saved share, missing, added) of every form that a block's winners have in a text's
    words, from left to right: the first place within the limit, then what follows it."""
    found, behind, tried, near = [], {}, set(), []
    waiting = iter(won)
    coming = next(waiting, None)
    at = 0
    while coming or near:
        if not near:
            at = max(at, coming[0])
        while coming and coming[0] <= at:
            near.append(coming)
            coming = next(waiting, None)
        near = [b for b in near if b[1] > at]
        if near and (after := index.get(text[at])) is not None:
            second = after.get(text[at + 1], {}).items() if at + 1 < len(text) else ()
            for unit, owners in [*after.get("", {}).items(), *second]:
                if text[at:at + len(unit)] != unit:
                    continue
                whole = [shares for _, end, shares in near if at + len(unit) <= end]
                for k, offset, form in owners:
                    share = max((s[k] for s in whole if k in s), default=None)
                    first, most = behind.get((k, form), 0), allowed(form)
                    if share is None or at < first or (key := (k, form, at - offset, first)) in tried:
                        continue
                    if not most:
                        got, lo = (at, at + len(form), 0, 0), 0
                    else:
                        tried.add(key)
                        lo = max(first, at - offset - most)
                        got = aligned(text[lo:max(at - offset, 0) + len(form) + most], form, most)
                    if got is not None:
                        found.append((lo + got[0], lo + got[1], k, share, *got[2:]))
                        behind[k, form] = lo + got[1]
        at += 1
    return found


def winners(text: tuple[str, ...], templates: tuple[Template, ...], cues: frozenset[str], min_saved: float = MIN_SAVED,
            rank=rank) -> tuple[int, list[Won]]:
    """Number of blocks, and those with winners."""
    cut = blocks(text, cues)
    won = [(a, b, {k: share for saved, share, k in rank(text[a:b], templates) if saved >= min_saved}) for a, b in cut]
    return len(cut), [w for w in won if w[2]]


def confirmed(text: tuple[str, ...], templates: tuple[Template, ...], index: Index,
              won: list[Won]) -> list[tuple[int, int, str, float, int, int]]:
    """(start, end, licence, saved share, missing, added) in a text's words; places don't overlap."""
    found = [(s, e, templates[k].name, *rest) for s, e, k, *rest in places(text, index, won)]
    found.sort(key=lambda f: (f[0] - f[1] + f[4] + f[5], -f[3], f[2], f[0]))
    out, taken = [], bytearray(len(text))
    for f in found:
        if not any(taken[f[0]:f[1]]):
            taken[f[0]:f[1]] = b"\1" * (f[1] - f[0])
            out.append(f)
    return sorted(out)


@functools.cache
def _default_index() -> tuple[Index, frozenset[str]]:
    index = index_of(default_templates())
    return index, cues_of(index)


@functools.lru_cache(maxsize=4096)
def _rank_default(block: tuple[str, ...], templates: tuple[Template, ...]) -> list[tuple[int, float, int]]:
    return rank(block, templates)


def scan(text: str | None, templates: tuple[Template, ...] | None = None, min_saved: float = MIN_SAVED,
         rank=_rank_default) -> tuple[int, list[tuple[int, int, str, float, int, int]]]:
    """Number of blocks, and (start, end, licence, saved share, missing, added) with code point positions."""
    text = text or ""
    if templates is None:
        templates, (index, cues) = default_templates(), _default_index()
    else:
        index = index_of(templates)
        cues = cues_of(index)
    ws = tuple(words(text))
    n, won = winners(ws, templates, cues, min_saved, rank)
    found = confirmed(ws, templates, index, won)
    at = [m.span() for m in WORD.finditer(text)] if found else []
    return n, [(at[s][0], at[e - 1][1], *rest) for s, e, *rest in found]


_FOUND = struct_type([("n_blocks", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()),
                      ("best_saving", pa.float64()), ("spans", pa.string())])
_FOUND_SQL = "n_blocks bigint, n_licenses bigint, licenses string, best_saving double, spans string"


def find_licenses(text: Column) -> Column:
    """Struct (n_blocks, n_licenses, licenses, best_saving, spans) of a text column."""
    def run(texts: list) -> list:
        out = []
        for t in texts:
            n, found = scan(t)
            out.append({"n_blocks": n, "n_licenses": len(found), "licenses": ",".join(sorted({f[2] for f in found})),
                        "best_saving": max((f[3] for f in found), default=None),
                        "spans": ",".join(f"{f[2]}:{f[0]}:{f[1]}:{f[4]}:{f[5]}" for f in found)})
        return out

    return text_udf(run, _FOUND_SQL, _FOUND)(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_blocks, n_licenses, licenses (sorted, comma-joined), best_saving, spans (licence:start:end:missing:added)."""
    return docs.select(F.col(id_col).alias("doc_id"), find_licenses(F.col(text)).alias("l")).select("doc_id", "l.*")
