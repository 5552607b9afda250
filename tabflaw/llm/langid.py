"""Language identification with hyperdimensional profiles.

Every letter owns a fixed random vector of +1/-1 (drawn from a seed and the
letter's code point, so no alphabet has to be known beforehand).  A letter
trigram is *bound* as the elementwise product of its letters' vectors, the
first permuted (rotated) twice and the second once; a text *bundles* its
trigrams by adding their vectors; a language's prototype bundles the texts
that carry its label.  A text gets the language whose prototype has the
largest cosine with it.

Letters are the code points of Unicode's L categories, lower-cased; every run
of other characters is one blank, and a text is padded by a blank at both
ends, so a single letter already gives a trigram.

Defined results: a null text or one without letters is ``und`` with score 0.
Equal cosines go to the language that sorts first.  Without any training row
every text is ``und``.  Labels that are null teach nothing.  Long texts are
read whole, in pieces of PIECE characters.  Columns other than the ones named
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct_type, text_udf

SEED = 20240601
DIM = 1024
PIECE = 1 << 20
#: Training rows per language (an expected number: rows are chosen by a hash of their text).
SAMPLE_PER_LANGUAGE = 4000
_BITS = 21                       # a code point needs 21 bits; a trigram fits a 64-bit integer
_MASK = (1 << _BITS) - 1
_BLOCK = 2048                    # trigram vectors made at once
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0 (the blank)."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000)


@functools.lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng((SEED, code)).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)


def _piece_grams(before: np.ndarray, piece: str, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of a piece that follows the characters ``before``, and what the next piece follows."""
    codes = np.concatenate((before, _letters()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)], np.zeros(int(last), np.int64)))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)       # one blank for each run of other characters
    codes = codes[keep]
    return (codes[:-2] << (2 * _BITS)) | (codes[1:-1] << _BITS) | codes[2:], codes[-2:]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts."""
    text = (text or "").lower()
    codes, counts, before = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
    for at in range(0, max(len(text), 1), PIECE):
        every, before = _piece_grams(before, text[at:at + PIECE], at + PIECE >= len(text))
        new, n = np.unique(every, return_counts=True)
        if not len(codes):
            codes, counts = new, n
            continue
        codes, back = np.unique(np.concatenate((codes, new)), return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, n)), len(codes)).astype(np.int64)
    return codes, counts


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes, a row each."""
    parts = np.stack((codes >> (2 * _BITS), (codes >> _BITS) & _MASK, codes & _MASK))
    own, at = np.unique(parts, return_inverse=True)
    at = at.reshape(parts.shape)
    table = np.stack([_letter_vector(int(c)) for c in own])
    return np.roll(table, 2, axis=1)[at[0]] * np.roll(table, 1, axis=1)[at[1]] * table[at[2]]


def bundle(groups: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` bundles: row g adds ``counts`` times the vectors of the codes whose group is g."""
    out = np.zeros((n, DIM), np.float32 if counts.size == 0 or counts.max() < 1 << 12 else np.float64)
    distinct, column = np.unique(codes, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, groups, counts = column[order], groups[order], counts[order]
    for first in range(0, len(distinct), _BLOCK):
        a, b = np.searchsorted(column, (first, first + _BLOCK))
        vectors = _gram_vectors(distinct[first:first + _BLOCK])
        weights = np.zeros((n, len(vectors)), out.dtype)
        weights[groups[a:b], column[a:b] - first] = counts[a:b]
        out += weights @ vectors.astype(out.dtype)
    return out


def _bundles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each text, and whether it has a letter."""
    found = [grams(t) for t in texts]
    sizes = [len(c) for c, _ in found]
    has = np.array([bool(c.any()) for c, _ in found], bool)
    if not any(sizes):
        return np.zeros((len(texts), DIM), np.float32), has
    return bundle(np.repeat(np.arange(len(texts)), sizes), np.concatenate([c for c, _ in found]),
                  np.concatenate([n for _, n in found]), len(texts)), has


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """Prototypes of the languages in ``labelled``, in the order of their names.

    About ``per_language`` rows of each language are used, chosen by a hash of
    the text.  What comes to the driver is one vector per language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .filter("text is not null and lang is not null")
    share = {r["lang"]: per_language / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return []
    limit = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])[F.col("lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < limit * 1_000_003)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors, _ = _bundles(texts)
            for name in sorted(set(langs)):
                mine = vectors[[k for k, x in enumerate(langs) if x == name]].astype(np.float64).sum(axis=0)
                sums[name] = sums[name] + mine if name in sums else mine
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(total.astype(np.int64))],
                names=["lang", "dim", "value"])

    added = chosen.mapInArrow(partial, "lang string, dim int, value bigint") \
        .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors: dict[str, np.ndarray] = {}
    for r in added.collect():                    # languages x DIM integers
        vectors.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["value"]
    return sorted(vectors.items())


def classify(text: Column, prototypes: list[tuple[str, np.ndarray]]) -> Column:
    """Struct (lang, score) of a text column: the language with the largest cosine and that cosine."""
    names = [n for n, _ in prototypes]
    unit = np.stack([v / (np.linalg.norm(v) or 1) for _, v in prototypes]) if names else np.zeros((0, DIM))

    def run(texts: list) -> list:
        vectors, has = _bundles(texts)
        if not names:
            return [{"lang": UND, "score": 0.0}] * len(texts)
        length = np.linalg.norm(vectors, axis=1)
        near = (vectors @ unit.T.astype(vectors.dtype)) / np.where(length, length, 1)[:, None]
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(texts)), best].astype(float), 0, 1)
        return [{"lang": names[b], "score": float(s)} if h else {"lang": UND, "score": 0.0}
                for b, s, h in zip(best, score, has, strict=True)]

    kind = struct_type([("lang", pa.string()), ("score", pa.float64())])
    return text_udf(run, "lang string, score double", kind)(text)


def held_out(doc_id: Column) -> Column:
    """The fold that no prototype learns from: crc32 of the id as text, modulo 5, is 0 (a null id: learns)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that aren't held out."""
    prototypes = learn(docs.filter(~held_out(F.col(id_col))), text, lang)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       classify(F.col(text), prototypes).alias("p")) \
        .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
