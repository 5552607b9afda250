"""Vector column expressions: hashed n-gram embeddings, norms, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash_int


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_ngrams(text, n: int = 3) -> Column:
    """All character n-grams of the whole text (a shorter non-empty text is one gram)."""
    s = _c(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))),
                       lambda i: F.substring(s, i, n))


def hash_embed(text, dim: int = 64, n: int = 3) -> Column:
    """Hashed character n-gram counts, ARRAY<DOUBLE>[dim]; null / empty text -> zeros.

    The default text embedder: md5 buckets of every n-gram of the whole
    value, computed in JVM expressions (no model, no Python).
    """
    s = _c(text)
    buckets = F.array_sort(F.transform(char_ngrams(s, n), lambda g: F.pmod(hash_int(g), F.lit(dim))))

    def counts_of(b):
        # counts from the first positions of the distinct buckets in the sorted
        # array: k <= dim native scans instead of dim lambda passes per gram
        ds = F.array_distinct(b)
        firsts = F.transform(ds, lambda d: F.array_position(b, d))
        ends = F.concat(F.slice(firsts, 2, dim), F.array(F.size(b) + 1))
        return F.map_from_arrays(ds, F.zip_with(firsts, ends, lambda x, y: (y - x).cast("double")))

    def dense_of(m):
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                           lambda d: F.coalesce(F.element_at(m, d.cast("long")), F.lit(0.0)))

    vec = let(buckets, lambda b: let(counts_of(b), dense_of))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.when(s.isNull() | (F.length(s) == 0), zero).otherwise(vec)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (lambda expressions are not
    de-duplicated, so a value used inside a lambda would be recomputed per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """v / |v|; the zero vector stays zero."""
    return let(norm(a), lambda n: F.transform(_c(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))


def diff(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)
