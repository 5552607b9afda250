"""SimHash near-duplicates by multi-index hashing.

Fingerprints: a text's words (after lower-casing A-Z) form shingles; each is
hashed with XXH64, and a bit of the 64-bit fingerprint is 1 if it is set in
more than half of the hashes.

Links: fingerprints within ``distance`` bits of each other.  A fingerprint is
cut into two 32-bit segments.  If two fingerprints differ in at most 2 bits,
either their first segments differ in at most 1 bit, or their second segments
are equal.  So every distinct fingerprint is entered in two tables under its
segments, looks up in the first table all values within one bit of its own
first segment (a Hamming ball), in the second its own value, and whatever
it meets is verified by the complete distance.  The general rule, for a
distance r: radius floor(r / 2) in the first segment, ceil(r / 2) - 1 in the
second.

A bucket (a segment's value) may be popular.  Within a bucket the members are
sorted by the other segment, and each looks up the few values of it that the
complete distance still allows, so the work is linear in the bucket; and it
reports a spanning forest of what is linked, never all pairs.  A bucket with
more than ``crowded`` fingerprints is divided by the same rule once more, over
the two halves of the other segment; such a part shares 48 of 64 bits and so
holds at most 65,536 members and 16 times as many visitors.

Classes: connected components over the links by alternating large-star and
small-star rounds, each a joined and aggregated table written to the shared
folder; neither links nor labels pass through the driver.  Copies share a
fingerprint and are never expanded into pairs.

Defined results: null and empty texts have no words and fingerprint 0, which
links like any other; a text of fewer words than a shingle is one shingle.
Repeated rows are members of the same class.  Null ids: the class's smallest
id is taken over those that are not null.  Extra columns are ignored by
``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, one_long, quoted, text_udf, written

SEED = 42
WORDS = 3
DISTANCE = 2
CROWDED = 20_000                 # fingerprints in a bucket beyond which it is divided
PIECE = 1 << 20                  # words of a text hashed at once
_BITS = 32


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    last = max(len(words) - size + 1, 1)
    for at in range(0, last, PIECE):
        part = words[at:min(at + PIECE, last) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(part) >= size else [b" ".join(part)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        total += len(hashes)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, size: int = WORDS) -> Column:
    return text_udf(lambda texts: [fingerprint(t, size) for t in texts], "bigint", pa.int64())(text)


# --- balls and buckets --------------------------------------------------------------------------------------------

def ball(radius: int, bits: int) -> np.ndarray:
    """The differences of at most ``radius`` bits, nearest first."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in at) for at in combinations(range(bits), r)]
    return np.array(masks, np.int64)


def radii(distance: int) -> tuple[int, int]:
    """Radius in the first and the second of two segments (-1: the segment need not be looked up)."""
    return distance // 2, (distance + 1) // 2 - 1


class Forest:
    """Union-find over the positions of a bucket; remembers the unions that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def bucket_links(own: np.ndarray, visitors: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among a bucket's fingerprints, and to those that look into it from one ball away, as a forest.

    ``own`` have the bucket's segment, ``visitors`` another value of it.  Small
    buckets compare directly; in larger ones every fingerprint looks up the
    values of the remaining bits that the complete distance allows.
    """
    own = np.unique(own.view(np.uint64))
    everyone = np.unique(np.concatenate((own, visitors.view(np.uint64))))
    forest = Forest(len(everyone))
    at_own = np.searchsorted(everyone, own)
    if len(own) <= 256:
        for k in range(0, len(everyone), 4096):
            near = np.bitwise_count(everyone[k:k + 4096, None] ^ own[None, :]) <= distance
            for i, j in zip(*np.nonzero(near)):
                if everyone[k + i] != own[j]:
                    forest.join(k + int(i), int(at_own[j]))
    else:
        shared = np.bitwise_and.reduce(own) | ~np.bitwise_or.reduce(own)       # bits in which all members agree
        free = [b for b in range(64) if not (int(shared) >> b) & 1]
        masks, upto = [], []
        for r in range(distance + 1):
            masks += [sum(1 << b for b in at) for at in combinations(free, r)]
            upto.append(len(masks))                                            # so many differ in at most r bits
        masks = np.array(masks, np.uint64)
        for k, v in enumerate(everyone):
            rest = distance - int(np.bitwise_count((v ^ own[0]) & shared))
            if rest < 0:
                continue
            look = ((v & ~shared) | (own[0] & shared)) ^ masks[:upto[rest]]
            at = np.minimum(np.searchsorted(own, look), len(own) - 1)
            for j in at[own[at] == look]:
                if own[j] != v:
                    forest.join(k, int(at_own[j]))
    signed = everyone.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in forest.edges]


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, _BITS) if k == 0 else fp.bitwiseAND(F.lit((1 << _BITS) - 1))


def postings(prints: DataFrame, distance: int) -> DataFrame:
    """(segment, value, own, fp): an entry of every fingerprint in each table, and its visits to the rest of its balls.

    Of two values one bit apart only the one with the 0 visits the one with the 1: a pair needs to meet once.
    Wider balls are visited whole.
    """
    parts = []
    for k, r in enumerate(radii(distance)):
        if r < 0:
            continue
        value = _segment(F.col("fp"), k)
        around = F.array(*[F.lit(int(m)) for m in ball(r, _BITS)[1:]]) if r else F.array().cast("array<bigint>")
        visits = F.filter(around, lambda m: value.bitwiseAND(m) == 0) if r == 1 else around
        to = F.concat(F.array(F.struct(value.alias("value"), F.lit(True).alias("own"))),
                      F.transform(visits, lambda m: F.struct(value.bitwiseXOR(m).alias("value"), F.lit(False).alias("own"))))
        parts.append(prints.select(F.lit(k).cast("tinyint").alias("segment"), F.explode(to).alias("t"), "fp")
                     .select("segment", "t.value", "t.own", "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _divided(entries: DataFrame, distance: int) -> DataFrame:
    """Entries of crowded buckets once more, under the halves of their other segment."""
    half = _BITS // 2
    other = F.when(F.col("segment") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    parts = []
    for k, r in enumerate(radii(distance)):
        if r < 0:
            continue
        value = F.shiftrightunsigned(other, half) if k == 0 else other.bitwiseAND(F.lit((1 << half) - 1))
        around = F.array(*[F.lit(int(m)) for m in ball(r, half)])
        # members enter under their own half and visit the ball around it; visitors of the bucket only visit
        to = F.transform(around, lambda m: F.struct(value.bitwiseXOR(m).alias("half"), ((m == 0) & F.col("own")).alias("own")))
        parts.append(entries.select("segment", "value", F.lit(k).alias("part"), F.explode(to).alias("t"), "fp")
                     .select("segment", "value", "part", "t.half", "t.own", "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``prints(fp)``, enough of them to connect what is linked."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be 0 to 4: balls in 32-bit segments grow too large beyond")
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    entries = postings(prints, distance)
    sizes = entries.groupBy("segment", "value").agg(F.count("*").alias("n"), F.max("own").alias("used")) \
        .filter(f"used and n > {int(crowded)}").drop("n", "used")
    full = written(sizes, "simhash-crowded")

    def run(columns: list[str]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sorted entries, bucket after bucket; a bucket may go on from one batch to the next."""
            key, own, seen = None, [], []

            def close() -> list[tuple[int, int]]:
                mine = np.concatenate(own) if own else np.empty(0, np.int64)
                rest = np.concatenate(seen) if seen else np.empty(0, np.int64)
                return bucket_links(mine, rest, distance) if len(mine) and len(mine) + len(rest) > 1 else []

            for batch in batches:
                out = []
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
                mine = batch.column("own").to_numpy(zero_copy_only=False)
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                ends = [*(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), len(fp)]
                start = 0
                for end in ends:
                    now = tuple(keys[:, start].tolist()) if end > start else key
                    if now != key:
                        out += close()
                        key, own, seen = now, [], []
                    m = mine[start:end]
                    if m.any():
                        own.append(fp[start:end][m])
                    if not m.all():
                        seen.append(fp[start:end][~m])
                    start = end
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
            if out := close():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        return scan

    n_full = full.count()
    if n_full:
        split = _divided(entries.join(full, ["segment", "value"]), distance)
        entries = entries.join(full, ["segment", "value"], "left_anti")
    keys = ["segment", "value"]
    found = entries.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run(keys), "a bigint, b bigint")
    if n_full:
        keys = ["segment", "value", "part", "half"]
        found = found.unionByName(
            split.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run(keys), "a bigint, b bigint"))
    return found


# --- connected components -------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of ``edges(a, b)``.

    Alternating stars: a large-star round links every node's larger neighbours
    to its smallest, a small-star round its smaller ones; both keep what is
    connected, and end when every component is a star.  A node with very many
    neighbours is one row of the aggregate; the join to it is the kind that
    adaptive execution splits.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.*").filter("u <> v").distinct()
        small = written(small, "components")
        # a star forest: every u has one v, and no v is a u
        several = one_long(small.groupBy("u").agg(F.count("*").alias("n")), F.sum(F.expr("int(n > 1)")))
        if not several and not small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            stars = small
            break
        now = small
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- documents ------------------------------------------------------------------------------------------------------

def classes(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in ``prints(doc_id, fp)`` that is linked to another or copied.

    Fingerprints of one row alone are left out: their class is the row itself.
    """
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-prints")
    rooted = components(links(each.select("fp"), distance, crowded))
    named = each.join(rooted.withColumnRenamed("node", "fp"), "fp", "left") \
        .filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(named.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS,
                    distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text), size).alias("fp")), "simhash-docs")
    found = classes(prints, distance, crowded).drop("root")
    return prints.join(found, "fp", "left").select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS,
                distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (null ids last), then fingerprint, then hash of the text.

    Rows that stay are known by id and SHA-256 of the text, so texts are joined
    to them by a key that is not popular and fingerprints are made once.
    """
    known = F.coalesce(F.unhex(F.sha2(F.col(quoted(text)), 256)), F.lit(b""))
    prints = written(docs.select(F.col(quoted(id_col)).alias("doc_id"), known.alias("digest"), fingerprints(F.col(quoted(text)), size).alias("fp")), "simhash-docs")
    found = classes(prints.select("doc_id", "fp"), distance, crowded)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "digest")
    keep = prints.join(found, "fp").groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.digest")
    alone = prints.join(found.select("fp"), "fp", "left_anti").select("doc_id", "digest")
    name, hashed = (free_name(docs.columns, n) for n in ("simhash_id", "simhash_digest"))
    keep = keep.unionByName(alone).select(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")).alias(name),
                                          F.col("digest").alias(hashed))
    rows = docs.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(quoted(id_col)).cast("string")), F.lit("-"))).withColumn(hashed, known)
    return rows.join(keep, [name, hashed], "left_semi").dropDuplicates([name, hashed]).select(*[F.col(quoted(c)) for c in docs.columns])
