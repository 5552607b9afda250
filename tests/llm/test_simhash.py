"""Fingerprints, links, classes against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.llm import simhash


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance):
    """component_id of each (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b\x0bc  d\x1fe é É", "nbsp joined x y z", "w " * 50])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) & (2 ** 64 - 1) == plain_fingerprint(text)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(str(random.Random(5).random())[2:6] + str(k % 97) for k in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(text) == whole and whole & (2 ** 64 - 1) == plain_fingerprint(text)


def near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


def cloud(seed, n):
    """Clusters around a few centres, chains, and values that share one segment."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2 ** 64 - 1]
    out = [near(rng, rng.choice(centres), rng.randrange(0, 7)) for _ in range(n)]
    out += [(centres[0] & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(n // 2)]
    chain = rng.getrandbits(64)
    for _ in range(n // 4):
        chain = near(rng, chain, 2)
        out.append(chain)
    return out


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("crowded", [20_000, 12])
def test_classes_like_all_pairs(prepared, distance, crowded):
    prints = [(i, p) for i, p in enumerate(cloud(distance, 160))]
    signed = [(d, p - 2 ** 64 if p >= 2 ** 63 else p) for d, p in prints]
    df = prepared.createDataFrame(signed, "doc_id bigint, fp bigint")
    found = {r["fp"]: r["component_id"] for r in simhash.classes(df, distance, crowded).collect()}
    assert [found.get(p, d) for d, p in signed] == plain_classes(prints, distance)


def test_large_buckets_look_values_up():
    rng = np.random.default_rng(3)
    own = (rng.integers(0, 1 << 12, 900) | (7 << 32)).astype(np.int64)
    visitors = (rng.integers(0, 1 << 12, 300) | (5 << 32)).astype(np.int64)
    edges = simhash.bucket_links(own, visitors, 2)
    everyone = sorted({*own.tolist(), *visitors.tolist()})
    assert all((a ^ b).bit_count() <= 2 for a, b in edges) and len(edges) < len(everyone)

    def groups(pairs):
        parent = {x: x for x in everyone}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return {frozenset(x for x in everyone if find(x) == r) for r in {find(x) for x in everyone}}

    mine = set(own.tolist())
    assert groups(edges) == groups((a, b) for a in everyone for b in mine if (a ^ b).bit_count() <= 2)


def test_documents_like_all_pairs(prepared):
    d = prepared.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in d.collect()]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(rows, plain_classes(rows, 2))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    assert got == want


def test_edges(docs, prepared):
    rows = [(5, None), (3, ""), (4, " "), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "A B c d e f g h"),
            (None, "only one of these"), (9, "x")]
    d = docs(rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=repr)
    kept = simhash.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(3, ""), (7, "a b c d e f g h"), (None, "only one of these"), (9, "x")], key=repr)
    assert simhash.near_duplicates(d.filter("doc_id < 0")).count() == 0
    assert simhash.one_of_each(d.filter("doc_id < 0")).count() == 0


def test_one_of_each_keeps_columns_of_any_name(docs, prepared):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, None), (None, ""), (4, "quite other words stand here")]
    d = docs(rows)
    for name in ("__id", "__fp", "simhash_id", "simhash_digest", "fp", "digest", "root"):
        out = simhash.one_of_each(d.withColumn(name, F.lit("mine")))
        got = out.collect()
        assert out.columns == [*d.columns, name] and {r[name] for r in got} == {"mine"}
        assert sorted(r["doc_id"] for r in got) == [1, 3, 4]
