"""Collocations against a plain count of all phrases, whatever the shards."""

from collections import Counter, defaultdict
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from tabflaw.llm import collocations as C


def plain(rows, support=100, most=5, top=2000, percent=100):
    import re
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= support and len(p) > 1}
        found = []
        for p, a in good.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in good.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus():
    import random
    rng = random.Random(7)
    words = ["the", "Of", "été", "new", "york", "ß", "a", "a", "\x00x", " nb"]
    rows = []
    for _ in range(120):
        lang = rng.choice(["en", "en", "en", "de", None, "und"])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "\r\n", "!?", "  "]) for _ in range(rng.randrange(60)))
        rows.append((lang, text))
    return rows + [("en", "New York city hall"), ("en", "a a a a a a a"), ("en", None), (None, None), ("en", ""), ("fr", " .,; ")] * 3


@pytest.mark.parametrize("block,shard", [(1, 1), (40, 100), (40, 1 << 20), (1 << 21, 1 << 24)])
@pytest.mark.parametrize("support", [2, 7])
def test_matches_plain_counts(prepared, docs, block, shard, support):
    rows = corpus()
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)], 4)
    assert got(C.collocations(d, support=support, block=block, shard=shard)) == plain(rows, support)


def test_percent_top_and_most(prepared, docs):
    rows = corpus()
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)])
    assert got(C.collocations(d, support=3, most=3, top=4, inside_percent=60)) == plain(rows, 3, 3, 4, 60)


def test_full_filter_stays_exact(prepared, docs, monkeypatch):
    """A Bloom filter far too small lets nearly everything through; the sums drop it."""
    rows = corpus()
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)])
    monkeypatch.setattr(C.bloom_filter, "__defaults__", (64,))
    assert got(C.collocations(d, support=3, block=50, shard=120)) == plain(rows, 3)


def test_hot_language_and_long_text(prepared, docs):
    rows = [("en", "x y z. " * 5000)] + [("en", "x y z")] * 200 + [("de", "x y")] * 99 + [("fr", "p q")] * 100
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)], 5)
    out = got(C.collocations(d, block=300, shard=2000))
    assert out == plain(rows)
    assert [(r[0], r[2], r[3]) for r in out] == [("en", "x y z", 5200), ("fr", "p q", 100)]


def test_empty_table_and_clashing_columns(prepared, docs):
    assert got(C.collocations(docs([]))) == []
    rows = [("en", "x y")] * 4
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)]).selectExpr("*", "1 as n", "'q' as phrase", "2 as h", "3 as size", "4 as need")
    assert got(C.collocations(d, support=4)) == plain(rows, 4)


def test_products_beyond_64_bits(prepared):
    spark = prepared
    big = 10 ** 12
    frequent = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, f long")
    sizes = spark.createDataFrame([("en", 10 ** 13)], "lang string, n long")
    r = C.cut_scores(frequent, sizes).first()
    assert r["score"] == 1000 * (big - 7) * 10 ** 13 // (big * (big - 1))


@pytest.mark.parametrize("hashes,texts", [(1, 1), (30, 50), (1 << 20, 1 << 19)])
def test_shards_that_end_by_phrases(prepared, docs, hashes, texts):
    """a shard ends where a task holds as many phrases as it may; results stay."""
    rows = corpus()
    d = docs([(k, t, lang) for k, (lang, t) in enumerate(rows)], 4)
    assert got(C.collocations(d, support=4, block=40, shard=100, hashes=hashes, texts=texts)) == plain(rows, 4)


def given_out(df):
    """Rows that the MapInArrow steps of a query made."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
        if name == "MapInArrow":
            found += node.metrics().apply("pythonNumRowsReceived").value()
    return found


def test_a_phrase_is_given_out_once_a_core(prepared, docs):
    """the rows of the last reading follow the phrases and the cores, not the partitions of the blocks."""
    cores = prepared.sparkContext.defaultParallelism
    blocks = C.encode(docs([(1, "new york city. hall of fame", "en")])) \
        .selectExpr("*", f"explode(sequence(1, {20 * cores})) as copy").repartition(10 * cores).persist()
    assert blocks.count() == 20 * cores
    words = C.word_counts(blocks).filter("f >= 5")
    every = C.Filter(64, C.np.full(8, 255, C.np.uint8))
    counts = C.exact_counts(blocks, {1: C.bloom_filter(words), 2: every, 3: every})
    assert given_out(counts) <= 6 * cores                   # 4 phrases of two words, 2 of three
    assert sorted((r["phrase"], r["f"]) for r in counts.collect()) == [
        (p, 20 * cores) for p in ("hall of", "hall of fame", "new york", "new york city", "of fame", "york city")]
    blocks.unpersist()


def test_mining_names_what_the_whole_corpus_may_hold_often(prepared, docs):
    """a phrase of a few occurrences in every shard, but too few in sum, is not named shard by shard."""
    blocks = reduce(DataFrame.union, [C.encode(docs([(k, f"new york. w{part} v{part}", "en") for k in range(30)])) for part in range(6)]) \
        .selectExpr("0 as number", "720L as n", "*").persist()
    assert blocks.count() == 6                               # of 120 words, so 17 of 100 is what a shard asks
    every = C.Filter(64, C.np.full(8, 255, C.np.uint8))
    slots = C.hashed_counts(blocks, every, 2, 100, 1 << 16)
    mined = C.local_mining(blocks, every, slots, 2, 100, limit=1)
    assert [r["above"] for r in mined.filter("h is not null").collect()] == [6 * (30 - 16)]
    assert given_out(mined) == 12                            # "new york" and the null row of each shard
    blocks.unpersist()


def test_hashed_counts_keep_all_that_is_often(prepared, docs):
    rows = [(k, "a b c d e. f g. " * (k % 3) + f"q{k} r{k}", "en") for k in range(90)]
    blocks = C.encode(docs(rows, 4), block=50).persist()
    every = C.Filter(64, C.np.full(8, 255, C.np.uint8))
    word = {r["phrase"]: C.np.uint64(r["h"] & (2 ** 64 - 1)) for r in C.word_counts(blocks).collect()}
    for support in (90, 91, 300, 70_000):
        slots = C.hashed_counts(blocks, every, 2, support, 1 << 16)
        often = [bool(slots(C._mix(C.np.array([word[x]]), C.np.array([word[y]])))[0]) for x, y in ("ab", "bc", "cd", "de", "fg")]
        assert often == [support <= 90] * 5                  # each occurs 90 times
    blocks.unpersist()


def test_filter_lets_few_through(prepared):
    rng = C.np.random.default_rng(1)
    member = rng.integers(-2 ** 63, 2 ** 63 - 1, 5000)
    f = C.bloom_filter(prepared.createDataFrame([(int(h),) for h in member], "h long"))
    assert f(member.view(C.np.uint64)).all()
    assert f(rng.integers(0, 2 ** 64 - 1, 200_000, dtype=C.np.uint64)).mean() < 0.003
