"""The automaton against all windows, by plain sets; clean."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.llm import decontam


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_find(ws, items, window):
    hit, names = set(), set()
    for name, item in items:
        k = min(window, len(item))
        if not k:
            continue
        wins = {tuple(item[i:i + k]) for i in range(len(item) - k + 1)}
        for i in range(len(ws) - k + 1):
            if tuple(ws[i:i + k]) in wins:
                hit.update(range(i, i + k))
                names.add(name)
    return hit, names


def flat(spans):
    return {p for s, e in spans for p in range(s, e)}


@pytest.mark.parametrize("seed", range(40))
def test_automaton_like_plain_windows(seed):
    rng = random.Random(seed)
    vocab = [bytes([97 + k]) for k in range(rng.choice([2, 3, 6]))]
    items = [(str(k), [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]) for k in range(rng.randrange(0, 8))]
    window = rng.choice([2, 4, 10])
    a = decontam.Automaton(items, window)
    for _ in range(10):
        ws = [rng.choice([*vocab, b"zz"]) for _ in range(rng.randrange(0, 60))]
        if items and rng.random() < 0.7:
            ws[3:3] = rng.choice(items)[1]
        spans, names = a.find(ws)
        hit, who = plain_find(ws, items, window)
        assert flat(spans) == hit and names == who
        assert all(s < e for s, e in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("part_words", [200_000, 300])
def test_documents_like_plain_windows(prepared, part_words):
    d = prepared.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120)
    b = prepared.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    items = [(str(r["item_id"]), plain_words(r["text"])) for r in b.collect()]
    got = {r["doc_id"]: r for r in decontam.contamination(d, b, part_words=part_words).collect()}
    import hashlib
    n = 0
    for r in d.collect():
        ws = plain_words(r["text"])
        hit, who = plain_find(ws, items, 10)
        g = got[r["doc_id"]]
        n += bool(hit)
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(ws), len(hit), len(who), bool(hit))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
    assert n


def test_long_items_are_cut_without_losing_windows(prepared):
    long = " ".join(f"w{k}" for k in range(500))
    b = prepared.createDataFrame([(1, long), (2, "short one")], "item_id bigint, text string")
    parts = list(decontam.item_parts(b, "item_id", "text", 10, 100))
    assert len(parts) > 4 and all(sum(len(w) for _, w in p) <= 100 for p in parts)
    wins = {tuple(w[i:i + 10]) for p in parts for _, w in p for i in range(len(w) - 9)}
    assert len(wins) == 491


def test_clean_and_edges(docs, prepared):
    passage = " ".join(f"q{k}" for k in range(12))
    b = prepared.createDataFrame([(1, passage), (2, None), (3, "..."), (None, "lone word")], "item_id bigint, text string")
    rows = [(1, f"Before it, {passage.upper()}! After é it. And so on, more of it, and more of that, to the end of the text."), (2, passage),
            (3, None), (4, ""), (5, "a LONE, word!"), (5, "a LONE, word!"), (6, "lone\nwords")]
    d = docs(rows).withColumn("spans", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contamination(d, b).collect())
    assert got == [(1, 33, 12, 1), (2, 12, 12, 1), (3, 0, 0, 0), (4, 0, 0, 0), (5, 3, 2, 1), (5, 3, 2, 1), (6, 2, 0, 0)]
    kept = decontam.clean(d, b, max_coverage=0.5)
    assert kept.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {1, 3, 4, 6} and texts[6] == "lone\nwords" and texts[3] is None
    assert texts[1].startswith("Before it,") and "q5" not in texts[1].lower() and texts[1].endswith("After é it. And so on, more of it, and more of that, to the end of the text.")
    assert {r["doc_id"] for r in decontam.clean(d, b, max_coverage=0.0).collect()} == {3, 4, 6}
    assert {r["n_hit"] for r in decontam.contamination(d, b.filter("item_id < 0")).collect()} == {0}
    assert decontam.contamination(d.filter("doc_id < 0"), b).count() == 0


def plain_clean(text, items, window, most):
    """The text without hit words, found and cut again until none is left; None if too many go."""
    total, n = 0, len(plain_words(text))
    while True:
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        hit = sorted(plain_find(plain_words(text), items, window)[0])
        if not hit:
            return text
        total += len(hit)
        if total > most * n:
            return None
        keep, behind = [], 0
        for k in hit:
            if k - 1 not in hit:
                keep.append(text[behind:at[k][0]].rstrip(" "))
            behind = at[k][1]
        text = "\n".join([*keep, text[behind:].lstrip(" ")])


def test_cut_texts_like_a_plain_loop(docs, prepared):
    import random
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([3, 4, 4, 5, 2, 9])]
    b = prepared.createDataFrame(items, "item_id bigint, text string")
    plain = [(str(k), plain_words(t)) for k, t in items]
    rows = [(k, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "  ", ".\n", " é "]) for _ in range(rng.randrange(60)))) for k in range(150)]
    rows += [(1000, "v0 " * 3 + "x " * 40_000 + items[5][1] + " y" * 40_000), (1001, None), (1002, "")]
    for most in (0.2, 0.7, 1.0):
        want = {k: c for k, t in rows if (c := plain_clean(t, plain, 4, most)) is not None or t is None}
        for parts in (200_000, 6):
            got = {r["doc_id"]: r["text"] for r in decontam.clean(docs(rows), b, window=4, max_coverage=most, part_words=parts).collect()}
            assert got == want
    assert any(t != dict(rows)[k] for k, t in want.items())


def test_joined_ends_hold_no_window_and_a_common_word_empties_nothing(docs, prepared):
    b = prepared.createDataFrame([(1, "a b c d e f g h i j"), (2, "p q r"), (3, "the")], "item_id bigint, text string")
    text = "start here with some words p a b c d e f g h i j q r and many more words to the end of it all as is"
    rows = [(1, text), (2, "the rain in spain falls mainly on the plain and nowhere else in all of spain")]
    got = {r["doc_id"]: r["text"] for r in decontam.clean(docs(rows), b, max_coverage=0.7).collect()}
    assert set(got) == {1, 2} and "q" not in got[1].split() and "the" not in got[2].split() and "rain in spain" in got[2]
    assert got[1].split() == "start here with some words and many more words to end of it all as is".split()


def test_extra_columns_of_any_name_stay(docs, prepared):
    b = prepared.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    d = docs([(1, "w " * 20 + "a b c"), (2, "x")])
    for name in ("__found", "found", "words_before", "words_cut", "more_found", "Found"):
        out = decontam.clean(d.withColumn(name, F.lit("mine")), b)
        assert out.columns == [*d.columns, name] and {r[name] for r in out.collect()} == {"mine"}
