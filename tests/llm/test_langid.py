"""Held-out accuracy on the given documents, and the algebra of the profiles against a plain version."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tabflaw.llm import langid


def test_bundle_is_the_plain_sum():
    def vector(c):
        return langid._letter_vector(ord(c) if c != " " else 0).astype(int)

    text = " ab ba a "
    plain = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(text, text[1:], text[2:]))
    got, has = langid._bundles(["Ab!!BA--a", None, "", "12 ?!"])
    assert (got[0] == plain).all()
    assert has.tolist() == [True, False, False, False]


def test_pieces_count_like_the_whole(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 50
    codes, counts = langid.grams(text)
    for piece in (1, 2, 7, 97):
        monkeypatch.setattr(langid, "PIECE", piece)
        codes2, counts2 = langid.grams(text)
        assert (codes == codes2).all() and (counts == counts2).all()


def test_held_out_accuracy(prepared):
    d = prepared.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = langid.identify(d)
    rows = got.join(d.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == d.count() and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_edges(docs, prepared):
    rows = [(1, "der die das und nicht", "de"), (2, "the of and to in", "en"), (3, "the the of and", "en"), (4, None, "en"),
            (5, "", "de"), (6, "12345 ...", "de"), (None, "the and of", "en"), (8, "x" * 5000, None), (3, "the the of and", "en"),
            (9, "der und das", "de"), (11, "und der die", "de")]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs(rows)).collect()}
    assert langid.identify(docs(rows)).count() == len(rows)
    assert {(4, "und"), (5, "und"), (6, "und")} <= got
    # nothing to learn from: all und; empty table: empty
    assert {r["lang_pred"] for r in langid.identify(docs([(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify(docs([(1, "abc", None)]).filter("doc_id < 0")).count() == 0
    # a clashing extra column is ignored
    assert langid.identify(docs(rows).withColumn("score", F.lit("x"))).count() == len(rows)
