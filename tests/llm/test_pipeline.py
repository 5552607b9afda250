"""The pipeline against a brute-force version of each stage on the small tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF_CHECK, SF_SMALL
from tabflaw.llm import langid, mixing, shards
from .test_decontam import plain_clean, plain_words
from .test_simhash import plain_classes, plain_fingerprint


def test_stages_follow_brute_force(prepared, monkeypatch):
    seen = {}

    def keep(name, f):
        def stage(spark, docs, sf_dir):
            out = f(spark, docs, sf_dir)
            seen[name] = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
            if name != "sharding":
                assert out.columns == docs.columns
            return out
        return stage

    monkeypatch.setattr(P, "STAGES", [(n, keep(n, f)) for n, f in P.STAGES])
    final = P.run(prepared, SF_SMALL).collect()

    before, after = seen["language_id"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert len(gone) <= 0.02 * len(before)
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] in kept for r in before if r["text"] and sum(c.isalpha() for c in r["text"]) > 100)

    before, after = seen["near_duplicates"]
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in before]
    assert sorted(r["doc_id"] for r in after) == sorted(set(plain_classes(prints, 2)))

    before, after = seen["decontamination"]
    items = [(str(r["item_id"]), plain_words(r["text"])) for r in prepared.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {r["doc_id"]: t for r in before if (t := plain_clean(r["text"], items, 10, 0.2)) is not None}
    assert {r["doc_id"]: r["text"] for r in after} == clean and len(after) == len(clean)
    assert all(r["n_chars"] == len(r["text"]) for r in after) and any(clean.get(r["doc_id"], r["text"]) != r["text"] for r in before)

    before, after = seen["mixing"]
    times = Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 2 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    words = sum(len((r["text"] or "").split()) for r in before)
    assert abs(sum(len((r["text"] or "").split()) for r in after) - 1.5 * words) < 0.25 * words

    assert Counter(r["doc_id"] for r in final) == times
    assert {r["shard"] for r in final} == set(range(16))
    assert langid.UND and mixing.MOST == 2 and shards.SHARDS == 16


def test_foreign_scripts_and_random_letters_go(prepared, docs):
    rng = random.Random(5)
    scripts = {"cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA), "han": (0x4E00, 0x5200), "kana": (0x3042, 0x3094),
               "arabic": (0x621, 0x64B), "latin": (0x61, 0x7B)}
    planted = []
    for first, end in scripts.values():
        letters = [chr(c) for c in range(first, end)]
        for n in [200] * 40 + [20] * 20 + [2000] * 5:
            vocab = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(500 if first != 0x61 else 5000)]
            planted.append((-1 - len(planted), " ".join(rng.choices(vocab, k=n))))
    real = prepared.read.parquet(f"{SF_CHECK}/documents.parquet")
    kept = {r["doc_id"] for r in P.identify_language(prepared, real.unionByName(docs(planted).select(real.columns)), SF_CHECK).collect()}
    assert not [k for k in kept if k < 0]
    rows = real.collect()
    gone = [r["text"] for r in rows if r["doc_id"] not in kept]
    assert all(sum(c.isalpha() for c in t or "") < 100 for t in gone) and len(gone) < 0.005 * len(rows)


def test_stages_on_empty_tables_nulls_repeats_and_clashing_names(prepared, docs, scratch):
    rows = [(k, f"the house of number {k} is on the hill and it has a door and a window " * 3, "en", None if k % 3 else "web") for k in range(40)]
    rows += [rows[0], rows[0], (100, None, None, None), (None, "the house on the hill of the town is old and it is big", "en", None), (101, "", "en", "web")]
    prepared.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    taken = ("identified", "__lang", "__n", "__fp", "simhash_id", "found", "mix_key", "at", "size")
    d = docs(rows)
    for name in taken:
        d = d.withColumn(name, F.lit("mine"))
    for table in (d, d.filter("false")):
        for stage, f in P.STAGES[:-1]:
            out = f(prepared, table, scratch)
            assert out.columns == table.columns, stage
            assert {x for r in out.collect() for x in tuple(r)[5:]} <= {"mine"}, stage
        assert P.STAGES[-1][1](prepared, table, scratch).count() == table.count()
