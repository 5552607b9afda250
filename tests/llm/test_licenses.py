"""Planted wordings are found, near wordings are told apart, prose is left alone."""

import random
import re

from pyspark.sql import functions as F

from conftest import SF_CHECK
from tabflaw.llm import license_texts, licenses


def found(text):
    return [(text[s:e], name) for s, e, name, *_ in licenses.scan(text)[1]]


def test_every_form_is_recognised_in_prose():
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))

    for name, spelled in license_texts.NAMES.items():
        for s in spelled:
            text = f"{prose(60)}\nThis work is licensed under the {s}. {prose(60)}"
            assert [n for _, n in found(text)] == [name], s
    for name, texts in license_texts.TEXTS.items():
        for t in texts:
            got = {n for _, n in found(f"{prose(80)}\n{t}\n{prose(80)}")}
            assert name in got or (name == "BSD-2-Clause" and "BSD-3-Clause" in got), name


def test_wording_decides_between_neighbours():
    assert found("Licensed under the GNU General Public License, version 2.")[0][1] == "GPL-2.0"
    assert found("Licensed under CC BY-NC 4.0.")[0][1] == "CC-BY-NC-4.0"
    assert found("Licensed under CC BY 4.0.")[0][1] == "CC-BY-4.0"
    assert found("The license of the pub allows music; licensed under protest.") == []
    text = license_texts.TEXTS["MIT"][0].replace("person", "individual")
    (s, e, name, saved, missing, added), = licenses.scan(text)[1]
    assert name == "MIT" and missing >= 1 and added >= 1 and saved > 0.5


def test_documents_like_a_plain_search(prepared, docs):
    """On these documents, whose licence lines are whole sentences, a plain search finds the same documents."""
    lines = {"Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "licensed under the GNU General Public License, version 3": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License": "MIT"}
    d = prepared.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(d).collect()}
    n = 0
    for r in d.collect():
        want = sorted({v for k, v in lines.items() if re.search(rf"(?<![A-Za-z0-9]){re.escape(k)}(?![A-Za-z0-9])", r["text"], re.I)})
        n += len(want)
        assert got[r["doc_id"]] == ",".join(want), r["doc_id"]
    assert n > 3


def test_edges(docs, prepared):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "license " * 3000)]
    got = sorted(((r["doc_id"], r["n_licenses"], r["licenses"]) for r in
                  licenses.license_scan(docs(rows).withColumn("spans", F.lit(1))).collect()), key=repr)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 1, "MIT"), (3, 1, "MIT"), (None, 0, "")], key=repr)
    assert licenses.license_scan(docs(rows).filter("doc_id < 0")).count() == 0


def test_every_licence_of_a_block_is_found():
    """Ten licences in consecutive sentences, and one short statement in a long stretch of licence prose."""
    names = {"ISC": "ISC License", "Zlib": "zlib License", "BSL-1.0": "Boost Software License 1.0", "MIT": "MIT License",
             "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "Apache License 2.0",
             "MPL-2.0": "Mozilla Public License 2.0", "CC-BY-4.0": "CC BY 4.0", "GPL-2.0": "GNU General Public License, version 2"}
    text = " ".join(f"Component {k} is licensed under {s}." for k, s in enumerate(names.values()))
    assert [n for _, n in found(text)] == list(names)
    rng = random.Random(2)
    prose = ["the", "license", "warranty", "of", "this", "copyright", "permission", "notice", "shall", "software", "redistribution", "gpl", "and"]
    for name, (spelled, *_) in license_texts.NAMES.items():
        a, b = (" ".join(rng.choices(prose, k=350)) for _ in range(2))
        assert [n for _, n in found(f"{a}. Released under the {spelled}. {b}")] == [name], name


def test_near_copies_are_taken_from_left_to_right():
    mit = license_texts.TEXTS["MIT"][0]
    other = " ".join(f"word{k}" for k in range(20))
    text = f"{mit.replace('charge', 'cost', 1)} {other} {mit}"
    got = licenses.scan(text)[1]
    assert [(name, missing, added) for _, _, name, _, missing, added in got] == [("MIT", 1, 1), ("MIT", 0, 0)]
    assert got[0][0] == 0 and got[1][0] == text.index("Permission is", 10) and got[0][1] < got[1][0]
    # differences at random places, up to the limit and beyond it, in four copies
    rng = random.Random(3)
    for name in ("MIT", "Zlib", "Unlicense", "Apache-2.0"):
        ws = licenses.WORD.findall(license_texts.TEXTS[name][0])
        limit = len(ws) // licenses.DIFFER
        copies, want = [], []
        for n in (limit, 0, limit + 1, limit - 1):
            copy = list(ws)
            for at in rng.sample(range(1, len(ws) - 1), n):
                copy[at] = None                                    # missing
            copies.append(" ".join(w for w in copy if w))
            want += [(name, n, 0)] if n <= limit else []
        assert [(x, m, a) for _, _, x, _, m, a in licenses.scan(f" {other} ".join(copies))[1]
                if x == name] == want, name


def test_every_opening_with_every_name():
    for opening in license_texts.OPENINGS:
        for name, spelled in license_texts.NAMES.items():
            own = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]
            for s in [*spelled, *own]:
                n, got = licenses.scan(f"Some words before. {opening} {s}.\nAnd some behind it.")
                assert n >= 1 and [g[2] for g in got] == [name], (opening, s)
    assert [n for _, n in found("// SPDX-License-Identifier: MIT\n\n# SPDX-License-Identifier: GPL-2.0+\n")] == ["MIT", "GPL-2.0"]
    assert found("Released under MIT-style terms, distributed under ISCX, released under Zlibs") == []


def _plain(text):
    """Short forms at every place of a text, without blocks, cues or compression: (start word, licence) of the longest."""
    ws, out = licenses.words(text), []
    for t in licenses.default_templates():
        for form in t.forms:
            if len(form) < licenses.LONG:
                out += [(k, k + len(form), t.name) for k in range(len(ws)) if tuple(ws[k:k + len(form)]) == form]
    kept, taken = [], set()
    for s, e, name in sorted(out, key=lambda f: (f[0] - f[1], f[0])):
        if not taken & set(range(s, e)) or (s, e) in {(a, b) for a, b, _ in kept}:
            taken |= set(range(s, e))
            kept.append((s, e, name))
    return kept


def test_the_ranking_by_compression_decides_what_is_compared():
    text = "Some words. Released under the MIT License. Then more words about it."
    assert [n for _, n in found(text)] == ["MIT"]

    def none(block, templates):
        return [(0, 0.0, k) for k in range(len(templates))]

    def others(block, templates):
        return [r for r in licenses.rank(block, templates) if templates[r[2]].name != "MIT"]

    n, got = licenses.scan(text, rank=none)
    assert n == 1 and got == []
    assert licenses.scan(text, rank=others)[1] == []
    # what is reported is the share that the template saves in the block
    (_, _, _, share, _, _), = licenses.scan(text)[1]
    by = {licenses.default_templates()[k].name: s for _, s, k in licenses.rank(tuple(licenses.words(text)), licenses.default_templates())}
    assert share == by["MIT"] > 0


def test_recall_of_the_ranking_against_a_plain_search():
    """Short forms in prose of random words: the blocks of the winners hold what a search of every place finds."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(3000)]
    want = got = every = 0
    for t in licenses.default_templates():
        for form in t.forms:
            if len(form) >= licenses.LONG:
                continue
            for _ in range(2):
                text = " ".join([*rng.choices(vocabulary, k=rng.randrange(0, 70)), *form, *rng.choices(vocabulary, k=rng.randrange(0, 70))])
                plain = {name for _, _, name in _plain(text)}
                want += len(plain)
                got += len(plain & {f[2] for f in licenses.scan(text)[1]} or plain & {t.name} & {f[2] for f in licenses.scan(text)[1]})
                every += t.name in {f[2] for f in licenses.scan(text, min_saved=float("-inf"))[1]}
    assert want > 1000 and got >= 0.99 * want
    assert every >= want - 4                                    # a form of two licences counts for one of them


def test_every_part_of_a_form_lies_in_a_block():
    rng = random.Random(7)
    for t in licenses.default_templates():
        for form in t.forms:
            for offset, unit in licenses.units(form):
                assert len(unit) <= licenses.LONG
                text = tuple(f"w{k}" for k in range(rng.randrange(50))) + unit + tuple(f"v{k}" for k in range(rng.randrange(50)))
                at = text.index(unit[0])
                cut = licenses.blocks(text, licenses.cues_of(licenses.index_of((t,))))
                assert any(a <= at and at + len(unit) <= b for a, b in cut), (t.name, unit)


def test_own_templates():
    own = (licenses.Template("House", ["may be used inside the house only"]), licenses.Template("Garden", ["may be used in the garden only"]))
    text = "This text may be used inside the house only, that one may be used in the garden only."
    assert [f[2] for f in licenses.scan(text, own)[1]] == ["House", "Garden"]
