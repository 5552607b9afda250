"""Conversation repair against a plain programme over rows, whatever the runs, pieces and tasks."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import types as T

from conftest import SF_CHECK
from tabflaw.llm import dialogues as D

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, [(turn, role, text)]) after the test damage, each in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        got = out[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            got += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def h64(text):
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def plain_one(rows):
    """The report of one conversation by a programme over every row and state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), h64(r[2])))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] or " " for r in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(k, state, inserted):
        found = []
        if k == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in step:
                    c, a, r = best(k, step[state, name[0]], inserted + 1)
                    found.append((c + 5, "I" + a, (f"{name}:", r)))
        if k < len(rows):
            _, role, text = rows[k]
            c, a, r = best(k + 1, state, 0)
            found.append((c + 2, "D" + a, r))
            if faults[k] not in ("blank", "duplicate"):
                extra = 5 if faults[k] == "truncated" else 0
                if (state, initials[k]) in step:
                    c, a, r = best(k + 1, step[state, initials[k]], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", r)))
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        c, a, r = best(k + 1, step[state, name[0]], 0)
                        found.append((c + 1 + extra, "R" + a, (f"{name}:{text}", r)))
        return min(found, key=lambda x: x[:2]) if found else (1 << 60, "", ())

    cost, audit, lines = 0, "", ()
    for k in range(len(rows), -1, -1):           # fills the cache from the back, so recursion stays flat
        for state in range(4):
            for n in range(3, -1, -1):
                best(k, state, n)
    if rows:
        cost, audit, lines = best(0, 0, 0)
    flat = []
    while lines:
        flat.append(lines[0])
        lines = lines[1]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            wrong, cost, audit, hashlib.sha256("\n".join(flat).encode()).hexdigest()), flat


def check(spark, rows, partitions=3, query=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r["conv_id"]: tuple(r)[1:] for r in D.repair_report(D.damage(df), alive="alive").collect()}
    want = {conv: plain_one(mine) for conv, mine in damaged(rows).items()}
    assert set(got) == set(want)
    for conv, (report, _) in want.items():
        assert got[conv] == report, (conv, got[conv], report)
    fixed = defaultdict(list)
    for r in D.repaired_rows(D.damage(df), alive="alive").orderBy("conv_id", "segment", "position").collect():
        fixed[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: v for c, v in fixed.items()} == {c: flat for c, (_, flat) in want.items() if flat}
    return got


def made(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Go on!", " \t", "", None, "Well? ", "cut off here", "Ünd.", "a.b", "\x00!", "so.\x85"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant", "user2"]
    rows = []
    for conv in [*range(conversations), None]:
        n = rng.randrange(most)
        for t in range(n):
            turn = rng.choice([t, t, t, t, t * 2, None, rng.randrange(n)])
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Text {t}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, turn, role, text))
    return rows + [(1000 + k, 0, "user", "Hi.") for k in range(30)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_random_conversations(prepared, partitions):
    check(prepared, made(partitions, 150, 12), partitions)


def test_pieces_and_edges(prepared, monkeypatch):
    monkeypatch.setattr(D, "PIECE_ROWS", 3)
    check(prepared, made(11, 40, 25), 4)


def test_hot_conversation_over_tasks(prepared, monkeypatch):
    """One conversation over all tasks, with long runs of one symbol and repeats far apart."""
    monkeypatch.setattr(D, "PIECE_ROWS", 50)
    rng = random.Random(5)
    rows = [(7, t, "user" if t < 900 else rng.choice(["user", "assistant", "system", "x"]), f"T{t}." if t % 7 else "Same again.") for t in range(1500)]
    rows += [(7, 5000, "assistant", "Copy.")] * 300 + [(8, 1, "user", "Q."), (8, 2, "assistant", "A."), (9, None, "system", "S.")]
    got = check(prepared, rows, 4)
    assert len(got) == 3


def test_runs_agree_with_single_rows():
    rng = random.Random(1)
    for _ in range(300):
        runs = [((rng.choice("sua-"), rng.choice([D.OK, D.CUT, D.GONE])), rng.choice([1, 1, 2, 3, 5, 17, 64])) for _ in range(rng.randrange(1, 6))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        state = rng.randrange(4)
        a, b = D.choices(runs, state, D.END), D.choices(single, state, D.END)
        assert a == b
        m = D.matrix_of(runs)
        assert D._apply(m, D.END)[state] == a[1]
    # a very long run costs no more steps than its digits
    letters, cost, _ = D.choices([(("u", D.OK), 1_000_001)], 0, D.END)
    assert len(D.edits(letters)) == 1_000_001 and cost < 1_000_002


def test_given_conversations(prepared):
    rows = [tuple(r) for r in prepared.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = check(prepared, rows)
    assert len(got) == len({r[0] for r in rows})


def test_empty_table_and_clashing_columns(prepared):
    empty = prepared.createDataFrame([], SCHEMA)
    assert D.repair_report(D.damage(empty), alive="alive").collect() == []
    assert D.repaired_rows(D.damage(empty), alive="alive").collect() == []
    rows = [(1, 1, "user", "Q."), (1, 2, "assistant", "A " + "very long " * 300_000 + ".")]
    df = prepared.createDataFrame(rows, SCHEMA)
    plain = D.repair_report(df).collect()
    more = df.selectExpr("*", "1 as part", "'x' as key", "2 as at", "false as alive", "3 as hash", "0 as done", "7 as copy")
    assert D.repair_report(more).collect() == plain
    assert plain[0]["audit"] == "KK" and plain[0]["cost"] == 0
