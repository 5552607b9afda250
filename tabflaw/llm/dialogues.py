"""Repair of conversation structure by a run-length dynamic programme.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``: nothing, or an optional system turn and then user and
assistant in turn.  Rows may be kept, reroled to user or assistant, deleted,
and empty user or assistant rows inserted; blank and repeated rows must go, and
a truncated row that stays costs extra.

A row is a symbol: the class of its role's initial and its fault.  Equal
consecutive symbols are collapsed to runs.  What a symbol costs between the
four states of the pattern is a min-plus matrix; its powers of two are made
once and kept, so a run of any length is crossed by the binary digits of its
length.  Going backwards over the runs gives the cost still to come at each of
their borders; going forwards, each run's choices are unrolled by halving it
along the same powers (equal halves are looked up, not unrolled again), always
taking the least letter that keeps the cost, so the audit is the least of all
cheapest ones.

Rows are sorted over all tasks by conversation, turn (nulls first), role, hash
of the text, and input order.  A conversation inside one task is finished
there, texts being read once.  What lies at the edges of tasks -- and that is
where a conversation of any size ends up -- is written as segments (one per
task and conversation) and bounded pieces of texts: repeats between segments
are found by an aggregation, a segment's symbols give one matrix, the product
of matrices gives the cost still to come behind each segment, each segment maps
the state it is entered in to the one it is left in, and every segment is
unrolled by itself.  Only the digest of a conversation's whole text is made in
order, from prepared pieces, as SHA-256 asks for it.

Defined results: a null role or text is one blank; a null turn counts in no
gap; rows without a conv_id are one conversation.  A role's initial is its
first character (a blank for an empty role); other initials than s, u, a fit
nowhere.  Repeated rows and rows of one turn are taken in the order above.  An
empty table gives no rows.  Columns other than the four named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf, written

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A piece holds at most this many rows, and (but for one row) this many bytes of text.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
_NONE = 1 << 60                                    # no way
_START, _S, _U, _A = range(4)                      # nothing yet; behind s; behind u; behind a
_TURN = (_U, _U, _A, _U)                           # state behind an inserted or reroled row
_KEEP = {"s": (_S, None, None, None), "u": (_U, _U, None, _U), "a": (None, None, _A, None), "-": (None,) * 4}
_END = (0, _NONE, _NONE, 0)                        # cost behind the last row, without insertions
_BLANK = " \t\n\x0b\x0c\r"
OK, CUT, GONE = "ok", "cut", "gone"                # faults, as far as costs go


def _apply(matrix: tuple, vector: tuple) -> tuple:
    return tuple(min(map(int.__add__, row, vector)) for row in matrix)


def _times(a: tuple, b: tuple) -> tuple:
    columns = tuple(zip(*b))
    return tuple(tuple(min(_NONE, min(map(int.__add__, row, c))) for c in columns) for row in a)


def _insertions() -> tuple:
    """Costs of going from state to state by insertions alone."""
    out = []
    for i in range(4):
        row, at, cost = [_NONE] * 4, i, 0
        while row[at] == _NONE:
            row[at] = cost
            at, cost = _TURN[at], cost + INSERT
        out.append(tuple(row))
    return tuple(out)


INSERTIONS = _insertions()
END = _apply(INSERTIONS, _END)


def _options(symbol: tuple[str, str], state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row in a state, insertions aside, least letter first."""
    initial, fault = symbol
    out = [("D", DELETE, state)]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if _KEEP[initial][state] is not None:
            out.append(("K", extra, _KEEP[initial][state]))
        out.append(("R", REROLE + extra, _TURN[state]))
    return out


@functools.cache
def power(symbol: tuple[str, str], k: int) -> tuple:
    """Min-plus matrix of 2^k rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    own = [[_NONE] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in _options(symbol, i):
            own[i][j] = min(own[i][j], cost)
    return _times(INSERTIONS, tuple(map(tuple, own)))


def run_cost(symbol: tuple[str, str], n: int, behind: tuple) -> tuple:
    """Cost from each state over ``n`` rows of a symbol and what is behind."""
    k = 0
    while n:
        if n & 1:
            behind = _apply(power(symbol, k), behind)
        n, k = n >> 1, k + 1
    return behind


@functools.lru_cache(maxsize=1 << 16)
def _row(symbol: tuple[str, str], state: int, behind: tuple) -> tuple[str, int]:
    """Least cheapest letters for one row, and the state after it."""
    letters = ""
    while True:
        stay = min(cost + behind[j] for _, cost, j in _options(symbol, state))
        best = min(stay, INSERT + _apply(power(symbol, 0), behind)[_TURN[state]])
        for letter, cost, j in _options(symbol, state):
            if letter == "D" and cost + behind[j] == best:
                return letters + letter, j
        if INSERT + _apply(power(symbol, 0), behind)[_TURN[state]] == best:
            letters, state = letters + "I", _TURN[state]
            continue
        return next((letters + letter, j) for letter, cost, j in _options(symbol, state) if cost + behind[j] == best)


@functools.lru_cache(maxsize=1 << 14)
def _block(symbol: tuple[str, str], k: int, state: int, behind: tuple) -> tuple[str, int]:
    """Letters for 2^k rows of a symbol; ``behind`` is less its least entry, so equal blocks are found again."""
    if not k:
        return _row(symbol, state, behind)
    first, middle = _block(symbol, k - 1, state, _level(_apply(power(symbol, k - 1), behind)))
    second, last = _block(symbol, k - 1, middle, behind)
    return first + second, last


_KEPT = 12                        # blocks up to 2^12 rows are kept for look-up


def _level(vector: tuple) -> tuple:
    least = min(vector)
    return tuple(min(v - least, _NONE) if v < _NONE else _NONE for v in vector)


def _unroll(symbol: tuple[str, str], n: int, state: int, behind: tuple) -> tuple[list[str], int]:
    """Letters for a run of ``n`` rows, in blocks from its front to its back."""
    sizes = []
    while n:
        sizes.append(k := min(n.bit_length() - 1, _KEPT))
        n -= 1 << k
    borders = [behind]
    for k in reversed(sizes):
        borders.append(_apply(power(symbol, k), borders[-1]))
    out = []
    for k, border in zip(sizes, borders[-2::-1]):
        letters, state = _block(symbol, k, state, _level(border))
        out.append(letters)
    return out, state


def runs_of(symbols: list[tuple[str, str]]) -> list[tuple[tuple[str, str], int]]:
    return [(s, sum(1 for _ in g)) for s, g in itertools.groupby(symbols)]


def matrix_of(runs: list[tuple[tuple[str, str], int]]) -> tuple:
    """Min-plus matrix of a stretch of rows: column j is the cost over it if only state j is allowed behind."""
    columns = []
    for j in range(4):
        behind = tuple(0 if i == j else _NONE for i in range(4))
        for symbol, n in reversed(runs):
            behind = tuple(min(v, _NONE) for v in run_cost(symbol, n, behind))
        columns.append(behind)
    return tuple(zip(*columns))


def choices(runs: list[tuple[tuple[str, str], int]], state: int, behind: tuple) -> tuple[str, int, int]:
    """Letters of the rows from a state, the cost of all from here on, and the state behind the stretch."""
    borders = [behind]
    for symbol, n in reversed(runs):
        borders.append(run_cost(symbol, n, borders[-1]))
    cost, letters = borders[-1][state], []
    for (symbol, n), border in zip(runs, borders[-2::-1]):
        part, state = _unroll(symbol, n, state, border)
        letters += part
    return "".join(letters), cost, state


def closing(state: int) -> str:
    """Insertions behind the last row."""
    letters = ""
    while _END[state]:
        letters, state = letters + "I", _TURN[state]
    return letters


_EDIT = re.compile("I*[DKR]")


def edits(letters: str) -> list[str]:
    """Letters by row; what is inserted before a row goes with it."""
    return _EDIT.findall(letters)


def apply_edits(rows: list[tuple[str, str]], letters: list[str], state: int) -> list[tuple[str, str]]:
    """Repaired (role, text) rows; ``letters`` may have one entry more, for insertions behind the last row."""
    names = {_U: "user", _A: "assistant"}
    out = []
    for k, row in enumerate(letters):
        for letter in row:
            if letter == "D":
                continue
            if letter == "K":
                state = _KEEP[symbol_class(rows[k][0])][state]
                out.append(rows[k])
            else:
                state = _TURN[state]
                out.append((names[state], "" if letter == "I" else rows[k][1]))
    return out


def symbol_class(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


def symbols_of(rows: list[tuple[str, str]], seen: set) -> list[tuple[str, str, str]]:
    """(class, what it costs, fault) of (role, text) rows; ``seen`` holds the rows before."""
    out = []
    for role, text in rows:
        bare = text.rstrip(_BLANK)
        key = (role, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        if not bare:
            out.append((symbol_class(role), GONE, "blank"))
        elif key in seen:
            out.append((symbol_class(role), GONE, "duplicate"))
        elif bare[-1] not in ".!?":
            out.append((symbol_class(role), CUT, "truncated"))
        else:
            out.append((symbol_class(role), OK, ""))
        seen.add(key)
    return out


_LEGAL = {"su", "ua", "au"}


def illegal(classes: str) -> int:
    """Neighbours whose initials don't follow each other."""
    return sum(classes[k:k + 2] not in _LEGAL for k in range(len(classes) - 1))


FAULTS = ("blank", "duplicate", "truncated")


def finish(rows: list[tuple[str, str]], turns: list[int | None]) -> dict:
    """What ``repair`` says of one whole conversation, and its repaired rows."""
    marked = symbols_of(rows, set())
    runs = runs_of([m[:2] for m in marked])
    letters, cost, state = choices(runs, _START, END)
    last = closing(state)
    known = {t for t in turns if t is not None}
    faults = [m[2] for m in marked]
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, **{f: faults.count(f) for f in FAULTS},
            "illegal": illegal("".join(m[0] for m in marked)), "cost": cost, "audit": letters + last,
            "rows": apply_edits(rows, [*edits(letters), last], _START)}


def joined(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8", "surrogatepass")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive after the test damage: by crc32 of ``conv_id:turn`` modulo 20, a row is dropped
    (kept here with ``alive`` false, so its conversation is known), emptied, loses ``.!?``, stands twice, or is user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (kind != 0).alias("alive"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


_REPORT = ("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")
_LONGS = ("gaps", *FAULTS, "illegal", "cost")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows sorted over all tasks, each with the number of its task."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    named = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), "alive",
                        F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "at"]
    return named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


class _Emitter:
    """Batches of rows of dicts in one schema."""

    def __init__(self, schema: pa.Schema, limit: int = 512, most_bytes: int = 4 << 20):
        self.schema, self.limit, self.most, self.rows, self.bytes = schema, limit, most_bytes, [], 0

    def add(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= self.limit or self.bytes >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.bytes = [], 0


_PIECE = (("roles", "array<string>", pa.list_(pa.string())), ("texts", "array<string>", pa.list_(pa.string())),
          ("turns", "array<bigint>", pa.list_(pa.int64())), ("part", "int", pa.int32()), ("seq", "int", pa.int32()))


def _first_pass(rows: DataFrame, whole: bool, id_type: str) -> DataFrame:
    """One row per conversation inside a task (with ``done``), and pieces of the first and last conversation of each.

    ``whole``: the repaired rows go with the report (else only their digest).
    """
    report = [(c, "bigint", pa.int64()) for c in _LONGS] + [("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())]
    extra = [("fixed_roles", "array<string>", pa.list_(pa.string())), ("fixed_texts", "array<string>", pa.list_(pa.string()))]
    names = [*report, *extra, *_PIECE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seq = None, 0
        conv, begun, edge = None, False, True           # the first conversation of a task may have begun before
        held: list[tuple[str, str]] = []
        turns: list[int | None] = []
        size, part = 0, 0

        def piece() -> Iterator[pa.RecordBatch]:
            nonlocal held, turns, size, seq
            yield from out.add({"conv_id": conv, "done": False, "roles": [r for r, _ in held], "texts": [t for _, t in held],
                                "turns": turns, "part": part, "seq": seq}, size)
            held, turns, size, seq = [], [], 0, seq + 1

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, turns, size
            if edge or last:
                yield from piece()
                return
            got = finish(held, turns)
            fixed = got.pop("rows")
            if whole:
                got |= {"fixed_roles": [r for r, _ in fixed], "fixed_texts": [t for _, t in fixed]}
            else:
                got["repaired_sha256"] = hashlib.sha256(joined(fixed)).hexdigest()
            yield from out.add({"conv_id": conv, "done": True, **got}, size if whole else 0)
            held, turns, size = [], [], 0

        for batch in batches:
            if out is None:
                out = _Emitter(pa.schema([batch.schema.field("conv_id"), pa.field("done", pa.bool_()), *[pa.field(n, t) for n, _, t in names]]))
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "alive", "part")]
            for c, turn, role, text, alive, part in zip(*columns):
                if not begun or c != conv:
                    if begun:
                        yield from close(False)
                        edge = False
                    conv, begun = c, True
                if alive:
                    held.append((role, text))
                    turns.append(turn)
                    size += len(text)
                    if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                        edge = True                     # more than a piece: finished below, like what crosses tasks
                        yield from piece()
        if begun:
            yield from close(True)
        if out is not None:
            yield from out.flush()

    kinds = ", ".join(f"{n} {k}" for n, k, _ in names)
    return _sorted_rows(rows).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "alive", "part") \
        .mapInArrow(run, f"conv_id {id_type}, done boolean, {kinds}")


_CODES = "ABCDEFGHIJKLMNOP"                        # four classes by four faults
_CLASSES, _COSTS = "sua-", (OK, CUT, GONE, GONE)


def _symbols(codes: str) -> list[tuple[str, str]]:
    return [(_CLASSES[n >> 2], _COSTS[n & 3]) for n in map(_CODES.index, codes)]


def _coded_rows(pieces: DataFrame) -> DataFrame:
    """(key, part, seq, idx, turn, code) of every row in pieces; repeats are found over all pieces, by hashes only."""
    text = F.col("r.texts")
    bare = F.rtrim(text, F.lit(_BLANK))
    first = F.substring("r.roles", 1, 1)
    rows = pieces.select("key", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts", "turns")).alias("idx", "r")) \
        .select("key", "part", "seq", "idx", F.col("r.turns").alias("turn"), F.col("r.roles").alias("role"), F.sha2(text, 256).alias("digest"),
                F.when(first.isin("s", "u", "a"), F.instr(F.lit("sua"), first) - 1).otherwise(3).alias("class"),
                F.when(bare == "", 2).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1).alias("fault"))
    place = F.struct("part", "seq", "idx")
    firsts = rows.groupBy("key", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = F.coalesce((F.col("first") != place) & (F.col("fault") != 2), F.lit(False))
    code = F.col("class") * 4 + F.when(again, 3).otherwise(F.col("fault"))
    return rows.join(firsts, ["key", "role", "digest"], "left") \
        .select("key", "part", "seq", "idx", "turn", F.substring(F.lit(_CODES), code + 1, F.lit(1)).alias("code"))


def _sorted_list(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def _vectors(segments: list[dict]) -> dict:
    """Over a conversation's segments in order (one per task): the cost behind each, the cost of all, neighbours between them."""
    behind, out = END, []
    for s in reversed(segments):
        out.append({"part": s["part"], "behind": list(behind)})
        m = s["matrix"]
        behind = _apply(tuple(tuple(m[4 * i:4 * i + 4]) for i in range(4)), behind)
    between = sum(a["codes"][-1] + b["codes"][0] not in _LEGAL for a, b in zip(segments, segments[1:]))
    return {"each": out[::-1], "cost": behind[_START], "between": between}


def _entries(segments: list[dict]) -> dict:
    """The state each segment is entered in, and the insertions behind the last."""
    state, out = _START, []
    for s in segments:
        out.append({"part": s["part"], "state": state})
        state = s["left"][state]
    return {"each": out, "closing": closing(state), "state": state}


def _udf(fn, returns: str, kind: pa.DataType):
    return text_udf(lambda values: [fn(v) for v in values], returns, kind)


_I64, _STR = pa.int64(), pa.string()


def _segments(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Letters of every piece (key, part, seq, letters, state), and of every conversation the counts and closing insertions."""
    coded = written(_coded_rows(pieces), "dialogue-rows")
    per_piece = coded.groupBy("key", "part", "seq").agg(F.array_join(F.transform(_sorted_list("idx", "code"), lambda x: x["code"]), "").alias("codes"))
    stretches = per_piece.groupBy("key", "part").agg(_sorted_list("seq", "codes").alias("list"))

    def look(pieces_: list[dict]) -> dict:
        symbols = _symbols("".join(p["codes"] for p in pieces_))
        classes = "".join(c for c, _ in symbols)
        return {"matrix": [v for row in matrix_of(runs_of(symbols)) for v in row], "inside": illegal(classes), "codes": classes[0] + classes[-1]}

    seen = _udf(look, "matrix array<bigint>, inside bigint, codes string", pa.struct([("matrix", pa.list_(_I64)), ("inside", _I64), ("codes", _STR)]))
    looked = written(stretches.select("key", "part", "list", seen("list").alias("m")).select("key", "part", "list", "m.*"), "dialogue-segments")
    vectors = _udf(_vectors, "each array<struct<part: int, behind: array<bigint>>>, cost bigint, between bigint", pa.struct(
        [("each", pa.list_(pa.struct([("part", pa.int32()), ("behind", pa.list_(_I64))]))), ("cost", _I64), ("between", _I64)]))
    ahead = written(looked.groupBy("key").agg(_sorted_list("part", "matrix", "codes").alias("s"), F.sum("inside").alias("inside"))
                    .select("key", "inside", vectors("s").alias("v")).select("key", "inside", "v.*"), "dialogue-vectors")

    def unroll(row: dict) -> list[dict]:
        runs, sizes = runs_of(_symbols("".join(p["codes"] for p in row["list"]))), [len(p["codes"]) for p in row["list"]]
        out = []
        for state in range(4):
            letters, _, left = choices(runs, state, tuple(row["behind"]))
            each, at, cut, now = edits(letters), 0, [], state
            for p, n in zip(row["list"], sizes):
                mine = each[at:at + n]
                cut.append({"seq": p["seq"], "letters": "".join(mine), "state": now})
                at += n
                for letter, code in zip(mine, p["codes"]):
                    now = _state_after(letter, _CLASSES[_CODES.index(code) >> 2], now)
            out.append({"left": left, "pieces": cut})
        return out

    piece_kind = pa.list_(pa.struct([("seq", pa.int32()), ("letters", _STR), ("state", pa.int32())]))
    ways = _udf(unroll, "array<struct<left: int, pieces: array<struct<seq: int, letters: string, state: int>>>>",
                pa.list_(pa.struct([("left", pa.int32()), ("pieces", piece_kind)])))
    unrolled = written(looked.select("key", "part", "list").join(ahead.select("key", F.explode("each").alias("e"))
                                                                 .select("key", "e.*"), ["key", "part"])
                       .select("key", "part", ways(F.struct("list", "behind")).alias("ways")), "dialogue-ways")
    entered = _udf(_entries, "each array<struct<part: int, state: int>>, closing string, state int", pa.struct(
        [("each", pa.list_(pa.struct([("part", pa.int32()), ("state", pa.int32())]))), ("closing", _STR), ("state", pa.int32())]))
    left = F.transform("ways", lambda w: w["left"])
    entries = written(unrolled.withColumn("left", left).groupBy("key").agg(_sorted_list("part", "left").alias("s"))
                      .select("key", entered("s").alias("v")).select("key", "v.*"), "dialogue-entries")
    letters = unrolled.join(entries.select("key", F.explode("each").alias("e")).select("key", "e.*"), ["key", "part"]) \
        .select("key", "part", F.explode(F.get("ways", F.col("state"))["pieces"]).alias("p")).select("key", "part", "p.*")
    turns = coded.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key") \
        .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    fault = F.instr(F.lit(_CODES), F.col("code")) - 1
    counts = coded.groupBy("key").agg(*[F.count(F.when(fault % 4 == n, 1)).alias(name) for n, name in ((2, "blank"), (3, "duplicate"), (1, "truncated"))])
    report = ahead.select("key", (F.col("inside") + F.col("between")).alias("illegal"), "cost") \
        .join(entries.select("key", "closing", F.col("state").alias("final")), "key").join(turns, "key").join(counts, "key")
    return letters, report


def _state_after(letters: str, initial: str, state: int) -> int:
    for letter in letters:
        state = _KEEP[initial][state] if letter == "K" else state if letter == "D" else _TURN[state]
    return state


def _fixed_pieces(pieces: DataFrame, letters: DataFrame) -> DataFrame:
    """(key, part, seq, letters, roles, texts) of the repaired rows of every piece."""
    def fix(row: dict) -> dict:
        got = apply_edits(list(zip(row["roles"], row["texts"])), edits(row["letters"]), row["state"])
        return {"roles": [r for r, _ in got], "texts": [t for _, t in got]}

    fixed = _udf(fix, "roles array<string>, texts array<string>", pa.struct([("roles", pa.list_(_STR)), ("texts", pa.list_(_STR))]))
    return pieces.select("key", "part", "seq", "roles", "texts").join(letters, ["key", "part", "seq"]) \
        .select("key", "part", "seq", "letters", fixed(F.struct("roles", "texts", "letters", "state")).alias("f")).select("key", "part", "seq", "letters", "f.*")


def _digests(fixed: DataFrame, report: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256): pieces streamed in their order, a conversation in one task, one piece held."""
    last = F.concat(F.lit("user:"), F.when(F.length("closing") == 2, "\nassistant:").otherwise(""))
    tail = report.filter("closing <> ''").select("key", F.lit(1 << 30).alias("part"), F.lit(0).alias("seq"), F.col("closing").alias("letters"),
                                                 F.when(F.col("final") == _U, "assistant:").otherwise(last).alias("body"))
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    body = F.when(F.size("roles") > 0, F.array_join(lines, "\n"))
    streamed = fixed.select("key", "part", "seq", "letters", body.alias("body")).unionByName(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(pa.schema([("key", _STR), ("audit", _STR), ("repaired_sha256", _STR)]))
        key, audit, sha, first = None, [], hashlib.sha256(), True

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield from out.add({"key": key, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for k, letters, text in zip(*[batch.column(c).to_pylist() for c in ("key", "letters", "body")]):
                if k != key:
                    yield from done()
                    key, audit, sha, first = k, [], hashlib.sha256(), True
                audit.append(letters)
                if text is not None:
                    sha.update((text if first else "\n" + text).encode("utf-8", "surrogatepass"))
                    first = False
        yield from done()
        yield from out.flush()

    return streamed.repartition("key").sortWithinPartitions("key", "part", "seq") \
        .select("key", "letters", "body").mapInArrow(run, "key string, audit string, repaired_sha256 string")


def _pieces(first: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    return first.filter(~F.col("done")).withColumn("key", key)


def _prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, alive: str | None) -> DataFrame:
    live = F.lit(True) if alive is None else F.coalesce(F.col(alive), F.lit(True))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), live.alias("alive"))


def repair_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  alive: str | None = None) -> DataFrame:
    """What each conversation lacks, its cheapest edits and the digest of what they give; one row per conversation.

    Rows with a false ``alive`` only make their conversation known.
    """
    named = _prepared(rows, conv_id, turn, role, text, alive)
    first = written(_first_pass(named, False, named.schema["conv_id"].dataType.simpleString()), "dialogues")
    pieces = _pieces(first)
    letters, report = _segments(pieces)
    report = written(report, "dialogue-report")
    digests = _digests(_fixed_pieces(pieces, letters), report)
    every = pieces.groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    edge = every.join(report, "key", "left").join(digests, "key", "left") \
        .select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _LONGS],
                F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return first.filter("done").select(*_REPORT).unionByName(edge.select(*_REPORT))


def repaired_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  alive: str | None = None) -> DataFrame:
    """conv_id, segment, position, role, text of the repaired conversations, in the order of segment and position."""
    named = _prepared(rows, conv_id, turn, role, text, alive)
    first = written(_first_pass(named, True, named.schema["conv_id"].dataType.simpleString()), "dialogues")
    pieces = _pieces(first)
    letters, report = _segments(pieces)
    ids = pieces.groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    fixed = _fixed_pieces(pieces, letters).join(ids, "key")
    done = first.filter("done").select("conv_id", F.lit(0).alias("segment"), F.lit(0).alias("seq"),
                                       F.posexplode(F.arrays_zip(F.col("fixed_roles").alias("roles"), F.col("fixed_texts").alias("texts"))).alias("at", "r"))
    edge = fixed.select("conv_id", F.col("part").alias("segment"), "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r"))
    behind = F.when(F.col("final") == _U, F.array(F.lit("assistant"))).when(F.length("closing") == 2, F.array(F.lit("user"), F.lit("assistant"))) \
        .otherwise(F.array(F.lit("user")))
    tail = report.filter("closing <> ''").join(ids, "key").select("conv_id", F.lit(1 << 30).alias("segment"), F.lit(0).alias("seq"), F.posexplode(behind).alias("at", "role")) \
        .select("conv_id", "segment", "seq", "at", F.struct(F.col("role").alias("roles"), F.lit("").alias("texts")).alias("r"))
    return done.unionByName(edge).unionByName(tail) \
        .select("conv_id", "segment", (F.col("seq").cast("bigint") * (1 << 32) + F.col("at")).alias("position"), F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))
