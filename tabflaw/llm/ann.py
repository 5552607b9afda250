"""Approximate nearest neighbours over learned partitions.

Learning uses a bounded sample (SAMPLE vectors, chosen by a hash of the id):
its graph of nearest neighbours is partitioned into PARTS balanced parts by
recursive bisection (each half takes the nodes on one side of the graph's
second eigenvector's median, then pairs are swapped while edges between the
halves become fewer), and a small classifier (one hidden layer) learns to tell
from a vector in which parts its neighbours lie.  How many parts a query
probes is set on queries that the classifier has not seen: as many as are
needed for RECALL of their true neighbours in the sample.

Every row is indexed, under its most probable part, and every query goes to
its most probable parts: as many as were set, and more while they hold fewer
than k rows.  Rows and queries of a part meet in blocks: a part is dealt into
blocks of about BLOCK rows and of as many queries, every block of rows meets
every block of queries, so neither a crowded part nor a much repeated vector
gathers in a task.  A block ranks by inner products in double precision and
reports k per query; the reports are ranked once more.

Order: larger inner product first, then smaller id.  Products are rounded the
same way wherever a vector stands, so equal vectors tie exactly.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components take no part, nor do rows with a null id, nor vectors of
another dimension than most.  Rows that repeat an id are one candidate, with
its best product, and never answer a query of that id.  If there are fewer
than k candidates, all are returned.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
PARTS = 32                       # a power of two
SAMPLE = 4096                    # vectors that the partition and the classifier are learned from
NEIGHBOURS = 16                  # edges per vector of the sample's graph
HIDDEN, STEPS, RATE = 64, 250, 0.01
RECALL = 0.95                    # of sample queries' neighbours, within the parts that are probed
BLOCK = 4096                     # rows of a part that meet in a task at once
ASKED = 8192                     # queries of a lane; every block of rows meets every lane of queries
_SEED = 7


# --- learning (numpy, on the sample) ----------------------------------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's k largest inner products with the others, and the symmetric 0/1 adjacency of that."""
    n = len(x)
    near = np.empty((n, min(k, n - 1)), np.int64)
    for at in range(0, n, 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at:at + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, :near.shape[1]] if near.shape[1] else near[at:at + 1024]
    a = np.zeros((n, n), np.float32)
    a[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    return near, np.maximum(a, a.T)


def bisect(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two halves of equal size (one node apart at most) of a graph, with few edges between them."""
    n = len(a)
    degree = a.sum(axis=1) + 1e-6
    scale = 1 / np.sqrt(degree)
    top = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
    v = rng.standard_normal(n).astype(np.float32)
    for _ in range(60):                                     # power iteration on the normalised graph, shifted to be positive
        v = v - top * (top @ v)
        v = v + scale * (a @ (scale * v))
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[n // 2:]] = True
    for _ in range(20):                                     # swap the pairs that gain most
        to_true = a @ side.astype(np.float32)
        gain = np.where(side, degree - 2 * to_true, 2 * to_true - degree)
        left, right = np.nonzero(~side)[0], np.nonzero(side)[0]
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        swap = gain[left[:m]] + gain[right[:m]] - 2 * a[left[:m], right[:m]] > 0
        if not swap.any():
            break
        before, old = _cut(a, side), side.copy()
        side[left[:m][swap]], side[right[:m][swap]] = True, False
        if _cut(a, side) >= before:
            return old
    return side


def _cut(a: np.ndarray, side: np.ndarray) -> float:
    return float(a[side][:, ~side].sum())


def balanced_parts(a: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node: recursive bisection into ``parts`` (a power of two) parts of nearly equal size."""
    rng = np.random.default_rng(_SEED)
    out = np.zeros(len(a), np.int64)
    step = parts
    while step > 1:
        for p in range(0, parts, step):
            mine = np.nonzero(out == p)[0]
            if len(mine) > 1:
                out[mine[bisect(a[np.ix_(mine, mine)], rng)]] += step // 2
        step //= 2
    return out


class Router:
    """A classifier with one hidden layer over scaled vectors; gives each part's log odds."""

    def __init__(self, x: np.ndarray, goal: np.ndarray):
        rng = np.random.default_rng(_SEED)
        self.scale = 1 / (np.sqrt((x ** 2).sum(axis=1).mean()) + 1e-12)
        d, p = x.shape[1], goal.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d) * 3, np.zeros(HIDDEN),
                  rng.standard_normal((HIDDEN, p)) * np.sqrt(1 / HIDDEN), np.zeros(p)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        z = x * self.scale
        for t in range(1, STEPS + 1):
            h = np.maximum(z @ self.w[0] + self.w[1], 0)
            o = h @ self.w[2] + self.w[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            e = (o / o.sum(axis=1, keepdims=True) - goal) / len(z)
            b = (e @ self.w[2].T) * (h > 0)
            for i, g in enumerate((z.T @ b, b.sum(axis=0), h.T @ e, e.sum(axis=0))):
                g = g + 1e-4 * self.w[i] * (i % 2 == 0)
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] -= RATE * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The parts of each vector, most probable first."""
        return np.argsort(-self.odds(x), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int = PARTS, k: int = K, recall: float = RECALL) -> tuple[Router, int]:
    """A router learned from the sample, and how many parts a query probes."""
    n = len(sample)
    if n < 4 * parts:                                       # too few to learn from: one part
        return Router(np.zeros((1, sample.shape[1] if sample.ndim > 1 else 1)), np.ones((1, 1))), 1
    near, graph = neighbour_graph(sample, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    goal = np.zeros((n, parts))
    for j in range(near.shape[1]):
        goal[np.arange(n), part[near[:, j]]] += 1
    goal[np.arange(n), part] += 1
    goal /= goal.sum(axis=1, keepdims=True)
    test = np.arange(n) % 5 == 0                            # queries for the number of probes: not learned from
    probing = Router(sample[~test], goal[~test])
    index = probing.parts(sample)[:, 0]
    true, _ = neighbour_graph_of(sample, np.nonzero(test)[0], k)
    order = probing.parts(sample[test])
    at = np.argsort(order, axis=1)                          # at which probe each part is reached
    reached = np.take_along_axis(at, index[true], axis=1)
    share = np.array([(reached < t).mean() for t in range(1, parts + 1)])
    probes = int(np.searchsorted(share, recall) + 1)
    return Router(sample, goal), min(probes, parts)


def neighbour_graph_of(x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of some rows, and their products."""
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    return near, np.take_along_axis(s, near, axis=1)


# --- blocks -----------------------------------------------------------------------------------------------------

def block_nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query its k nearest in a block as (query, id, product) arrays; ties to the smaller id, the own id left out."""
    out_q, out_i, out_s = [], [], []
    longest = np.sqrt((x ** 2).sum(axis=1).max()) if len(x) else 0.0
    unique = len(np.unique(ids)) == len(ids)
    for at in range(0, len(q), 256):
        part = q[at:at + 256]
        s = part @ x.T
        s[query_ids[at:at + 256, None] == ids[None, :]] = -np.inf
        for row, one, qid in zip(s, part, query_ids[at:at + 256], strict=True):
            if unique and len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                if least == -np.inf:
                    mine = np.nonzero(row > -np.inf)[0]
                else:                                       # whatever may tie after rounding is compared exactly
                    mine = np.nonzero(row >= least - 1e-12 * longest * np.sqrt(one @ one) - 1e-300)[0]
            else:
                mine = np.nonzero(row > -np.inf)[0]
            exact = (x[mine] * one).sum(axis=1)
            order = np.lexsort((ids[mine], -exact))
            if not unique:
                _, first = np.unique(ids[mine][order], return_index=True)
                order = order[np.sort(first)]
            order = order[:k]
            out_q.append(np.full(len(order), qid))
            out_i.append(ids[mine][order])
            out_s.append(exact[order])
    return [np.concatenate(c) if c else np.empty(0) for c in (out_q, out_i, out_s)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_META = ("part", "block", "queries", "is_query")


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K,
           parts: int = PARTS, sample: int = SAMPLE, block: int = BLOCK, recall: float = RECALL,
           probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` holds.

    ``probes`` fixes the parts that a query visits (``parts``: exact search).
    """
    v = F.col(vector)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q")).filter(
        F.coalesce(sound, F.lit(False)))
    dims = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id bigint, vec_id bigint, score double"
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = dims[0]["d"], dims[0]["n"]
    given = given.filter(F.size("v") == dim)
    share = min(1.0, 1.2 * sample / total)                  # then the smallest hashes: a bounded sample, the same in every run
    picked = given.select("v", F.xxhash64("id").alias("h")).filter(F.pmod("h", F.lit(1_000_003)) <= share * 1_000_003) \
        .orderBy("h").limit(sample).collect()
    router, found = fit(np.array([r["v"] for r in picked], np.float64), parts, k, recall)
    probes = found if probes is None else probes
    n_parts = router.w[3].size

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best = router.odds(_matrix(b.column("v"))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("q"), pa.array(best, pa.int32())],
                                                 names=["id", "v", "q", "part"])

    kind = dict(given.dtypes)["v"]
    indexed = written(given.mapInArrow(assign, f"id bigint, v {kind}, q boolean, part int"), "ann-index")
    sizes = {r["part"]: (r["n"], r["m"]) for r in indexed.groupBy("part").agg(
        F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("m")).collect()}        # a row per part
    rows_in = np.array([sizes.get(p, (0, 0))[0] for p in range(n_parts)])
    blocks = np.maximum(1, -(-rows_in // block))
    n_queries = sum(m or 0 for _, m in sizes.values())
    query_blocks = int(max(1, -(-n_queries * min(1.0, 2 * probes / n_parts) // ASKED)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's block, once for every block of queries; a query's blocks: all of each part it visits."""
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            part = b.column("part").to_numpy(zero_copy_only=False)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = (mixed % blocks[part].astype(np.uint64)).astype(np.int64)
            lane = ((mixed >> np.uint64(7)) % np.uint64(query_blocks)).astype(np.int64)
            at = np.repeat(np.arange(len(ids)), query_blocks)
            meta = [np.stack((part[at], own[at], np.tile(np.arange(query_blocks), len(ids)), np.zeros(len(at), np.int64)))]
            source = [at]
            asks = np.nonzero(b.column("q").to_numpy(zero_copy_only=False) == True)[0]      # noqa: E712 - null is no query
            if len(asks):
                order = router.parts(_matrix(b.column("v").take(pa.array(asks))))
                held = np.cumsum(rows_in[order], axis=1)
                visits = np.maximum(probes, (held < k + 1).sum(axis=1) + 1)
                for i, ps, n in zip(asks, order, visits, strict=True):
                    ps = ps[:n]
                    ps = ps[rows_in[ps] > 0]
                    p = np.repeat(ps, blocks[ps])
                    c = np.concatenate([np.arange(blocks[x]) for x in ps])
                    meta.append(np.stack((p, c, np.full(len(p), lane[i]), np.ones(len(p), np.int64))))
                    source.append(np.full(len(p), i))
            meta, source = np.concatenate(meta, axis=1), pa.array(np.concatenate(source))
            for s in range(0, len(source), 4096):
                take = source[s:s + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[s:s + 4096], pa.int32()) for m in meta] + [b.column("id").take(take), b.column("v").take(take)],
                    names=[*_META, "id", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: a block's candidates, then its queries, which are answered as they come."""
        key, ids, vectors, asked = None, [], [], []

        def answer() -> list[np.ndarray]:
            if not asked or not ids:
                return []
            return block_nearest(np.concatenate(ids), np.concatenate(vectors), np.concatenate([a for a, _ in asked]),
                                 np.concatenate([a for _, a in asked]), k)

        for b in batches:
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _META])
            cuts = [0, *(np.nonzero((m[:, 1:] != m[:, :-1]).any(axis=0))[0] + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                now = tuple(m[:3, s].tolist())
                if now != key:
                    if got := answer():
                        yield _answers(got)
                    key, ids, vectors, asked = now, [], [], []
                piece = b.slice(s, e - s)
                own, x = piece.column("id").to_numpy(zero_copy_only=False), _matrix(piece.column("v"))
                if m[3, s]:
                    asked.append((own, x))
                else:
                    ids.append(own)
                    vectors.append(x)
        if got := answer():
            yield _answers(got)

    dealt = indexed.mapInArrow(deal, f"part int, block int, queries int, is_query int, id bigint, v {kind}")
    near = dealt.repartition("part", "block", "queries").sortWithinPartitions(*_META).mapInArrow(scan, out)
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(got: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)),
                                       pa.array(got[2].astype(np.float64))], names=["query_id", "vec_id", "score"])
