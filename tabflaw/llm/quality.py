"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: 1 to 3 neighbouring characters (case and
blanks as they stand) and 1 to PATTERN neighbouring words seen only as "equal
to the word before" or not, which tells repetition in any vocabulary.  N-grams
are hashed to 2^BITS buckets.  With p and q the smoothed shares of a bucket
among the indicators of good and of bad texts, its value is log(p / q); a text
is the vector of its buckets' values, of unit length with a constant 1 added.
A linear model with hinge loss is fitted by dual coordinate descent: one dual
variable per text, each in turn set to its best value between 0 and COST, until
a pass over the texts changes none by more than TOLERANCE.  Every fifth text of
the sample is kept out of it and sets the logistic curve that makes margins
scores.

Learning uses a bounded sample: of each label, PER_LABEL ids at most, chosen by
a hash of the id.  Only their ids and labels are broadcast; the features of the
sample are made on all executors and fitted in one task.  Every text is scored
whole, in pieces of PIECE characters; texts are never shuffled.

Defined results: a null text is an empty one, which has the constant only.  An
id labelled both ways counts by majority, and teaches nothing if even; a label
that is null or not 0 or 1 is no label.  Of several texts with one id, the
largest teaches.  If one label has no texts the score of all is the share of
label 1 (0.5 without any label).  Repeated rows are scored alike.  An empty
table gives no rows.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_long, text_udf, written

BITS = 18
DIM = 1 << BITS
ORDERS = (1, 2, 3)
PATTERN = 5
PIECE = 1 << 20
#: Most labelled ids of each label that the model learns from.
PER_LABEL = 16_000
ALPHA = 1.0
COST = 10.0
EPOCHS = 30
TOLERANCE = 1e-3
SEED = 20240601
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, ascending."""
    found: list[np.ndarray] = []
    text = text or ""
    tail, begun, last, flags = "", "", None, []
    for at in range(0, len(text), PIECE):
        piece = text[at:at + PIECE]
        codes = np.frombuffer((tail + piece).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n, np.uint64)
                for step in range(n):
                    h = (h * _MIX) ^ codes[step:len(codes) - n + 1 + step]
                    h ^= h >> np.uint64(31)
                found.append(h)
        words = (begun + piece).split()
        begun = words.pop() if words and at + PIECE < len(text) and not piece[-1].isspace() else ""     # goes on in the next piece
        equal = flags + [int(a == b) for a, b in zip([last, *words], words)]
        bits = np.array(equal, np.uint64)
        for n in range(1, PATTERN + 1):
            if len(bits) >= n:
                h = np.zeros(len(bits) - n + 1, np.uint64)
                for step in range(n):
                    h = h * np.uint64(2) + bits[step:len(bits) - n + 1 + step]
                found.append(np.unique(h) + np.uint64((1 << 40) * n))
        tail, last, flags = (tail + piece)[-(max(ORDERS) - 1):], words[-1] if words else last, equal[-(PATTERN - 1):]
        if len(found) > 16:
            found = [np.unique(np.concatenate(found))]
    if not found:
        return np.empty(0, np.int32)
    h = np.concatenate(found) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h >> np.uint64(64 - BITS)).astype(np.int32))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of a bucket's share among the indicators of the good rows over that among the bad ones."""
    logs = []
    for label in (True, False):
        mine = [f for f, y in zip(rows, good) if y == label]
        counts = np.bincount(np.concatenate(mine), minlength=DIM) + ALPHA
        logs.append(np.log(counts / counts.sum()))
    return logs[0] - logs[1]


def descend(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS,
            tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, constant and dual variables of the hinge-loss model, by dual coordinate descent (every row has length 1)."""
    values = [ratios[f] for f in rows]
    scale = [1.0 / np.sqrt(v @ v + 1.0) for v in values]
    weights, constant, dual = np.zeros(DIM), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(rows)):
            sign = 1.0 if good[k] else -1.0
            margin = sign * scale[k] * (weights[rows[k]] @ values[k] + constant)
            new = min(max(dual[k] + 1.0 - margin, 0.0), cost)      # the row's length is 1
            step = new - dual[k]
            if step:
                dual[k] = new
                weights[rows[k]] += step * sign * scale[k] * values[k]
                constant += step * sign * scale[k]
                most = max(most, abs(step))
        if most < tolerance:
            break
    return weights, constant, dual


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve of score over margin (Newton's method, targets drawn in by one text a side)."""
    n1, n0 = int(good.sum()), int((~good).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        v = p * (1 - p)
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()])
        hessian = np.array([[(v * margins * margins).sum() + 1e-9, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1 (a null id: learns)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label: str, per_label: int = PER_LABEL) -> DataFrame:
    """(id, good, order) of at most ``per_label`` ids of each label."""
    votes = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.sum(F.col(label) * 2 - 1).alias("v"))
    votes = written(votes.filter("v <> 0").select("id", (F.col("v") > 0).alias("good"), F.xxhash64("id").alias("order")), "quality-votes")
    parts = []
    for good in (True, False):
        mine = votes.filter(F.col("good") == good)
        share = min(1.0, 2.0 * per_label / max(1, one_long(mine, F.count("*"))))      # so few tasks' rows meet for the limit
        parts.append(mine.filter(F.pmod("order", F.lit(1_000_003)) <= share * 1_000_003).orderBy("order", "id").limit(per_label))
    return parts[0].unionByName(parts[1])


class Model:
    """A fitted model; ``score`` maps a text to the odds that its label is 1."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, constant: float, slope: float, offset: float):
        self.product, self.square = weights * ratios, ratios * ratios
        self.constant, self.slope, self.offset = constant, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return (self.product[found].sum() + self.constant) / np.sqrt(self.square[found].sum() + 1.0)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -500, 500))))


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Model of rows of buckets and their labels (both labels occur); every fifth row sets the curve."""
    curve = np.arange(len(rows)) % 5 == 4
    if len(set(good[~curve])) < 2 or len(set(good[curve])) < 2:
        curve[:] = False
    train = np.flatnonzero(~curve)
    ratios = log_ratios([rows[k] for k in train], good[train])
    weights, constant, _ = descend([rows[k] for k in train], good[train], ratios)
    model = Model(ratios, weights, constant, 1.0, 0.0)
    if curve.any():
        held = np.flatnonzero(curve)
        model.slope, model.offset = logistic(np.array([model.margin(rows[k]) for k in held]), good[held])
    return model


_FITTED = "product array<double>, square array<double>, constant double, slope double, offset double, good bigint, n bigint"


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          per_label: int = PER_LABEL) -> Model | float:
    """The model of the labelled rows given, or one score for all if a label has no texts."""
    chosen = labelled_sample(labels, id_col, label, per_label)            # at most 2 * per_label rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id") \
        .groupBy("order", "id", "good").agg(F.max("text").alias("text"))
    buckets = text_udf(lambda values: [features(t) for t in values], "array<int>", pa.list_(pa.int32()))
    sample = written(texts.select("order", "id", "good", buckets(F.col("text")).alias("f")), "quality-sample")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, good = [], []
        for batch in batches:
            good += batch.column("good").to_pylist()
            rows += [v.values.to_numpy() for v in batch.column("f")]
        good = np.array(good, bool)
        if len(set(good)) == 2:
            m = fit(rows, good)
            out = [m.product, m.square, m.constant, m.slope, m.offset]
        else:
            out = [[], [], 0.0, 0.0, 0.0]
        types = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(out, types)],
                                          pa.array([int(good.sum())]), pa.array([len(good)])],
                                         names=["product", "square", "constant", "slope", "offset", "good", "n"])

    fitted = sample.repartition(1).sortWithinPartitions("order", "id").select("good", "f").mapInArrow(train, _FITTED).toArrow()
    got = {c: fitted.column(c)[0] for c in fitted.column_names} if fitted.num_rows else {}
    if not got or not len(got["product"]):
        n = got["n"].as_py() if got else 0
        return got["good"].as_py() / n if n else 0.5
    model = Model(np.zeros(1), np.zeros(1), *[got[c].as_py() for c in ("constant", "slope", "offset")])
    model.product, model.square = (got[c].values.to_numpy(zero_copy_only=False) for c in ("product", "square"))
    return model


def score(text: Column, model: Model | float) -> Column:
    """Score of a text column, 0 to 1."""
    if isinstance(model, float):
        return F.lit(model)
    return text_udf(lambda values: [model.score(t) for t in values], "double", pa.float64())(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
             per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from the rows that aren't held out."""
    model = learn(docs.filter(~held_out(F.col(id_col))), labels.filter(~held_out(F.col(id_col))), id_col, text, label, per_label)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
