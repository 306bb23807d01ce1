"""Quality by ordinal regression: cumulative links on graded ratings.

Grades come from the labels: 0 for junk (quality 0), 1 for toxic, 2 for clean.  One weight vector over
hashed text features is shared by all grades, and ordered thresholds t1 < t2 turn the score s
into tail probabilities P(grade >= k) = sigmoid(s - tk), whose sum is the expected grade.  It is fitted
by FTRL-proximal (its L1 term drops words that tell nothing) on at most MAX_LABELLED labelled
documents, taken by the least hash of their ids: a bounded sample, whatever the table's size.  Scoring
is one pass over all whole texts with the model (at most DIMENSIONS numbers) broadcast.

Documents without a word (null, empty) get grade 0 and are rejected.  Where no label is there,
nothing is known and every document with words is kept.  Labels with a null doc_id or quality are left
out, a null toxic counts as 0, several labels of one document give their lowest grade; of several rows of one
labelled doc_id the fit sees the least text, and all are scored.  Repeated rows
and other columns are kept; columns of the added names are replaced.  An empty table gives an empty one; a
long text needs no more than itself and its distinct words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fitted, frugal, size_of, table

DIMENSIONS = 1 << 18
MAX_LABELLED = 10_000
EPOCHS = 4
#: L1's strength for each square root of a row: what noise alone gathers grows like that.
L1 = 0.04
KEEP_TAIL = 0.5
ADDED = ("expected_grade", "p_ge1", "p_ge2", "grade", "kept")
REMEMBERED = 100_000


def _hash(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}\x00{s}".encode("utf-8", "surrogatepass")) % DIMENSIONS


def _shape(word: str) -> str:
    """How a word looks: its case and what stands around its letters."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = word[len(word.rstrip("!#$%&*+/<=>?@\\^_`|~")) :] if core else word
    case = "0" if not core else "U" if len(core) > 1 and core.isupper() else "d" if core.isdigit() else "l"
    return case + (tail[:2] if core else "|" + word[:1])


class Features:
    """Hashed features of a text: words, word beginnings, and shares of shapes and repeats."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def _word(self, w: str) -> tuple:
        core = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
        f = (_hash("shape", _shape(w)), (_hash("w", core), _hash("5", core[:5]), _hash("7", core[:7])) if core else ())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[w] = f
        return f

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        n = len(words)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        there: set[int] = set()
        shares: dict[int, float] = {}
        known = self.known
        for w, c in counts.items():
            shape, own = known.get(w) or self._word(w)
            there.update(own)
            shares[shape] = shares.get(shape, 0.0) + c
        twice = sum(a == b for a, b in zip(words, words[1:])) / n
        extra = {_hash("bias", ""): 1.0, _hash("twice", ""): 4 * twice, _hash("distinct", ""): len(counts) / n, _hash("long", ""): np.log1p(n) / 8}
        idx = [*there, *shares, *extra]
        val = [1.0] * len(there) + [4 * s / n for s in shares.values()] + [*extra.values()]
        return np.array(idx, np.int32), np.array(val, np.float32)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = 0.6, beta: float = 1.0, l1: float | None = None, l2: float = 0.5):
    """Weights and thresholds from (grade, indices, values)."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    l1 = L1 * len(rows) ** 0.5 if l1 is None else l1
    t1, gap, rate = -2.0, 0.0, 0.02

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for y, i, v in rows:
            w = weights(i)
            s = float(w @ v)
            t2 = t1 + np.exp(gap)
            a, b = _sigmoid(s - t1), _sigmoid(s - t2)
            if y == 0:
                da, db = a, 0.0
            elif y == 1:
                d = max(a - b, 1e-9)
                da, db = -a * (1 - a) / d, b * (1 - b) / d
            else:
                da, db = 0.0, b - 1
            g = (da + db) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
            t1 += rate * (da + db)
            gap = float(np.clip(gap + rate * db * np.exp(gap), -3, 3))
    every = np.arange(DIMENSIONS)
    return weights(every), float(t1), float(t1 + np.exp(gap))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of a bounded sample of the labelled documents, by the least hash of their ids."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """The model, fitted by one task on the bounded sample; None if no document is labelled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    some = docs.select("doc_id", "text").join(F.broadcast(graded(labels)), "doc_id")  # MAX_LABELLED rows at most
    some = some.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # a document once, however often its row is repeated

    def features(batches):
        make = Features()
        for b in batches:
            pairs = [make(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())], ["doc_id", "grade", "idx", "val"])

    def learn(batches):
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for b in batches for y, i, v in zip(*(b.column(c).to_pylist() for c in ("grade", "idx", "val"))) if len(i)]
        if rows:
            w, t1, t2 = fit(rows)
            used = np.flatnonzero(w).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"idx": [used.tobytes()], "w": [w[used].astype(np.float64).tobytes()], "t1": [t1], "t2": [t2]})

    made = some.mapInArrow(frugal(features), "doc_id long, grade int, idx binary, val binary")
    one = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = one.mapInArrow(frugal(learn), "idx binary, w binary, t1 double, t2 double").collect()
    if not found:
        return None
    w = np.zeros(DIMENSIONS)
    w[np.frombuffer(found[0].idx, np.int32)] = np.frombuffer(found[0].w, np.float64)
    return w, found[0].t1, found[0].t2


def score(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, text: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """docs with expected_grade, p_ge1, p_ge2, grade and kept."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*(c for c in ADDED if c != text))
    double = T.DoubleType()
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, double) for n in ADDED[:3]), T.StructField("grade", T.IntegerType()), T.StructField("kept", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers at most

    def run(batches):
        make, known = Features(), sent.value
        for b in batches:
            p = np.zeros((b.num_rows, 2))
            for r, t in enumerate(b.column(text).to_pylist()):
                i, v = make(t)
                if len(i):
                    if known is None:
                        p[r] = 1
                    else:
                        s = float(np.sort(known[0][i] * v).sum())  # a fixed order: equal texts, equal values
                        p[r] = _sigmoid(s - known[1]), _sigmoid(s - known[2])
            p = np.round(p, 6)
            grade = np.argmax(np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]]), axis=0)
            new = [pa.array(np.round(p.sum(1), 6)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(grade.astype(np.int32)), pa.array(p[:, 1] >= keep_tail)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *ADDED])

    return fitted(kept, 4 * size_of(kept)).mapInArrow(frugal(run), schema)


def select_quality(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The documents that the classifier keeps, in their own columns."""
    own = docs.toDF(*(f"_o{i}" for i in range(len(docs.columns))))
    scored = score(own, train(docs, labels), text=f"_o{docs.columns.index('text')}", keep_tail=keep_tail)
    return scored.where("kept").select(*own.columns).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *ADDED)
