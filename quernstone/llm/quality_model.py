"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products.

Features are single words and pairs of words, in three spellings: lower-cased
words, shapes (case and outer punctuation) of words, and a mark for words whose
4-word run occurred before in the text. Each hashes to one of `buckets` weights;
values are damped counts scaled to length one, so long texts don't weigh more.

Learning: at most `max_rows` labelled rows (the least by a hash of doc_id) become
features where they are read, then are dealt to `shards` learners, each a follow-the-regularised-leader pass in the order of
that hash; the shards' sums z and squared gradients n are averaged and the next round
goes on from them, so the adaptive rates are kept.
The result does not depend on which machine learns which shard.

Nulls and texts without words have only the constant's feature. Null labels and
null doc_ids teach nothing; repeated rows count each. Without labels the score is
one half. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hashes, materialize, remix, rolled, table, unused
from .toxicity import training_rows


def shape(w: bytes) -> int:
    """Case, outer punctuation and whether there is a digit, as a small number."""
    first, last = w[0], w[-1]
    upper = w.isupper() and len(w) > 1
    title = not upper and 65 <= first <= 90
    end = last if last < 128 and not (48 <= last <= 57 or 65 <= last <= 90 or 97 <= last <= 122) else 0
    start = first if first < 128 and not (48 <= first <= 57 or 65 <= first <= 90 or 97 <= first <= 122) else 0
    return (upper << 20) | (title << 19) | (w.isalpha() << 18) | ((48 <= first <= 57) << 17) | (end << 7) | start


def pairs(h: np.ndarray) -> np.ndarray:
    return rolled(h, 2) if len(h) > 1 else h[:0]


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket numbers and values; bucket 0 is the constant."""
    raw = text.encode("utf-8", "surrogatepass").split() if text else []
    if not raw:
        return np.zeros(1, np.int64), np.ones(1)
    low = hashes([w.lower() for w in raw])
    cases = remix(np.fromiter(map(shape, raw), np.uint64, len(raw)) + np.uint64(11))
    runs = rolled(low, 4)
    seen = np.ones(len(runs), bool)
    seen[np.unique(runs, return_index=True)[1]] = False
    again = np.where(np.append(seen, np.zeros(len(raw) - len(runs), bool)), np.uint64(7), np.uint64(5)) * np.uint64(0x9E3779B97F4A7C15)
    salt = lambda h, k: remix(h ^ np.uint64(k * 0x51_7CC1_B727_220A_95 & (1 << 63) - 1))
    every = [salt(low, 1), salt(pairs(low), 2), salt(cases, 3), salt(pairs(cases), 4), salt(again, 5)]
    index, value = [np.zeros(1, np.int64)], [np.ones(1)]
    for h in every:  # each kind of feature has length one
        if len(h):
            i, n = np.unique((h % np.uint64(buckets - 1)).astype(np.int64) + 1, return_counts=True)
            v = np.sqrt(n)
            index.append(i)
            value.append(v / np.sqrt((v * v).sum()))
    return np.concatenate(index), np.concatenate(value)


class Rates:
    """FTRL-proximal's parameters."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """One pass from the state z, n; returns the state after it."""
    z, n = z.copy(), n.copy()
    for i, x, y in examples:
        w = rates.weights(z[i], n[i])
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
        g = (p - y) * x
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rates.alpha
        z[i] += g - sigma * w
        n[i] += g * g
    return z, n


def featured(train: DataFrame, buckets: int) -> DataFrame:
    """at, doc_id, y, index, value of each training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), buckets) for t in batch.column("text")]
            lists = [pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("at", "doc_id", "y")), *lists], ["at", "doc_id", "y", "index", "value"])

    rows = train.select(F.xxhash64("doc_id", F.lit("order")).alias("at"), "doc_id", "y", "text")
    return rows.mapInArrow(run, "at long, doc_id long, y int, index array<int>, value array<float>")


def learner(held, rates: Rates):
    """One shard's pass from the broadcast state."""

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        names = ("at", "doc_id", "y")
        order = sorted(range(rows.num_rows), key=lambda r: tuple(rows.column(c)[r].as_py() for c in names))
        vector = lambda c, r: rows.column(c)[r].values.to_numpy()
        examples = [(vector("index", r), vector("value", r).astype(float), rows.column("y")[r].as_py()) for r in order]
        z, n = ftrl(examples, *held.value, rates)
        i = np.flatnonzero(n)
        return pa.table({"i": i.astype(np.int32), "z": z[i], "n": n[i]})

    return learn


def fit(train: DataFrame, buckets: int = 1 << 18, shards: int = 4, rounds: int = 3, rates: Rates | None = None) -> np.ndarray:
    """Weights. train: doc_id, text, y; bounded by its maker."""
    rates = rates or Rates()
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard")
    dealt = materialize(featured(train, buckets).select(shard, "*"), "quality-features")
    z, n = np.zeros(buckets), np.zeros(buckets)
    for _ in range(rounds):
        held = train.sparkSession.sparkContext.broadcast((z, n))

        got = dealt.groupBy("shard").applyInArrow(learner(held, rates), "i int, z double, n double")
        mean = got.groupBy("i").agg((F.sum("z") / F.count("*")).alias("z"), (F.sum("n") / F.count("*")).alias("n")).toArrow()  # at most `buckets` rows
        z, n = np.zeros(buckets), np.zeros(buckets)
        i = mean.column("i").to_numpy()
        z[i], n[i] = np.round(mean.column("z").to_numpy(), 9), np.round(mean.column("n").to_numpy(), 9)
        held.unpersist()
    return rates.weights(z, n)


def score(docs: DataFrame, w: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with `score`."""
    keep = keep or ["doc_id"]
    hidden = unused(docs, "text")[0] if "text" in keep else "text"
    held = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    rows = docs.select(*keep, F.col("text").cast("string").alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != hidden), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            z = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(hidden)):
                i, x = features(t.as_py(), len(w))
                z[k] = w[i] @ x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = materialize(training_rows(docs, table(spark, sf_dir, "labels"), "quality", (3, 1), 12000), "quality-train")
    out = score(docs, fit(train))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality_model": op3_quality_model}
