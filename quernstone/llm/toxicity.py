"""Toxic passages by maximum-scoring segments.

Learning: for every word, in how many contexts it occurs in toxic and in other
labelled texts (`max_rows` bounds the labelled texts used, the least by a hash of
doc_id; what is learned is bounded by their words). Log-odds are those of Dirichlet
posteriors: the prior of a word is the rate of the words that share its first `stem`
letters, whose prior is that of all words. Words (and stems, for words not seen)
whose log-odds less `z` standard errors are above `least` are the toxic ones.

A word scores its log-odds between two models: p, other texts, and q, a toxic
passage, in which a share `tau` of the words is drawn from the toxic ones in
proportion to their excess over p, and the rest as elsewhere. So with a word's
posterior odds r and the summed excess M = sum p (r - 1) it scores
ln(1 - tau + tau (r - 1) / M), and every word that isn't surely toxic ln(1 - tau):
the sum falls between passages.

Scoring: the linear-time search of all maximal scoring segments over the words of
a text. The segments' scores follow an extreme-value law: E = K n exp(-lambda S)
chance segments as good as S are expected among n words. lambda solves
sum p exp(lambda s) = 1 over the scores of the words of texts that are not toxic; K comes from the
best segments of those texts. Significant segments (E under `max_e`) add up -ln E; a
logistic fit maps sum and count to the score.

Nulls and texts without words have no segments and get the score of none. Labels
of null doc_ids, and null labels, teach nothing; repeated rows of a text count
each, a doc_id labelled twice counts by each label. Without labels of both kinds, or words of both,
the score is the toxic share (0 without labels). Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, solve_logistic, table, tokens, unused

EDGE = b".,;:!?\"'()[]{}|*#$%&<>-_~`"
TEXTS = "doc_id long, text string"


def plain(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them; positions are kept."""
    return [w.strip(EDGE) for w in tokens(text)]


def stem_of(word: bytes, size: int) -> bytes:
    return word.decode("utf-8", "surrogatepass")[:size].encode("utf-8", "surrogatepass")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], max_rows: int) -> DataFrame:
    """text and y of at most `max_rows` labelled rows outside the held-out fold.

    The bound is a parameter of the learning; the rows are those of least hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held[0]) != held[1]))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) == 1).cast("int").alias("y"))
    picked = known.withColumn("at", F.xxhash64("doc_id", F.lit("train"))).orderBy("at", "doc_id", "y").limit(max_rows).select("doc_id", "y")
    # Proven bound: max_rows rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


def word_counts(train: DataFrame, stem: int) -> DataFrame:
    """word, is_stem, toxic, other: in how many contexts (next words) each occurs in texts of either kind.

    A passage that is copied through many texts has the same contexts in all of
    them and so counts once.
    """
    names = ["word", "is_stem", "context", "y"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int32()]

    def rows(seen: set) -> pa.RecordBatch:
        cols = zip(*seen, strict=True) if seen else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words = plain(text.as_py())
                for w, after in zip(words, [*words[1:], b""], strict=False):  # no words: none
                    if w:
                        context = zlib.crc32(after)
                        seen.add((w.decode("utf-8", "replace"), False, context, y))
                        seen.add((w.decode("utf-8", "replace")[:stem], True, context, y))
                if len(seen) > 200_000:
                    yield rows(seen)
                    seen = set()
        yield rows(seen)

    found = train.select("text", "y").mapInArrow(run, "word string, is_stem boolean, context long, y int")
    each = found.groupBy("word", "is_stem", "context").agg(F.max("y").alias("t"), F.max(1 - F.col("y")).alias("o"))
    return each.groupBy("word", "is_stem").agg(F.sum("t").cast("long").alias("toxic"), F.sum("o").cast("long").alias("other"))


def maximal(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text whose words score `drift` but for the hits (place, score > 0): first word, end, score.

    Each candidate keeps a link to the last one before it whose left sum is less,
    so what was passed over once is never looked at again.
    """
    stack: list[tuple] = []  # first, end, sum before, sum with it, link
    total, last = 0.0, 0
    for i, s in hits:
        total += drift * (i - last)
        first, left, right, j = i, total, total + s, len(stack) - 1
        total, last = right, i + 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < right:
            first, _, left, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((first, i + 1, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class Model:
    """Lexicon and calibration; `significant` and `score` need nothing else."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float], stem: int, drift: float) -> None:
        self.words, self.stems, self.stem, self.drift = words, stems, stem, drift
        self.log_k, self.rate, self.max_e, self.weights, self.share = 0.0, 1.0, 0.05, None, 0.0

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        out, known, stems, size = [], self.words, self.stems, self.stem
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                if len(w) < size:
                    continue
                s = stems.get(w[:size]) or (stems.get(stem_of(w, size)) if not w.isascii() else None)
                if s is None:
                    continue
            if s > 0:
                out.append((i, s))
        return out

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        return maximal(self.hits(words), self.drift)

    def significant(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Segments with E under max_e: first word, end, -ln E."""
        room = self.log_k + math.log(max(1, len(words)))
        found = ((a, b, self.rate * s - room) for a, b, s in self.segments(words))
        return [x for x in found if x[2] > -math.log(self.max_e)]

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        """Of a text with these significant segments."""
        if self.weights is None:
            return self.share
        x, y = features(passages)
        z = self.weights[0] + self.weights[1] * x + self.weights[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(passages: list[tuple[int, int, float]]) -> tuple[float, float]:
    return math.log1p(sum(x[2] for x in passages)), math.log1p(len(passages))


def lexicon(counts: DataFrame, stem: int, tau: float, prior: float = 2.0, z: float = 2.0, least: float = 0.7) -> Model | None:
    """Scores of the words and stems whose posterior log-odds are surely above `least`; None without words of both kinds."""
    toxic, other = counts.where("is_stem").agg(F.sum("toxic"), F.sum("other")).first()
    if not toxic or not other:
        return None
    p = toxic / (toxic + other)
    base = F.lit(math.log(toxic / other))
    stems = counts.where("is_stem").select(F.col("word").alias("stem"), "toxic", "other")

    def judged(df: DataFrame, rate) -> DataFrame:
        a, b = F.col("toxic") + prior * rate, F.col("other") + prior * (1 - rate)
        return df.withColumn("odds", F.log(a / b) - base).withColumn("score", F.col("odds") - z * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).withColumn("share", a / (a + b)).withColumn("excess", b / other * (F.exp("odds") - 1))

    stems = judged(stems, F.lit(p))
    words = judged(counts.where("not is_stem").withColumn("stem", F.substring("word", 1, stem)).join(stems.select("stem", F.col("share").alias("rate")), "stem"), F.col("rate"))
    sure = stems.where((F.col("score") > least) & (F.char_length("stem") >= stem))
    known = words.where(F.col("score") > least)
    # Words known to be harmless hide their stem.
    hidden = words.join(sure.select("stem"), "stem", "left_semi").where((F.col("odds") <= 0) & (F.col("other") >= 2))
    # The words of at most max_rows texts.
    found = {r[0].encode(): (r.odds, r.excess) for r in known.select("word", "odds", "excess").collect()}
    total = sum(x for _, x in sorted(found.values())) or 1.0
    of = lambda odds: math.log(1 - tau + tau * (math.exp(odds) - 1) / total)
    scores = {w: round(of(odds), 6) for w, (odds, _) in found.items()}
    scores |= {r[0].encode(): 0.0 for r in hidden.select("word").collect()}
    return Model(scores, {r[0].encode(): round(of(r[1]), 6) for r in sure.select("stem", "odds").collect()}, stem, round(math.log(1 - tau), 6))


def solve_rate(scores: list[tuple[float, float]], low: float = 0.05, high: float = 5.0) -> float:
    """lambda > 0 with sum n exp(lambda s) = sum n over (score, n); 1 if no score is above zero. The bounds keep it finite where chance words score on average above zero, or never."""
    total = sum(n for _, n in scores)
    if not any(s > 0 and n for s, n in scores):
        return 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * math.exp(mid * s) for s, n in scores) < total else (low, mid)
    return (low + high) / 2


def per_text(train: DataFrame, of, names: list[str]) -> DataFrame:
    """y and the numbers that `of` makes from each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([of(plain(t.as_py())) for t in batch.column("text")], float).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(names)))], ["y", *names])

    return train.select("text", "y").mapInArrow(run, ", ".join(["y int", *(f"{n} double" for n in names)]))


def word_scores(train: DataFrame, model: Model) -> list[tuple[float, int]]:
    """How many words of the texts have each score (to one decimal); few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[float, int] = {}
        for batch in batches:
            for t in batch.column("text"):
                words = plain(t.as_py())
                hits = model.hits(words)
                counts[model.drift] = counts.get(model.drift, 0) + len(words) - len(hits)
                for _, s in hits:
                    counts[round(s, 1)] = counts.get(round(s, 1), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["s", "n"])

    return [(r.s, r.n) for r in train.select("text").mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").collect()]


def fit(train: DataFrame, stem: int = 5, tau: float = 0.4, max_e: float = 0.05) -> Model:
    """train: text and y (1: toxic). It is read five times, so write it down first."""
    n, toxic = train.agg(F.count("*"), F.sum("y")).first()
    toxic = toxic or 0
    model = lexicon(materialize(word_counts(train, stem), "word-counts"), stem, tau) if 0 < toxic < n else None
    if model is None:
        model = Model({}, {}, stem, math.log(1 - tau))
        model.share = toxic / n if n else 0.0
        return model
    model.max_e = max_e
    calm = train.where("y = 0")
    model.rate = solve_rate(word_scores(calm, model))

    def best(words: list[bytes]) -> tuple[float]:
        return (model.rate * max((s for _, _, s in model.segments(words)), default=0.0) - math.log(max(1, len(words))),)

    # Gumbel law: the mean of lambda S - ln n over chance texts is ln K + gamma.
    mean = per_text(calm, best, ["x"]).agg(F.avg("x")).first()[0]
    model.log_k = max(-8.0, (mean or 0.0) - 0.5772)
    seen = per_text(train, lambda words: features(model.significant(words)), ["a", "b"]).groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "y").agg(F.count("*").alias("n")).collect()
    x = np.array([(1.0, r.a, r.b) for r in seen])
    model.weights = solve_logistic(x, np.array([r.y for r in seen], float), np.array([r.n for r in seen], float), 0.05).tolist()
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with `score` and `passages` (first word, end and -ln E of each significant one)."""
    keep = keep or ["doc_id"]
    hidden = unused(docs, "text")[0] if "text" in keep else "text"
    rows = docs.select(*keep, F.col("text").cast("string").alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != hidden), "score double", "passages array<struct<first:int,end:int,weight:double>>"])
    passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.significant(plain(t.as_py())) for t in batch.column(hidden)]
            scores = pa.array(map(model.score, found), pa.float64())
            rows = pa.array([[{"first": a, "end": b, "weight": w} for a, b, w in x] for x in found], passage)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores, rows], [*keep, "score", "passages"])

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), max_rows: int = 20000) -> Model:
    return fit(materialize(training_rows(docs, labels, "toxic", held, max_rows), "toxic-train"))


def without_toxic(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs (whose `text` is a string) that score under `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.significant(plain(t.as_py()))) < least for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    held = (fold("doc_id", 3) == 1).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op1_toxicity": op1_toxicity}
