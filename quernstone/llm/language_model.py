"""Language-model scoring: add-one unigrams, and a hashed maximum-entropy model.

Tokens are lower-cased words and one end for each text. Their counts cover all
training texts. The model predicts symbols: the frequent words (at most
`vocabulary`: those with 1 / `vocabulary` of all tokens or more), the end, and 64
spelling classes (by last two bytes) of all other words, in which a word has its
add-one share. `vocabulary` grows with the cube root of the training tokens and the
number of weights with it, so a larger corpus has more words with n-grams of
their own, while what is broadcast stays far smaller than the corpus. A softmax over classes of symbols is followed by one over the
symbols of the class. Logits are the logarithms of the unigram shares plus hashed
weights of three features: the word before, the class of the word two before (a
skip), and both.

Learning counts (context, symbol) over all training texts, once. Each round then
sums the gradient and curvature of every weight over that table, which is dealt
by context, and moves all weights by a damped diagonal Newton step. The table and
the weights are bounded by the vocabulary: at 10^13 tokens 430,000 words and 2^26
weights, half a GB, for which the driver needs a few GB.

Scoring: batches look up the distinct (context, symbol) of their texts. Words with
1 / `known` of all tokens or more are broadcast (at most `known`: a proven
bound); the counts of the others are joined, and none of those is a hot key.

A word is known by 58 bits of its hash and its spelling class. Nulls and texts
without words are one end. A null doc_id counts as the empty text for folds;
rows that repeat count and are scored each. Without training texts every word is
unknown. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hashes, materialize, remix, table, tokens

SPELLINGS = 64
END = -SPELLINGS  # no word has this key but by a hash of zeros
#: Tokens that are looked up together.
CHUNK = 400_000
#: Rows of counts in one batch to the JVM.
BATCH = 1 << 17


def vocabulary_for(tokens: int, least: int = 4096, rate: float = 20.0) -> int:
    """`rate` times the cube root of the training tokens, at least `least`."""
    return max(least, math.ceil(rate * tokens ** (1 / 3)))


def weights_for(vocabulary: int) -> int:
    """Weights of a layer: the power of two nearest to 64 a word, by its logarithm."""
    return 1 << round(math.log2(64 * vocabulary))


def word_keys(text: str | None) -> np.ndarray:
    """Signed 64-bit keys of a text's tokens: hash of the word, spelling class in the last 6 bits."""
    words = tokens(text)
    if not words:
        return np.array([END], np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.append((raw != 32) & ((raw < 9) | (raw > 13)), False)
    last = np.flatnonzero(inside[:-1] & ~inside[1:])
    # Of a word of one byte, the byte before is not looked at.
    two = raw[last].astype(np.uint64) * np.uint64(256) + np.where((last > 0) & inside[last - 1], raw[last - 1], 32)
    spelling = remix(two) >> np.uint64(58)
    keys = (hashes(words) & ~np.uint64(SPELLINGS - 1)) | spelling
    return np.append(keys.view(np.int64), END)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(texts: DataFrame, of) -> DataFrame:
    """key and n: sums over all texts of what `of` (list of token key arrays -> keys) finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunk, size = [], 0
        for batch in batches:
            for t in batch.column("text"):
                chunk.append(word_keys(t.as_py()))
                size += len(chunk[-1])
                if size >= CHUNK:
                    got = np.unique(of(chunk), return_counts=True)
                    keys, n = summed(np.concatenate([keys, got[0]]), np.concatenate([n, got[1]]))
                    chunk, size = [], 0
                    if len(keys) > 2_000_000:
                        yield from parts(keys, n)
                        keys, n = keys[:0], n[:0]
        if chunk:
            got = np.unique(of(chunk), return_counts=True)
            keys, n = summed(np.concatenate([keys, got[0]]), np.concatenate([n, got[1]]))
        yield from parts(keys, n)

    def parts(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + BATCH]), pa.array(n[lo : lo + BATCH])], ["key", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the known words and what the symbols are. Bounded by its parameters."""

    def __init__(self, total: int, distinct: int, known: list[tuple[int, int]], spelled: dict[int, tuple[int, int]], vocabulary: int) -> None:
        """known: (key, count) of frequent words; spelled: tokens and words of each spelling class, all words."""
        self.total, self.distinct, self.most = total, distinct, vocabulary
        known = sorted(known)
        self.keys = np.array([k for k, _ in known], np.int64)
        self.counts = np.array([c for _, c in known], np.int64)
        head = [i for i in sorted(range(len(known)), key=lambda i: (-known[i][1], known[i][0])) if known[i][1] * vocabulary >= total and known[i][0] != END]
        self.head = len(head)
        self.end = self.head + SPELLINGS
        self.size = self.end + 1
        self.symbol = np.full(len(known), -1, np.int64)
        self.symbol[head] = np.arange(self.head)
        self.symbol[self.keys == END] = self.end
        tail_tokens = np.array([spelled.get(k, (0, 0))[0] for k in range(SPELLINGS)], np.int64)
        tail_words = np.array([spelled.get(k, (0, 0))[1] for k in range(SPELLINGS)], np.int64)
        for i in head:
            tail_tokens[self.keys[i] & (SPELLINGS - 1)] -= self.counts[i]
            tail_words[self.keys[i] & (SPELLINGS - 1)] -= 1
        ends = self.counts[self.keys == END].sum()
        tail_tokens[END & (SPELLINGS - 1)] -= ends
        tail_words[END & (SPELLINGS - 1)] -= ends > 0
        #: Add-one denominators of the spelling classes, one unseen word included.
        self.room = np.log10(tail_tokens + tail_words + 1.0)
        share = np.concatenate([self.counts[head], tail_tokens, [ends]]).astype(float) + 0.5
        share /= share.sum()
        # Classes of symbols: equal parts of the summed roots of the shares, so frequent ones are alone.
        self.classes = max(1, math.isqrt(self.size))
        order = np.argsort(-share, kind="stable")
        upto = np.cumsum(np.sqrt(share[order]))
        self.of = np.zeros(self.size, np.int64)
        self.of[order] = np.unique(np.minimum((upto / upto[-1] * self.classes - 1e-9).astype(np.int64), self.classes - 1), return_inverse=True)[1]
        self.classes = int(self.of.max()) + 1
        mass = np.bincount(self.of, share, self.classes)
        self.log_class = np.log(mass)
        self.log_within = np.log(share / mass[self.of])
        self.width = np.bincount(self.of)
        widest = int(self.width.max())
        self.band = np.ceil(np.log2(self.width)).astype(np.int64)
        self.members = np.full((self.classes, widest), -1, np.int64)
        self.place = np.zeros(self.size, np.int64)
        for c in range(self.classes):
            own = np.flatnonzero(self.of == c)
            self.members[c, : len(own)] = own
            self.place[own] = np.arange(len(own))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of tokens, and their counts (-1: not among the known)."""
        symbols, counts = self.head + (keys & (SPELLINGS - 1)), np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            counts[hit] = self.counts[at[hit]]
            named = hit & (self.symbol[at] >= 0)
            symbols[named] = self.symbol[at[named]]
        symbols[keys == END] = self.end
        return symbols, counts

    def contexts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, contexts and known counts of all tokens of some texts. A context is (symbol before, class of the one before)."""
        symbols, counts = self.look_up(np.concatenate(texts))
        start = np.zeros(len(symbols), bool)
        start[np.cumsum([0, *map(len, texts)])[:-1]] = True
        before = np.append(self.size, symbols[:-1])
        before[start] = self.size
        group = np.append(self.of, self.classes)[np.append(self.size, before[:-1])]
        group[start] = self.classes
        return symbols, before * (self.classes + 1) + group, counts


class Model:
    """Weights of both layers over a vocabulary."""

    KINDS = 3

    def __init__(self, vocabulary: Vocabulary, dim: int) -> None:
        self.v, self.dim = vocabulary, dim
        self.w = np.zeros(2 * dim)

    def slots(self, contexts: np.ndarray, targets: np.ndarray, layer: int) -> np.ndarray:
        """Weight numbers, contexts x kinds x targets (targets: a row for all contexts or one for each)."""
        before, group = np.divmod(contexts, self.v.classes + 1)
        features = np.stack([before, group + (1 << 40), contexts + (2 << 40)], 1).astype(np.uint64)
        mixed = remix(features * np.uint64(4) + np.uint64(layer))[:, :, None]
        h = remix(mixed ^ remix(targets.astype(np.uint64) + np.uint64(0x51ED270B)).reshape(-1, 1, targets.shape[-1]))
        return (h >> np.uint64(20)).astype(np.int64) % self.dim + layer * self.dim

    def layers(self, contexts: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities and slots of the classes, or of the members of one class for each context."""
        if classes is None:
            targets, start, mask = np.arange(self.v.classes)[None, :], self.v.log_class[None, :], None
        else:
            targets = self.v.members[classes][:, : self.v.width[classes].max()]
            mask = targets < 0
            start = self.v.log_within[np.maximum(targets, 0)]
        at = self.slots(contexts, targets, 0 if classes is None else 1)
        z = self.w[at].sum(1) + start
        if mask is not None:
            z = np.where(mask, -np.inf, z)
        top = z.max(1, keepdims=True)
        return z - top - np.log(np.exp(z - top).sum(1, keepdims=True)), at

    def pieces(self, both: np.ndarray, rows: int = 4096) -> Iterator[np.ndarray]:
        """Positions in `both` (contexts with classes) of classes about as wide, so few columns are worked out for nothing."""
        band = self.v.band[both % self.v.classes]
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            for lo in range(0, len(own), rows):
                yield own[lo : lo + rows]

    def log10(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Of symbols in contexts; equal ones are worked out once."""
        pairs, back = np.unique(contexts * self.v.size + symbols, return_inverse=True)
        c, s = np.divmod(pairs, self.v.size)
        out = np.empty(len(pairs))
        step = 1 << 13
        for lo in range(0, len(pairs), step):  # pairs are in the order of contexts
            part, klass = slice(lo, lo + step), self.v.of[s[lo : lo + step]]
            own, which = np.unique(c[part], return_inverse=True)
            out[part] = self.layers(own)[0][which, klass]
            both, which = np.unique(c[part] * self.v.classes + klass, return_inverse=True)
            place, more, at = self.v.place[s[part]], np.empty(len(which)), np.empty(len(both), np.int64)
            for piece in self.pieces(both):
                at.fill(-1)
                at[piece] = np.arange(len(piece))
                mine = at[which] >= 0
                more[mine] = self.layers(*np.divmod(both[piece], self.v.classes))[0][at[which[mine]], place[mine]]
            out[part] += more
        return (out / math.log(10))[back]

    def gradient(self, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood and its curvature, over rows in the order of contexts."""
        g, h = np.zeros(2 * self.dim), np.zeros(2 * self.dim)
        klass = self.v.of[symbols]
        # Rows of a context stay together.
        edges = np.append(np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])), len(contexts))
        for k in range(0, len(edges) - 1, 2048):
            rows = slice(edges[k], edges[min(k + 2048, len(edges) - 1)])
            for layer in (0, 1):
                place = klass[rows] if layer == 0 else self.v.place[symbols[rows]]
                of = contexts[rows] if layer == 0 else contexts[rows] * self.v.classes + klass[rows]
                own, which = np.unique(of, return_inverse=True)
                order = np.empty(len(own), np.int64)
                for piece in self.pieces(own) if layer else [np.arange(len(own))]:
                    log_p, at = self.layers(*np.divmod(own[piece], self.v.classes)) if layer else self.layers(own)
                    p, seen = np.exp(log_p), np.zeros(log_p.shape)
                    order.fill(-1)
                    order[piece] = np.arange(len(piece))
                    mine = order[which] >= 0
                    np.add.at(seen, (order[which[mine]], place[mine]), n[rows][mine])
                    each = seen.sum(1, keepdims=True)
                    dg, dh = seen - each * p, each * p * (1 - p)
                    for kind in range(self.KINDS):
                        np.add.at(g, at[:, kind].ravel(), dg.ravel())
                        np.add.at(h, at[:, kind].ravel(), dh.ravel())
        return g, h


def vocabulary_of(counts: DataFrame, vocabulary: int | None = None, known: int = 65536) -> Vocabulary:
    """counts: key and n of all training tokens. known: the same at all sizes, as it changes no result."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    vocabulary = vocabulary or vocabulary_for(total)
    known = max(known, vocabulary)  # all symbols are known words
    # At most `known` words can have that share.
    frequent = counts.where((F.col("n") * known >= total) | (F.col("key") == END)).select("key", "n").collect()
    spelled = counts.groupBy(F.col("key").bitwiseAND(F.lit(SPELLINGS - 1)).alias("s")).agg(F.sum("n").alias("t"), F.count("*").alias("w")).collect()
    return Vocabulary(total, distinct, [(r.key, r.n) for r in frequent], {r.s: (r.t, r.w) for r in spelled}, vocabulary)


def fit(train: DataFrame, v: Vocabulary, dim: int | None = None, rounds: int = 8, l2: float = 2.0) -> Model:
    dim = dim or weights_for(v.most)
    model = Model(v, dim)
    if v.total == 0:
        return model
    spark = train.sparkSession
    size = v.size

    def pairs(texts: list[np.ndarray]) -> np.ndarray:
        symbols, contexts, _ = v.contexts(texts)
        return contexts * size + symbols

    rows = counted(train, pairs).withColumn("context", F.floor(F.col("key") / F.lit(size)).cast("long"))
    dealt = materialize(rows.repartition("context").sortWithinPartitions("key").select("key", "n"), "contexts")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(2 * dim), np.zeros(2 * dim)
            for key, n in blocks(batches):
                contexts, symbols = np.divmod(key, size)
                dg, dh = held.value.gradient(contexts, symbols, n.astype(float))
                g, h = g + dg, h + dh
            i = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(g[i]), pa.array(h[i])], ["i", "g", "h"])

        sums = dealt.mapInArrow(run, "i int, g double, h double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        got = sums.toArrow()  # at most 2 * dim rows
        i = got.column("i").to_numpy()
        w = model.w.copy()
        step = (got.column("g").to_numpy() - l2 * w[i]) / (Model.KINDS * got.column("h").to_numpy() + l2)
        w[i] += np.clip(step, -2.0, 2.0)
        model.w = np.round(w, 9)  # sums in any order give the same weights
        held.unpersist()
    return model


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """key and n of so many rows at a time, in order of keys. Gradients add up, so a context may be split between blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield in_order(held)
            held = []
    if any(b.num_rows for b in held):
        yield in_order(held)


def in_order(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = pa.Table.from_batches(held)
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def first_part(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, n_tokens, sums over known words, and the other words with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        v = model.v
        base_room = math.log10(v.total + v.distinct + 1)
        for batch in batches:
            texts, size, start = [], 0, 0
            for k, t in enumerate(batch.column("text")):
                texts.append(word_keys(t.as_py()))
                size += len(texts[-1])
                if size >= CHUNK or k + 1 == batch.num_rows:
                    yield part(model, base_room, texts, batch.slice(start, len(texts)))
                    texts, size, start = [], 0, k + 1

    def part(model: Model, base_room: float, texts: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        v = model.v
        symbols, contexts, counts = v.contexts(texts)
        n = np.array([*map(len, texts)])
        at = np.append(0, np.cumsum(n)[:-1])
        total = lambda x: np.add.reduceat(x, at)
        known = counts >= 0
        log_count = np.log10(np.where(known, counts, 0) + 1.0)
        tail = (symbols >= v.head) & (symbols < v.end)
        score = model.log10(contexts, symbols) - np.where(tail, v.room[np.where(tail, symbols - v.head, 0)] - np.where(known, log_count, 0.0), 0.0)
        base = np.where(known, log_count, 0.0) - base_room
        rare, times, ends = [], [], [0]
        for keys, a, m in zip(texts, at, n, strict=True):
            k, c = np.unique(keys[~known[a : a + m]], return_counts=True)
            rare.append(k)
            times.append(c.astype(np.int32))
            ends.append(ends[-1] + len(k))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(x)))
        sums = [n, total(known.astype(np.int64)), total(base), total(score)]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, sums), lists(rare), lists(times)], names)

    return rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) for each row of docs."""
    parts = materialize(first_part(docs, model), "scores")
    each = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    # Words that are not in the counts (unknown ones) add nothing: log10(0 + 1).
    met = each.join(counts.select("key", "n"), "key")
    sums = met.groupBy("row").agg(F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return parts.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def learn_and_score(docs: DataFrame, train: DataFrame, vocabulary: int | None = None, known: int = 65536, rounds: int = 8) -> DataFrame:
    """Counts and model from `train`, scores for `docs`. vocabulary: sized by the training tokens if not given."""
    counts = materialize(counted(train, np.concatenate), "word-counts")
    v = vocabulary_of(counts, vocabulary, known)
    rare = counts.where((F.col("n") * max(known, v.most) < v.total) & (F.col("key") != END))
    return score(docs, fit(train, v, rounds=rounds), rare)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = learn_and_score(docs, docs.where(fold("doc_id", 7) != 2))
    return scored.withColumn("held_out", fold("doc_id", 7) == 2)


QUERIES = {"op4_language_model": op4_language_model}
