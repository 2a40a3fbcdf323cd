"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits share a partition. Each
partition gets its own threshold t with sum(t + 1) = tau + 1 (t = -1: unused):
two fingerprints within tau bits differ in at most t bits of some partition. The
thresholds come from a dynamic programme over estimated candidate counts. A
fingerprint is stored under its value in every used partition, probes all values
within t bits, and pairs that meet are verified on all bits.

All work is on distinct fingerprints, so copies never pair up. A bucket in which
too many fingerprints meet isn't paired. In `link_exact` its members get one key
for each ball centre within tau / 2 bits: two fingerprints within tau bits have a
common centre, and a centre has few owners, so the rest is exact and grows
linearly. That needs an even, small tau.

Near copies of texts (`similar_texts`, `one_of_each`) have several weighted
fingerprints each. Whoever meets is compared by whole sets of five-word shingles.
`common.linked` tries one pair a member within groups of copies, and all pairs
that could still join two groups, so no verified pair of a bucket is lost.

Nulls and texts without words have fingerprint zero and link like any other.
Repeated rows and equal texts share a fingerprint. A null doc_id takes part but
never names a component unless alone. Empty tables give empty results; extra
columns are ignored by `fingerprints`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, hashes, linked, materialize, prefixes, remix, rolled, signed, similar_sets, table, tokens, unused

#: A bucket with more meetings than this goes by centres in `link_exact`, which changes no link.
DENSE = 4096
#: The same in `similar_texts`, where texts then meet by their rarest shingles; that finds all similar ones.
FULL = 64
#: A pair of strangers in a bucket costs about as much as so many probes.
STRANGER = 16


def majority(h: np.ndarray) -> int:
    """Bit k is 1 if over half the hashes have it; no hashes: zero."""
    if len(h) == 0:
        return 0
    votes = np.zeros(64, np.int64)
    for start in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[start : start + 65536])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingle_fingerprint(text: str | None, width: int = 3) -> int:
    """Of the `width`-word shingles, repeats included; shorter texts are one shingle."""
    w = tokens(text)
    if not w:
        return 0
    runs = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False))
    n = max(1, len(w) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, n))


def fingerprints(docs: DataFrame, of: Callable[[str | None], int] = shingle_fingerprint) -> DataFrame:
    """Columns doc_id and fp (long, the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((of(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(signed(fp))], ["doc_id", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- partitions and thresholds -------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64))
            b = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += b.T @ b
            n += len(x)
        i = np.arange(4097, dtype=np.int32)
        v = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(v)], ["i", "v"])

    got = dict(fps.select("fp").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v")).collect())
    both = np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)
    return got.get(4096, 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal groups; each takes the unused bits that correlate most with its own."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    cor = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free = list(range(64))
    out = []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [min(free, key=lambda b: (-cor[b][free].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = min(free, key=lambda b: (-cor[b][group].sum(), b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def estimate(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Candidates and probes if partners may differ in t of these bits."""
    if t < 0:
        return 0.0
    p = np.diag(both)[bits] / max(n, 1)
    q = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    poly = np.zeros(t + 1)  # chance of 0..t differing bits
    poly[0] = 1.0
    for x in q:
        poly[1:] = poly[1:] * (1 - x) + poly[:-1] * x
        poly[0] *= 1 - x
    return STRANGER * n * n / 2 * poly.sum() + n * 2 * ball(len(bits), t)


def ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum(t + 1) = tau + 1; cost[i][t + 1] is that of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, x in enumerate(row):
                if used + k <= tau + 1 and (used + k not in nxt or c + x < nxt[used + k][0]):
                    nxt[used + k] = (c + x, [*ts, k - 1])
        best = nxt
    return best[tau + 1]


def plan(n: int, both: np.ndarray, tau: int, parts: tuple[int, ...] = (2, 3, 4), reach: int = 2) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, over all numbers of partitions tried."""
    found = []
    for m in parts:
        if tau + 1 > m * (reach + 1):
            continue
        groups = group_bits(n, both, m)
        cost = [[estimate(n, both, g, t) for t in range(-1, reach + 1)] for g in groups]
        total, ts = allocate(cost, tau)
        found.append((total, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found)[2]


# --- probing ---------------------------------------------------------------------


def mask_of(bits: tuple[int, ...] | list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def probes(fps: DataFrame, parts: list[tuple[list[int], int]], keep: list[str] | None = None) -> DataFrame:
    """Rows part, key, own (stored or only probing), fp and the columns `keep`."""

    def probe(k: int, bits: list[int], t: int) -> Column:
        value = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        near = [mask_of(x) for r in range(t + 1) for x in combinations(bits, r)]
        own = lambda x: F.struct(F.lit(k).alias("part"), value.bitwiseXOR(x).alias("key"), (x == 0).alias("own"))
        return F.transform(F.array(*map(F.lit, near)), own)

    rows = [probe(k, bits, t) for k, (bits, t) in enumerate(parts)]
    return fps.select("fp", *(keep or []), F.explode(F.concat(*rows)).alias("p")).select("p.part", "p.key", "p.own", "fp", *(keep or []))


def meetings(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """The probes that meet someone, with `dense` for buckets too full to pair up."""
    met = probes(fps, parts)
    n_own = F.sum(F.col("own").cast("long"))
    full = met.groupBy("part", "key").agg(n_own.alias("n_own"), F.count("*").alias("n"))
    full = full.where("n_own >= 1 and n >= 2").select("part", "key", (F.col("n_own") * F.col("n") > DENSE).alias("dense"))
    return met.join(full, ["part", "key"])


def verified(met: DataFrame, tau: int) -> DataFrame:
    a = met.where("own").select("part", "key", F.col("fp").alias("a"))
    b = met.select("part", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return a.join(b, ["part", "key"]).where(F.col("a") != F.col("b")).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def centres(fps: DataFrame, radius: int) -> DataFrame:
    """Exact links through common ball centres, as stars; a centre has at most ball(64, radius) owners."""
    near = [mask_of(x) for r in range(radius + 1) for x in combinations(range(64), r)]
    keyed = fps.select("fp", F.explode(F.array(*map(F.lit, near))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(least, "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def link_exact(fps: DataFrame, tau: int = 2) -> DataFrame:
    """Links whose components are those of all pairs within tau bits (tau even); columns a and b."""
    if tau % 2:
        raise ValueError("link_exact needs an even tau")
    parts = plan(*bit_statistics(fps), tau, reach=1 if tau <= 3 else 2)
    met = materialize(meetings(fps, parts), "meetings")
    thick = met.where("dense").select("fp").distinct()
    return verified(met.where("not dense"), tau).unionByName(centres(thick, tau // 2))


def signatures(docs: DataFrame, copies: int = 8, width: int = 5) -> DataFrame:
    """doc_id, id (hash of the set of `width`-word shingles), n (size of that set) and w (`copies` fingerprints).

    Fingerprints are of that set. In each copy a shingle weighs 1 / -ln u, u uniform by
    its hash: so few shingles decide most bits, and in a share of the copies that
    grows with the similarity two texts have the same ones, whether edits are
    scattered or a block. With equal weights all bits would move a little: at
    similarity 0.8 some 10 of 64, too many to probe for.
    """
    salts = np.random.default_rng(8).integers(1, 1 << 62, copies, dtype=np.int64).astype(np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def of(text: str | None) -> tuple[int, int, list[int]]:
        h = hashes(tokens(text))
        if len(h) == 0:
            return 0, 0, [0] * copies
        whole = np.unique(rolled(h, width))
        bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        u = (remix(whole[None, :] ^ salts[:, None]) >> np.uint64(11)).astype(np.float64) + 0.5
        votes = (-1 / np.log(u / 2.0**53)).astype(np.float32) @ bits
        w = np.where(votes > 0, powers, np.uint64(0)).sum(1, dtype=np.uint64)
        return int(signed(remix(whole).sum(dtype=np.uint64).reshape(1))[0]), len(whole), signed(w).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n, w = zip(*(of(t.as_py()) for t in batch.column("text")), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(w, pa.list_(pa.int64()))], ["doc_id", "id", "n", "w"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, id long, n int, w array<long>")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """id (as of `signatures`) and elements: the distinct shingles as 32 bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(rolled(hashes(tokens(t.as_py())), width)) for t in batch.column("text")]
            ids = [int(signed(remix(g).sum(dtype=np.uint64).reshape(1))[0]) if len(g) else 0 for g in sets]
            low = [np.unique((g >> np.uint64(32)).astype(np.uint32).view(np.int32)) for g in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.list_(pa.int32()))], ["id", "elements"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, elements array<int>")


def text_buckets(texts: DataFrame, tau: int, copies: int) -> DataFrame:
    """key, id, own, fp, n: who meets in some partition of some copy. texts: id, n, w, written down."""
    fps = texts.select("id", "n", F.posexplode("w").alias("copy", "fp"))
    total, both = bit_statistics(fps)
    if total == 0:
        return texts.select(F.col("id").alias("key"), "id", F.lit(True).alias("own"), F.lit(0).cast("long").alias("fp"), "n").limit(0)
    # The copies differ in weights only, so one plan for the number of texts does for all.
    parts = plan(total // copies, both / copies, tau, reach=1 if tau <= 3 else 2)
    rows = probes(fps, parts, ["id", "n", "copy"]).select(F.xxhash64("copy", "part", "key").alias("key"), "id", "own", "fp", "n")
    full = rows.groupBy("key").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n"), F.bit_count(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("spread"))
    # The spread of two is their distance.
    full = full.where(f"n_own >= 1 and n >= 2 and not (n = 2 and spread > {tau})")
    return materialize(rows.join(full.select("key"), "key", "left_semi"), "meetings")


def similar_texts(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], tau: int = 2, similarity: float = 0.8, copies: int = 8) -> DataFrame:
    """id, component of texts (id, n, w) that lie within tau bits in some copy and are similar by their whole shingle sets.

    `sets_of` gives id and elements for a table of ids. Only texts that meet another are asked for.
    """
    met = text_buckets(texts, tau, copies)
    sets = materialize(sets_of(met.select("id").distinct()), "shingles")

    def meets(x: str, y: str) -> Column:
        near = F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= tau
        return near & (F.least(f"{x}n", f"{y}n") >= similarity * F.greatest(f"{x}n", f"{y}n") - 1e-9)

    def split(ids: DataFrame) -> tuple:
        return prefixes(sets.join(ids, "id", "left_semi"), similarity)

    out = linked(met, lambda pairs: similar_sets(pairs, sets, similarity), meets, split, FULL)
    discard(met, sets)
    return out


def one_of_each(docs: DataFrame, tau: int = 2, width: int = 5, similarity: float = 0.8, copies: int = 8) -> DataFrame:
    """docs without near copies: of each group of linked documents the least doc_id stays.

    Texts without words are copies of each other. A null doc_id counts as the
    largest. Rows that repeat a doc_id are one document; the row with the least
    hash of its text speaks for it.
    """
    last = F.lit((1 << 63) - 1)
    key = F.coalesce(F.col("doc_id").cast("long"), last)
    sig = materialize(signatures(docs, copies, width).withColumn("doc_id", F.coalesce("doc_id", last)), "signatures")
    texts = materialize(sig.groupBy("id").agg(F.min("n").alias("n"), F.min("w").alias("w"), F.min("doc_id").alias("least")), "texts")
    at, stay, row = unused(docs, "at", "stay", "row")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = texts.join(ids, "id", "left_semi").select(F.col("least").alias(stay)).distinct()
        found = shingle_sets(docs.join(wanted, key == F.col(stay), "left_semi"), width)
        return found.join(ids, "id", "left_semi").groupBy("id").agg(F.min("elements").alias("elements"))

    groups = similar_texts(texts, sets_of, tau, similarity, copies)
    of = texts.select("id", "least").join(groups, "id", "left").select(F.coalesce("component", "id").alias("component"), "least")
    kept = docs.join(of.groupBy("component").agg(F.min("least").alias(stay)).select(stay), key == F.col(stay), "left_semi")
    twice = materialize(sig.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(stay)), "repeated-ids")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, key == F.col(stay), "left_anti")
    several = kept.join(twice, key == F.col(stay), "left_semi").groupBy(key.alias(at)).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias(row))
    return single.unionByName(several.select(f"{row}.*"))


def components(fps: DataFrame, links: DataFrame) -> DataFrame:
    """fp and component_id, the smallest doc_id of all linked fingerprints. fps: doc_id, fp."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(links).withColumnRenamed("id", "fp")
    of = least.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least_of = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return of.join(least_of, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: links at `tau` bits or fewer, exactly."""
    fps = materialize(fingerprints(docs), "fingerprints")
    links = link_exact(fps.select("fp").distinct(), tau)
    return fps.join(components(fps, links), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
