"""Clustering by summaries: moments, diagonal Mahalanobis distance, and BFR over batches.

Summaries are as many as clusters, a parameter, so the driver holds them and puts
them into expressions; points never leave the executors. Within a batch the
summaries are frozen, so results do not depend on the order of points.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settled

Summary = tuple[int, list[float], list[float]]


def moments(points: DataFrame, cluster: str, features: str) -> DataFrame:
    """cluster, dim, n, total, squares."""
    each = points.select(F.col(cluster).alias("cluster"), F.posexplode(features).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def summaries(points: DataFrame, cluster: str, features: str) -> dict[int, Summary]:
    rows = moments(points, cluster, features).groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total", "squares"))).alias("m")).collect()
    return {r.cluster: (r.n, [x.total for x in r.m], [x.squares for x in r.m]) for r in rows}


def merged(a: Summary, b: Summary) -> Summary:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]


def centre(s: Summary, floor: float = 1e-9) -> tuple[list[float], list[float]]:
    """Means and standard deviations."""
    n, total, squares = s
    return [x / n for x in total], [math.sqrt(max(floor, q / n - (x / n) ** 2)) for x, q in zip(total, squares, strict=True)]


def nearest(known: dict[int, Summary], features: str) -> Column:
    """Struct distance, cluster of the nearest summary (ties: the least cluster); null without summaries."""
    if not known:
        return F.lit(None).cast("struct<distance:double,cluster:int>")
    options = []
    for k, s in sorted(known.items()):
        mean, sd = centre(s)
        z = F.zip_with(F.zip_with(features, F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m), F.array(*map(F.lit, sd)), lambda x, d: (x / d) * (x / d))
        options.append(F.struct(F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x)).alias("distance"), F.lit(int(k)).alias("cluster")))
    return F.array_min(F.array(*options))


def k_means(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, features, cluster."""
    ready = points.withColumn("__v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    return KMeans(k=max(2, k), seed=seed, featuresCol="__v", predictionCol="cluster").fit(ready).transform(ready).select("id", "features", "cluster")


def split_by_size(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points in clusters of several, and those alone."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
    both = clustered.join(sizes, "cluster")
    return both.where("n > 1").drop("n"), both.where("n = 1").drop("n")


class Bfr:
    """Discard, compression and retained sets. CS clusters have numbers of their own."""

    def __init__(self, k: int, dimensions: int, seed: int = 42) -> None:
        self.k, self.near, self.seed = k, 2 * math.sqrt(dimensions), seed
        self.ds: dict[int, Summary] = {}
        self.cs: dict[int, Summary] = {}
        self.next_cs = 0
        self.assigned: list[DataFrame] = []  # id, ds, cs of points that are summed up
        self.rs: DataFrame | None = None
        self.rounds: list[tuple[int, int, int, int, int]] = []

    def start(self, points: DataFrame) -> None:
        points = settled(points, "batch")
        _, alone = split_by_size(k_means(points, 4 * self.k, self.seed))
        alone = settled(alone.select("id", "features"), "alone")
        rest = points.join(alone.select("id"), "id", "left_anti")
        placed = settled(k_means(rest, self.k, self.seed), "placed")
        self.ds = summaries(placed, "cluster", "features")
        self.assigned.append(placed.select("id", F.col("cluster").alias("ds"), F.lit(None).cast("int").alias("cs")))
        self.retain(alone)

    def retain(self, points: DataFrame) -> None:
        """Cluster what is retained; clusters of several go to CS."""
        n = points.count()
        if n < 3:  # no clustering leaves one of two alone
            self.rs = points
            return
        k = 5 * self.k if n > 5 * self.k else n - 1
        several, alone = split_by_size(k_means(points, k, self.seed))
        several = settled(several.withColumn("cluster", F.col("cluster") + self.next_cs), "several")
        self.next_cs += k
        self.cs |= summaries(several, "cluster", "features")
        self.assigned.append(several.select("id", F.lit(None).cast("int").alias("ds"), F.col("cluster").alias("cs")))
        self.rs = settled(alone.select("id", "features"), "retained")

    def add(self, points: DataFrame) -> None:
        rest = points
        for kind in ("ds", "cs"):
            known: dict[int, Summary] = getattr(self, kind)
            judged = settled(rest.withColumn("at", nearest(known, "features")), "judged")
            mine = judged.where(F.col("at.distance") < self.near).select("id", "features", F.col("at.cluster").alias("cluster"))
            for c, s in summaries(mine, "cluster", "features").items():
                known[c] = merged(known[c], s)
            other = "cs" if kind == "ds" else "ds"
            self.assigned.append(mine.select("id", F.col("cluster").alias(kind), F.lit(None).cast("int").alias(other)))
            rest = judged.where(F.coalesce(F.col("at.distance") >= self.near, F.lit(True))).select("id", "features")
        self.retain(settled(rest if self.rs is None else rest.unionByName(self.rs), "to-retain"))
        self.merge_compressed()

    def merge_compressed(self) -> None:
        """Merge the closest CS clusters while they are near; sums are added."""
        while len(self.cs) > 1:
            ids = sorted(self.cs)
            gaps = [(self.gap(self.cs[a], self.cs[b]), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
            d, a, b = min(gaps)
            if d >= self.near:
                return
            self.cs[a] = merged(self.cs[a], self.cs.pop(b))
            self.assigned = [x.withColumn("cs", F.when(F.col("cs") == b, F.lit(a)).otherwise(F.col("cs"))) for x in self.assigned]

    @staticmethod
    def gap(a: Summary, b: Summary) -> float:
        (ma, _), (mb, sb) = centre(a), centre(b)
        return math.sqrt(sum(((x - y) / s) ** 2 for x, y, s in zip(ma, mb, sb, strict=True)))

    def report(self, number: int) -> None:
        self.rounds.append((number, sum(s[0] for s in self.ds.values()), len(self.cs), sum(s[0] for s in self.cs.values()), self.rs.count() if self.rs is not None else 0))

    def finish(self) -> DataFrame:
        """id, cluster: CS clusters near a DS cluster join it, others and what is retained get -1."""
        to = {}
        for c, s in self.cs.items():
            best = min(((self.gap(s, d), k) for k, d in self.ds.items()), default=(math.inf, -1))
            to[c] = best[1] if best[0] < self.near else -1
        moved = F.lit(-1)
        for c, k in to.items():
            moved = F.when(F.col("cs") == c, F.lit(k)).otherwise(moved)
        out = self.assigned[0]
        for x in self.assigned[1:]:
            out = out.unionByName(x)
        out = out.select("id", F.coalesce("ds", moved).cast("int").alias("cluster"))
        return out if self.rs is None else out.unionByName(self.rs.select("id", F.lit(-1).alias("cluster")))


def bfr(points: DataFrame, k: int, batches: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """rounds (round, n_ds, n_cs_clusters, n_cs, n_rs) and assignments (id, cluster) of points (id, features)."""
    first = points.first()
    model = Bfr(k, len(first["features"]) if first else 1, seed)
    for h in range(batches):
        part = points.where(F.pmod("id", F.lit(batches)) == h).select("id", "features")
        model.start(part) if h == 0 else model.add(part)
        model.report(h + 1)
    rounds = points.sparkSession.createDataFrame(model.rounds, "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    return rounds, model.finish()
