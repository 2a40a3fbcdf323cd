"""Stream sketches as batch queries, free of the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bloom_rate, bytes_mod, coefficients, linear_hash, n_hashes, trailing_zeros


def bloom_series(spark: SparkSession, bits: int = 69997, batch: int = 100, batches: int = 50) -> DataFrame:
    """batch, fpr: the expected rate of false positives after each batch."""
    k = n_hashes(bits, batch, batches)
    return spark.range(batches).select(F.col("id").alias("batch"), F.round(bloom_rate(bits, k, (F.col("id") + 1) * batch), 6).alias("fpr"))


def bloom_seen(events: DataFrame, order: str, key: str, bits: int = 69997, k: int = 9) -> DataFrame:
    """order, seen, new: what a Bloom filter says of each event, and whether the key really is new.

    A key is reported once the last of its bits is set, which the first events of
    keys settle; so only distinct keys are hashed and joined.
    """
    first = events.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first"))
    x = bytes_mod(F.col("key").cast("string"), bits)
    spread = first.withColumn("x", x).select("key", "first", F.explode(F.array(*(linear_hash(F.col("x"), a, b, bits) for a, b in coefficients(k)))).alias("bit"))
    set_at = spread.groupBy("bit").agg(F.min("first").alias("at"))
    ready = spread.join(set_at, "bit").groupBy("key", "first").agg(F.max("at").alias("ready"))
    return events.join(ready, F.col(key) == F.col("key")).select(order, (F.col("ready") < F.col(order)).alias("seen"), (F.col("first") == F.col(order)).alias("new"))


def flajolet_martin(events: DataFrame, batch: Column, key: str, hashes: int = 50, group: int = 2, m: int = 6999) -> DataFrame:
    """batch, truth, estimate: median over groups of mean 2^R, R the most trailing zeros of a hash."""
    rows = events.select(batch.alias("batch"), F.col(key).alias("key")).distinct().withColumn("x", bytes_mod(F.col("key").cast("string"), m))
    most = rows.groupBy("batch").agg(F.count("*").alias("truth"), *(F.max(trailing_zeros(linear_hash(F.col("x"), a, b, m))).alias(f"r{j}") for j, (a, b) in enumerate(coefficients(hashes))))
    means = [sum((F.pow(F.lit(2.0), F.col(f"r{j}")) for j in range(g, g + group)), F.lit(0.0)) / group for g in range(0, hashes, group)]
    ordered = most.select("batch", "truth", F.array_sort(F.array(*means)).alias("s"))
    n = len(means)
    return ordered.select("batch", "truth", ((F.col("s")[(n - 1) // 2] + F.col("s")[n // 2]) / 2).alias("estimate"))


def reservoir(events: DataFrame, key: str, size: int = 100) -> DataFrame:
    """A uniform sample that reruns repeat: the `size` keys of least MD5, and that digest as `priority`."""
    return events.select(key, F.md5(F.col(key).cast("string").cast("binary")).alias("priority")).orderBy("priority", key).limit(size)
