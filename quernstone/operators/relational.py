"""Relational operators: counts, profiles, top-k, averages, partition studies, histograms and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled


def word_count(lines: DataFrame, column: str = "value", keep_empty: bool = True) -> DataFrame:
    """word, n: pieces between single spaces, as they are spelled."""
    words = lines.select(F.explode(F.split(column, " ")).alias("word"))
    return (words if keep_empty else words.where("word <> ''")).groupBy("word").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """key, n of the k most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def profile(df: DataFrame, year: Column, user: str, item: str) -> DataFrame:
    """One row: rows, rows where `year` holds, distinct users and items."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(year).alias("n_in_year"), F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"))


def average_by(df: DataFrame, key: str, value: str, name: str = "average") -> DataFrame:
    """Average by key, highest first, ties by key."""
    return df.groupBy(key).agg(F.avg(value).alias(name)).orderBy(F.desc(name), key)


def partition_sizes(df: DataFrame) -> DataFrame:
    """partition, n: rows in each physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def placed_by_first_letter(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt to partition (code of the key's first character) modulo n."""
    return df.repartitionById(n, (F.ascii(key) % n).cast("int"))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """key, ix: distinct keys numbered from 0 in order, without a window over all of them.

    Ranges are sorted apart; the number of ranges, not of keys, bounds what is joined.
    """
    keys = df.select(key).distinct().repartitionByRange(key)
    ranged = settled(keys.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(key)
    return ranged.join(starts, "__range").select(key, (F.col("__start") + F.row_number().over(inside) - 1).cast("long").alias("ix"))


def numbered(df: DataFrame, key: str, id: str) -> tuple[DataFrame, int]:
    """id, ix of the rows of df, and how many numbers there are: those of `dense_index`, but keys are shuffled once and never written.

    A range holds all rows of its keys, so a key's number is its place in the range and what comes before.
    """
    ranged = df.select(key, id).repartitionByRange(key).groupBy(key).agg(F.collect_list(id).alias("ids")).sortWithinPartitions(key)
    at = F.monotonically_increasing_id()
    placed = settled(ranged.select(at.alias("__at"), "ids").select(F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__at"), "ids"), "numbered")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").select(F.explode("ids").alias(id), (F.col("__start") + F.col("__at")).alias("ix")), placed.count()


def histogram(df: DataFrame, column: str, edges: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """bin, n: bin k holds values from edge k-1 to under edge k."""
    at = F.lit(0)
    for e in edges:
        at = at + (F.col(column) >= e).cast("int")
    return df.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rmse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(prediction), F.lit(2.0)))).alias("rmse"))


def bernoulli(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Each row with the chance `fraction`, by 32 bits of the MD5 of its key, so reruns and partitionings take the same rows."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(u < int(fraction * (1 << 32)))


def with_default(truth: DataFrame, predictions: DataFrame, keys: list[str], value: str, default: float = 0.0) -> DataFrame:
    """Every row of truth with its prediction, `default` where there is none."""
    return truth.join(predictions, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
