"""The sketches on Structured Streaming.

State that is bounded (the bits that are set, a reservoir) is a small table in the
shared folder, one version for each micro-batch, so a batch that is run again
finds the state before it. Event-time counts use watermarks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bytes_mod, coefficients, linear_hash
from ..sources.sinks import shared_dir


def read_events(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The events as a stream of micro-batches: equal ranges of event_id, a file each, in order.

    A file source takes the oldest files first, so the files are written one after
    another. Watermarks need a timestamp with zone.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = f"{shared_dir(spark)}/quernstone-stream/events-{uuid.uuid4().hex}"
    width = F.lit((events.agg(F.max("event_id")).first()[0] or 0) + 1)
    for k in range(batches):
        events.where(F.floor(F.col("event_id") * batches / width) == k).coalesce(1).write.parquet(f"{root}/{k}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class Folder:
    """Versions of a table by micro-batch, and a checkpoint."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/quernstone-stream/{tag}-{uuid.uuid4().hex}"
        self.checkpoint = f"{self.root}/checkpoint"

    def version(self, batch: int) -> str:
        return f"{self.root}/v{batch}"


def run_batches(stream: DataFrame, folder: Folder, step) -> int:
    """Calls step(batch DataFrame, number) for each micro-batch of what is there; returns their number."""
    last = [-1]

    def each(df: DataFrame, number: int) -> None:
        step(df, number)
        last[0] = number

    stream.writeStream.foreachBatch(each).option("checkpointLocation", folder.checkpoint).trigger(availableNow=True).start().awaitTermination()
    return last[0] + 1


def stream_reservoir(stream: DataFrame, key: str, size: int = 100) -> DataFrame:
    """key, priority: the `size` least hashes over all batches."""
    from ..operators.sketches import reservoir

    folder = Folder(stream.sparkSession, "reservoir")

    def step(df: DataFrame, number: int) -> None:
        best = reservoir(df, key, size)
        if number:
            best = best.unionByName(folder.spark.read.parquet(folder.version(number - 1))).orderBy("priority", key).limit(size)
        best.write.mode("overwrite").parquet(folder.version(number))

    n = run_batches(stream, folder, step)
    return folder.spark.read.parquet(folder.version(n - 1)) if n else folder.spark.createDataFrame([], f"{key} long, priority string")


def stream_bloom(stream: DataFrame, key: str, bits: int = 69997, k: int = 9) -> DataFrame:
    """batch, n, seen, wrong: distinct keys in each micro-batch, those all of whose bits earlier batches set, and those of them that are new.

    The keys so far, which tell the wrong ones, are a table of their own beside the filter.
    """
    folder, counts = Folder(stream.sparkSession, "bloom"), Folder(stream.sparkSession, "bloom-counts")

    def step(df: DataFrame, number: int) -> None:
        keys = df.select(F.col(key).alias("key")).distinct().withColumn("x", bytes_mod(F.col("key").cast("string"), bits))
        spread = keys.select("key", F.explode(F.array_distinct(F.array(*(linear_hash(F.col("x"), a, b, bits) for a, b in coefficients(k))))).alias("bit"))
        read = folder.spark.read.parquet
        if number:
            before, known = read(f"{folder.version(number - 1)}/bits").withColumn("set", F.lit(1)), read(f"{folder.version(number - 1)}/keys")
        else:
            before, known = folder.spark.createDataFrame([], "bit long, set int"), keys.select("key").limit(0)
        told = spread.join(before, "bit", "left").groupBy("key").agg((F.count("set") == F.count("*")).alias("seen"))
        told = told.join(known.withColumn("old", F.lit(True)), "key", "left")
        told.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("n"), F.count_if("seen").alias("seen"), F.count_if(F.col("seen") & F.col("old").isNull()).alias("wrong")).write.mode("overwrite").parquet(f"{counts.root}/batch={number}.parquet")
        before.select("bit").unionByName(spread.select("bit")).distinct().write.mode("overwrite").parquet(f"{folder.version(number)}/bits")
        known.unionByName(keys.select("key")).distinct().write.mode("overwrite").parquet(f"{folder.version(number)}/keys")

    n = run_batches(stream, folder, step)
    paths = [f"{counts.root}/batch={i}.parquet" for i in range(n)]
    return folder.spark.read.schema("batch long, n long, seen long, wrong long").parquet(*paths)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n by event time; rows later than `late` behind the newest are dropped."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def run_windowed(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """The windowed counts of what is there, from an append of each micro-batch's newest state."""
    folder = Folder(stream.sparkSession, "windows")

    def step(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(folder.version(number))

    updates = windowed_counts(stream, width).writeStream.outputMode("update").foreachBatch(step)
    updates.option("checkpointLocation", folder.checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = folder.spark.read.schema("start timestamp, event_type string, n long, batch int").parquet(f"{folder.root}/v*")
    return every.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
