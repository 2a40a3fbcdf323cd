"""Writers: JSON metrics, CSV predictions, and the text reports of itemsets, communities, edges and clusters."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Without it only a session on one machine gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.mkdtemp(prefix="quernstone-"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of an iteration by a table in the shared folder; it outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/quernstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("settled_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition: one task for all would hold the sorts and hash tables of every partition."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None, header: bool = True) -> None:
    """Doubles at `digits` decimals, or in full."""
    shown = {n: F.format_string(f"%.{digits}f", n) for n, t in df.dtypes if t == "double" and digits is not None}
    df.withColumns(shown).write.mode("overwrite").csv(path, header=header, quote="\"", escape="\"")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def quoted(items: str | Column) -> Column:
    """('a', 'b') of an array; a single item as ('a')."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """size and line: all itemsets of a size in one line, in order."""
    return itemsets.groupBy("size").agg(F.array_join(F.array_sort(F.collect_list(quoted(F.array_sort("items")))), ",").alias("line")).orderBy("size")


def community_report(communities: DataFrame) -> DataFrame:
    """line: 'a', 'b' for each community (array members), by size and members."""
    ordered = communities.select(F.array_sort("members").alias("members")).orderBy(F.size("members"), "members")
    return ordered.select(F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ").alias("line"))


def edge_report(edges: DataFrame) -> DataFrame:
    """line: ('a', 'b'),12.0 by betweenness, highest first."""
    rounded = edges.withColumn("betweenness", F.round("betweenness", 5)).orderBy(F.desc("betweenness"), "src", "dst")
    return rounded.select(F.concat(quoted(F.array("src", "dst")), F.lit(","), F.col("betweenness").cast("string")).alias("line"))


def rounds_report(rounds: DataFrame) -> DataFrame:
    """line: Round i: discard points, compression clusters, compression points, retained points."""
    return rounds.orderBy("round").select(F.format_string("Round %d: %d,%d,%d,%d", "round", "n_ds", "n_cs_clusters", "n_cs", "n_rs").alias("line"))
