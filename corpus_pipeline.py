"""The corpus pipeline: documents through five stages, each written and read again.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return
the columns of documents. Stages work on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, decontaminate, mixing, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model learns from the labelled ones among them all."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents have are cut; documents that nothing is left of go."""
    return substring.remove(docs, substring.repeats(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share 150 % of all words; a row for each copy taken."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_near_copy),
    ("substring", cut_repeats),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: Learned and iterative stages have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
