"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Among all document rates r in [0, limit] that give each source its target of
words, take those closest in relative entropy to one copy of each. The dual is
convex with one multiplier per source, and its solution tilts exponentially:
r = min(limit, exp(lambda * size / mean size)). Newton steps, safeguarded by
bisection, solve all sources at once on the counts of (source, size).

Rates become copies: floor(r), and one more where a uniform hash of doc_id less
the fraction of r is under the source's threshold. Threshold zero would be right
on average; the one used, found in two passes over histograms of 4096 bins, is
the nearest to the target. What then is off by part of a document is mended by one
copy more or less of the one document that fits the difference best.

All that decides is a row of numbers for each source (`plan`). It meets the documents
by a broadcast where a count of the sources allows, else by a join whose hot
sources AQE splits; texts are not shuffled by source or document.

Nulls: a null text has no words, a null source is a source of its own, the last
in order; a null doc_id is rounded as one. Rows that repeat a doc_id and a size are rounded
alike. Texts without words take nothing. Sources without words, and an empty
table, have target zero. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import dense_index
from .common import SPACE, discard, if_small, materialize, table, unused

BLANK = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words between ASCII separators."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def targets(by_source: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Adds sid and target to source, source_size, n. by_source has a row per source and is written down.

    Sources in order of code points, null last, have `weights` in turn; they share
    `share` times all words. A target stops at `limit` times its source; the rest
    is shared again by weight. That is a level: target = min(cap, level * weight).
    It rises as sources reach their caps, one aggregation for each step.
    """
    order = dense_index(by_source.where("source is not null").select("source"), "source")
    last = by_source.where("source is not null").count()
    at = F.col("ix") % len(weights) + 1
    ranked = by_source.join(if_small(order), "source", "left").withColumn("ix", F.coalesce("ix", F.lit(last)))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), at.cast("int"))).withColumn("cap", limit * F.col("source_size"))
    ranked = materialize(ranked.select("source", (F.col("ix") + 1).alias("sid"), "source_size", "n", "weight", "cap"), "ranked")
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("cap") < level * F.col("weight")
        capped, free = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (share * words - (capped or 0.0)) / free if free else float("inf")
        if now <= level * (1 + 1e-15):
            break
        level = now
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "sid", "source_size", "n", "target")


def rate(limit: float) -> Column:
    """From columns size, mean_size, lam; lam is null where all documents are at the limit."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.greatest("mean_size", F.lit(1e-9)), F.lit(50.0)))
    return F.when(F.col("lam").isNull(), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), tilt))


def solve(counts: DataFrame, sources: DataFrame, limit: float, rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """sid, mean_size, lam for every source. counts: sid, size, n; sources as of `targets`."""
    at_limit = F.col("target") >= limit * F.col("source_size") * (1 - 1e-9)
    state = sources.select(
        "sid",
        "target",
        (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean_size"),
        F.when(~at_limit, F.lit(0.0)).alias("lam"),
        F.lit(-200.0).alias("low"),
        F.lit(200.0).alias("high"),
    )
    state = materialize(state, "multipliers")
    for _ in range(rounds):
        seen = counts.join(if_small(state), "sid").where("lam is not null and size > 0").withColumn("r", rate(limit))
        words = F.col("n") * F.col("size") * F.col("r")
        slope = F.when(F.col("r") < limit, words * F.col("size") / F.col("mean_size")).otherwise(0.0)
        sums = seen.groupBy("sid").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        now = state.join(sums, "sid", "left").withColumn("gap", F.coalesce(F.col("words") - F.col("target"), F.lit(0.0)))
        now = now.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")))
        now = now.withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") - F.col("gap") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        moved = F.when(F.col("gap") == 0, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        now = now.withColumn("off", F.abs("gap") / F.greatest("target", F.lit(1.0))).withColumn("lam", F.when(F.col("lam").isNotNull() & (F.col("off") > tolerance), moved).otherwise(F.col("lam")))
        now = materialize(now.select("sid", "target", "mean_size", "lam", "low", "high", "off"), "multipliers")
        discard(state)
        state = now
        worst = now.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            return state.select("sid", "mean_size", "lam")
        state = now.drop("off")
        state.settled_at = now.settled_at
    raise RuntimeError(f"a source's words are still off by {worst} of its target after {rounds} rounds")


def thresholds(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """sid and q_end: documents with q < q_end get one more copy. rated: sid, size, whole, more, q."""
    fixed = rated.groupBy("sid").agg(F.sum(F.col("size") * F.col("whole")).alias("fixed"))
    need = sources.join(fixed, "sid").select("sid", (F.col("target") - F.col("fixed")).alias("need"))
    more = rated.where("more and size > 0").withColumn("coarse", F.shiftright("q", 12)).withColumn("fine", F.col("q").bitwiseAND(F.lit(4095)))
    up_to = Window.partitionBy("sid").orderBy("coarse")
    coarse = more.groupBy("sid", "coarse").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(up_to)).join(need, "sid")
    cut = coarse.where("upto > need").groupBy("sid").agg(F.min(F.struct("coarse", (F.col("need") - F.col("upto") + F.col("words")).alias("left"))).alias("c")).select("sid", "c.coarse", "c.left")
    cut = materialize(cut, "cuts")
    by_fine = Window.partitionBy("sid").orderBy("fine")
    fine = more.join(if_small(cut), ["sid", "coarse"]).groupBy("sid", "coarse", "left", "fine").agg(F.sum("size").alias("words"))
    fine = fine.withColumn("upto", F.sum("words").over(by_fine)).withColumn("off", F.abs(F.col("upto") - F.col("left")))
    none = cut.select("sid", "coarse", F.lit(-1).alias("fine"), F.abs("left").alias("off"))
    ends = fine.select("sid", "coarse", F.col("fine").cast("int").alias("fine"), "off").unionByName(none)
    best = ends.groupBy("sid").agg(F.min(F.struct("off", (F.col("coarse") * 4096 + F.col("fine") + 1).alias("q_end"))).alias("b")).select("sid", "b.q_end")
    return sources.select("sid").join(best, "sid", "left").select("sid", F.coalesce("q_end", F.lit(1 << 24)).alias("q_end"))


def hash_of_id(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("mix"))


def rated(keyed: DataFrame, limit: float) -> DataFrame:
    """Adds rate, whole, more and q to rows with h, size, mean_size and lam."""
    u = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    out = keyed.withColumn("rate", rate(limit)).withColumn("whole", F.floor("rate")).withColumn("more", F.col("rate") < limit)
    return out.withColumn("q", F.floor((u - (F.col("rate") - F.col("whole")) + 1) * (1 << 23)).cast("long"))


def rounded() -> Column:
    """Copies by rate and threshold."""
    return F.col("whole") + (F.col("more") & (F.col("q") < F.col("q_end"))).cast("long")


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """A row for each source: what rates, rounds and mends its documents. sized: source, h, size, written down."""
    by_source = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "by-source")
    sources = materialize(targets(by_source, weights, share, limit), "sources")
    counts = materialize(with_plan(sized.groupBy("source", "size").agg(F.count("*").alias("n")), sources.select("source", "sid")).select("sid", "size", "n"), "counts")
    lam = materialize(sources.join(solve(counts, sources, limit), "sid"), "multipliers")
    known = materialize(rated(with_plan(sized, lam), limit).select("sid", "size", "h", "whole", "more", "q"), "rates")
    ends = materialize(lam.join(thresholds(known, sources), "sid"), "thresholds")
    # One copy more or less of one document, or of the rows that repeat it, where that nears the target.
    taken = known.join(if_small(ends.select("sid", "q_end")), "sid").withColumn("copies", rounded())
    off = materialize(taken.groupBy("sid").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).join(sources, "sid").select("sid", (F.col("target") - F.col("words")).alias("off")), "off")
    step = F.when(F.col("off") > 0, 1).otherwise(-1)
    free = F.col("copies") + step
    able = taken.join(if_small(off), "sid").where((F.col("size") > 0) & (free >= 0) & (free <= limit) & (F.col("size") <= 2 * F.abs("off")))
    each = able.groupBy("sid", "size", "h").agg(F.count("*").alias("n"), F.first("off").alias("off"))
    gap = F.abs(F.abs("off") - F.col("size") * F.col("n"))
    best = each.where(gap < F.abs("off")).groupBy("sid").agg(F.min(F.struct(gap.alias("gap"), "h", "size", step.alias("step"))).alias("b"))
    mend = best.select("sid", F.col("b.h").alias("mend_h"), F.col("b.size").alias("mend_size"), F.col("b.step").alias("mend_step"))
    out = materialize(ends.join(mend, "sid", "left"), "plan")
    discard(by_source, counts, lam, known, ends, off, sources)
    return out


def with_plan(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source."""
    own, source = of_source.withColumnRenamed("source", "own_source"), F.col("source")
    return rows.join(if_small(own), source.eqNullSafe(F.col("own_source"))).drop("own_source")


def decided(sized: DataFrame, of_source: DataFrame, limit: float) -> DataFrame:
    """Adds source_size, target, rate and copies to rows with source, h and size."""
    all_ = rated(with_plan(sized, of_source), limit)
    mend = F.when((F.col("h") == F.col("mend_h")) & (F.col("size") == F.col("mend_size")), F.col("mend_step")).otherwise(0)
    return all_.withColumn("copies", rounded() + mend)


def balance(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs.

    `limit` is a whole number; no document takes more than that many copies.
    """
    sized = materialize(docs.select("doc_id", "source", hash_of_id(F.col("doc_id")).alias("h"), n_words(F.col("text")).alias("size")), "sizes")
    out = decided(sized, plan(sized, weights, share, limit), limit)
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them; `copy` numbers the repeats from 1 (`_copy` if docs has a `copy`)."""
    h, size = hash_of_id(F.col("doc_id")), n_words(F.col("text"))
    sized = materialize(docs.select("source", h.alias("h"), size.alias("size")), "sizes")
    of_source = plan(sized, weights, share, limit)
    discard(sized)
    row, copy = "row", unused(docs, "copy")[0]
    rows = decided(docs.select(F.struct(*docs.columns).alias(row), "source", h.alias("h"), size.alias("size")), of_source, limit).where("copies > 0")
    return rows.select(F.col(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).select(f"{row}.*", copy)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")


QUERIES = {"op5_mixing": op5_mixing}
