"""What the operators share: shared storage, tokens, schemas, components and links within buckets."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import discard, shared_dir
from ..sources.sinks import settled as materialize

#: Java and Python pattern of the separators of words: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers up to which a counted table is broadcast.
SMALL = 200_000


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quernstone/{tag}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if a count of its rows is at most `most`; else the join shuffles, and AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def words_of(text: Column) -> Column:
    """Array of words between ASCII separators; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased (other letters keep their case)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(words: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def remix(h: np.ndarray) -> np.ndarray:
    """A second, well mixed hash of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` elements; of the whole if there are fewer."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every endpoint: columns id, component.

    edges has columns a and b. Alternating large-star and small-star steps halve
    the trees' depth, so rounds grow with the logarithm of the longest chain;
    each round is a pair of aggregations by node, written to the shared folder. The
    least neighbours are written down too, so AQE can split the join at a hub.
    Self-links and null endpoints are ignored.
    """

    def star(links: DataFrame, large: bool, parts: int) -> DataFrame:
        pairs = (
            links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if large
            else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        least = materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(parts), "least")
        joined = pairs.join(least, "a")
        if large:
            joined = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            # A node's own link to its least neighbour comes from the table of those.
            joined = least.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        out = materialize(joined.where(F.col("a") != F.col("b")).distinct().coalesce(parts), "links")
        discard(links, least)
        return out

    def mark(links: DataFrame) -> tuple:
        r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = materialize(links.distinct(), "links")
    before = mark(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        parts = 1 + before[0] // 50_000  # few links need few files
        links = star(star(links, True, parts), False, parts)
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def similar_sets(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs (a, b and others) whose sets (id, elements) have Jaccard similarity `threshold` or more, exactly."""
    side = lambda i, e: sets.select(F.col("id").alias(i), F.col("elements").alias(e))
    # a may be the leader of many: its elements join last, so they are shuffled once.
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9).select(*pairs.columns)


def prefixes(sets: DataFrame, threshold: float) -> tuple[DataFrame, Callable[[str, str], Column]]:
    """Buckets key, id, own, alone, n, shared, rank of the rarest elements of each set, by which all similar sets meet, and who may meet.

    Sets of n elements with similarity t share one of the first n - ceil(t n) + 1
    elements in any common order; in that of rising frequency, sets which
    only share what is frequent do not meet. A set has no more in common with another
    than its elements that aren't its own alone (`shared`), and than what follows the
    first element they share; where they meet by a later one, they needn't pass.
    """
    each = sets.select("id", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    counts = each.groupBy("e").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "e")
    ranked = each.join(counts, "e").withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count_if(F.col("df") > 1).over(Window.partitionBy("id")))
    some = ranked.where((F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) & (F.col("df") > 1) & (F.col("shared") >= threshold * F.col("n") - 1e-9))

    def may(x: str, y: str) -> Column:
        most = F.least(f"{x}shared", f"{y}shared", F.col(f"{x}n") - F.col(f"{x}rank") + 1, F.col(f"{y}n") - F.col(f"{y}rank") + 1)
        return most * (1 + threshold) >= threshold * (F.col(f"{x}n") + F.col(f"{y}n")) - 1e-6

    return some.select(F.xxhash64("e", F.lit("prefix")).alias("key"), "id", F.lit(True).alias("own"), (F.col("n") - F.col("shared")).alias("alone"), "n", "shared", "rank"), may


def linked(buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], meets: Callable[[str, str], Column] | None = None, split: Callable[[DataFrame], tuple] | None = None, dense: int = 64) -> DataFrame:
    """id, component: components of all pairs that share a bucket, one of them its own, and that `meets` and `confirm` accept.

    buckets, written down: key, id, own and what `meets`, given two prefixes of
    column names, reads. First the least own member of each bucket meets all others;
    what `confirm` accepts is joined to components. Then, in each bucket that
    still has several, members outside its largest component meet all members of
    others, from more of them in every round, and leave (`rest_linked`). So no pair is left
    out that could join two components, and none within a component is tried:
    copies cost one pair a member. Buckets of more than `dense` pairs that
    are left after the first round go to `split`, which gives other buckets for
    their ids, by which all pairs that `confirm` accepts meet, and their `meets`.
    """
    meets = meets or (lambda x, y: F.lit(True))
    others = [c for c in buckets.columns if c not in ("key", "id", "own")]
    first = materialize(leaders(buckets.where("own"), ["key"], ["id", *others]), "leaders")
    good = materialize(confirm(met(buckets, first, meets).select(*in_order()).distinct()), "confirmed")
    known = settled_components(good)
    rest = with_component(buckets.join(first.select("key", F.col("a_id").alias("leader")), "key").where("id <> leader").drop("leader"), known)
    rest = materialize(several(rest), "rest")
    discard(first, good)
    if split is None:
        return rest_linked(rest, known, confirm, meets)
    sizes = rest.groupBy("key").agg((F.sum(F.col("own").cast("long")) * F.count("*")).alias("n")).where(F.col("n") > dense).select("key")
    full = materialize(rest.join(sizes, "key", "left_semi").select("id").distinct(), "dense")
    thin = materialize(rest.join(sizes, "key", "left_anti"), "rest")
    discard(rest)
    known = rest_linked(thin, known, confirm, meets)
    if not full.isEmpty():
        finer, may = split(full)
        known = rest_linked(materialize(several(with_component(finer, known)), "rest"), known, confirm, may)
    discard(full)
    return known


def leaders(rows: DataFrame, by: list, fields: list[str]) -> DataFrame:
    """key and the fields, with a_ before their names, of the least member by group."""
    return rows.groupBy(*by).agg(F.min(F.struct(*fields)).alias("m")).select("key", *(F.col(f"m.{c}").alias(f"a_{c}") for c in fields))


def met(rows: DataFrame, lead: DataFrame, meets: Callable[[str, str], Column]) -> DataFrame:
    """Members of buckets beside each leader of theirs that they may be alike."""
    kept = {"key": "key", "id": "id", "component": "component"}
    named = rows.select(*(F.col(c).alias(kept.get(c, f"b_{c}")) for c in rows.columns))
    return named.join(lead, "key").where((F.col("id") != F.col("a_id")) & meets("a_", "b_"))


def in_order() -> list[Column]:
    """A tried pair, lesser id first."""
    return [F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b")]


def settled_components(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links), "components")


def rest_linked(rest: DataFrame, known: DataFrame, confirm: Callable[[DataFrame], DataFrame], meets: Callable[[str, str], Column]) -> DataFrame:
    """`known` components with what members of different ones in a bucket add. rest: as buckets, with component; written down, and deleted here."""
    # Who has the fewest elements of its own comes first: most are like it.
    fields = sorted((c for c in rest.columns if c != "key"), key=lambda c: (c != "alone", c != "id"))
    cells = 1
    while not rest.isEmpty():
        sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
        top = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top")).select("key", F.col("top.component").alias("top"))
        outside = rest.join(top, "key").where("component <> top").drop("top") if cells > 1 else rest
        cell = F.pmod(F.xxhash64("id", F.lit(cells)), F.lit(cells)).alias("cell")
        lead = materialize(leaders(outside, ["key", cell], fields), "leaders")
        tried = met(rest, lead, meets).where("component <> a_component and (a_own or b_own)")
        pairs = tried.select(*in_order(), F.least("component", "a_component").alias("ca"), F.greatest("component", "a_component").alias("cb")).distinct()
        good = materialize(confirm(pairs), "confirmed")
        merged = settled_components(good.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        to = merged.select(F.col("id").alias("component"), F.col("component").alias("now"))
        moved = lambda df: df.join(to, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")  # noqa: E731, B023
        fresh = merged.join(known.select("id"), "id", "left_anti")
        now = materialize(moved(known).select("id", "component").unionByName(fresh.select("id", "component")), "components")
        left = rest.join(lead.select("key", F.col("a_id").alias("id")), ["key", "id"], "left_anti")
        after = materialize(several(moved(left).select(*rest.columns)), "rest")
        discard(rest, lead, good, merged, known)
        rest, known, cells = after, now, 8 * cells if cells < 64 else 1 << 30
    discard(rest)
    return known


def with_component(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def several(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components and members of their own."""
    keys = rows.groupBy("key").agg(F.max("own").alias("o"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("o and lo <> hi").select("key")
    return rows.join(keys, "key", "left_semi")


def solve_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + l2 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-squared law with d degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_cdf(x: float, d: int) -> float:
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    k = a
    for _ in range(2000):
        k += 1
        term *= z / k
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))

