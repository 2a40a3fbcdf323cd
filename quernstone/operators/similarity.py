"""Set similarity: exact overlaps by prefix filtering or bitmaps, MinHash signatures and LSH bands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled

#: Longs of a set's bitmap. Sets over at most 64 times as many elements are told by it alone.
WORDS = 8
#: Sets that meet in one task are dealt to blocks of about so many.
BLOCK = 8192
#: Members of a class are listed by about so many; lists, not ids, meet in the shuffles.
LISTED = 1024
#: So many different elements, by a sketch, have their counts broadcast to the sets; with more, sets go to the counts.
COUNTED = 1_000_000
MAPS = [f"w{k}" for k in range(WORDS)]


def shingles(docs: DataFrame, width: int = 3) -> DataFrame:
    """id, element: lower-cased word shingles of doc_id, text, each once a text."""
    return shingle_lists(docs, width).select("id", F.explode("s").alias("element"))


def shingle_lists(docs: DataFrame, width: int = 3, hashed: bool = False) -> DataFrame:
    """id, s (array): the different shingles of each text, or 64 bits of their hashes, without a shuffle."""
    # Explode keeps the words from being split anew for each shingle, and the shingles from being made anew for each use.
    split = F.split(F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), r"[ \t\n\x0b\f\r]+")
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(split)).alias("w")).where(F.size("w") >= width)
    shingle = lambda p: F.concat_ws(" ", *(F.get("w", p + k) for k in range(width)))
    made = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda p: F.xxhash64(shingle(p)) if hashed else shingle(p))
    return words.select("id", F.explode(F.array(F.array_distinct(made))).alias("s"))


def once_an_id(lists: DataFrame) -> DataFrame:
    """Lists (id, s) with those of an id that comes more than once made one."""
    if lists.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return lists
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))


def as_lists(sets: DataFrame) -> DataFrame:
    """id, s (array): the elements of each set (id, element), each once."""
    return sets.where("id is not null").groupBy("id").agg(F.collect_set("element").alias("s"))


def bitmap() -> list[Column]:
    """Aggregates w0..: the bits __slot, modulo 64 WORDS, of a group."""
    word, bit = F.pmod(F.shiftright("__slot", 6), F.lit(WORDS)), F.expr("shiftleft(1L, cast(__slot & 63 as int))")
    return [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")).alias(m) for k, m in enumerate(MAPS)]


def without(x: str, y: str) -> Column:
    """Bits of x's map that y's lacks: so many elements of x at least aren't in y."""
    return reduce(add, (F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{m}")))) for m in MAPS))


def in_blocks(rows: DataFrame, blocks: Column, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Two sides whose join on keys, __i and __j makes every pair of a key's rows meet once; rows of one block meet where __i = __j."""
    placed = rows.withColumn("__k", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__k")).cast("int"))
    rest = [c for c in rows.columns if c not in keys]
    side = lambda i, j: placed.select(*keys, i, j, F.struct(*rest).alias("r"))
    left = side(F.col("__b").alias("__i"), F.explode(F.sequence("__b", F.col("__k") - 1)).alias("__j"))
    right = side(F.explode(F.sequence(F.lit(0), "__b")).alias("__i"), F.col("__b").alias("__j"))
    return left.withColumnRenamed("r", "x"), right.withColumnRenamed("r", "y")


#: Of a join of two sides in blocks.
MET = "__i < __j or x.id < y.id"


def meetings(rows: DataFrame, *keys: str) -> DataFrame:
    """x, y (structs): every pair of a key's rows once. Keys of few rows are shuffled once for both sides, only hot ones are dealt to blocks."""
    hot = settled(rows.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > BLOCK).select(*keys, F.ceil(F.col("__c") / BLOCK).alias("__blocks")), "hot")
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    none = hot.isEmpty()
    one = (rows if none else rows.join(F.broadcast(hot), list(keys), "left_anti")).select(*keys, rest.alias("r"))
    # By sorting: rows exploded from a small file would be broadcast by the planner's guess of their size.
    met = one.withColumnRenamed("r", "x").join(one.withColumnRenamed("r", "y").hint("merge"), list(keys)).where("x.id < y.id").select("x", "y")
    if none:
        return met
    x, y = in_blocks(rows.join(F.broadcast(hot), list(keys)), F.col("__blocks"), *keys)
    return met.unionByName(x.join(y.hint("merge"), [*keys, "__i", "__j"]).where(MET).select(x["x"].dropFields("__blocks").alias("x"), y["y"].dropFields("__blocks").alias("y")))


def classes(sets: DataFrame, *same: Column) -> tuple[DataFrame, DataFrame]:
    """Of each class of equal sets the one with the least id, and id, rep, c (members) of all members of classes of two or more."""
    keyed = sets.select("id", *(c.alias(f"__s{k}") for k, c in enumerate(same)))
    keys = keyed.columns[1:]
    groups = keyed.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    members = settled(keyed.join(groups, keys).select("id", "rep", "c"), "members")
    return sets.join(members.where("id <> rep").select("id"), "id", "left_anti"), members


def of_members(pairs: DataFrame, members: DataFrame, equal: DataFrame | None = None) -> DataFrame:
    """a, b (a < b) and what else pairs have, of all sets, from pairs of representatives; `equal`: rep and what else pairs of its class have."""
    rest = pairs.columns[2:]
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / LISTED)).alias("part")
    lists = settled(members.groupBy("rep", part).agg(F.collect_list("id").alias("ids")), "lists")
    side = lambda c, s: lists.select(F.col("rep").alias(c), F.col("ids").alias(s))
    # Pairs are made of the lists at the very end, and only written.
    met = pairs.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    met = met.select(F.explode(F.coalesce("x", F.array("a"))).alias("a"), F.coalesce("y", F.array("b")).alias("y"), *rest).select("a", F.explode("y").alias("b"), *rest)
    inside = lists.select("rep", F.col("part").alias("i"), F.col("ids").alias("x")).join(lists.select("rep", F.col("part").alias("j"), F.col("ids").alias("y")), "rep").where("i <= j")
    # The pairs of lists of a large class are dealt to all tasks, however few bytes they are.
    inside = (inside.join(equal, "rep") if rest else inside).repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep", "i", "j")
    inside = inside.select("i", "j", F.explode("x").alias("a"), "y", *rest).select("i", "j", "a", F.explode("y").alias("b"), *rest).where("i < j or a < b")
    return met.unionByName(inside.select("a", "b", *rest)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)


def with_counts(lists: DataFrame, written: bool) -> DataFrame:
    """id, n, element, df of the elements of lists that more than one set has; df: so many sets. Only lists that are written down are read twice."""
    each = lists.select("id", "n", F.explode("s").alias("element"))
    if not written or each.agg(F.approx_count_distinct("element")).first()[0] > COUNTED:
        return each.withColumn("df", F.count("*").over(Window.partitionBy("element"))).where("df > 1")
    counts = settled(each.groupBy("element").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    return each.join(F.broadcast(counts), "element").select("id", "n", "element", "df")


def overlaps(lists: DataFrame, prefix: Callable[[Column], Column], need: Callable[[Column, Column], Column], bits: int = 64 * WORDS) -> DataFrame:
    """a, b (a < b), total, common: pairs of sets (id, s) of n and m elements, total in sum, that share need(n, m) elements or more; exact.

    Two such sets must share one of their prefix(n) rarest elements. Equal sets count
    as one until the end. With at most `bits` elements in all, bitmaps of the sets tell
    everything, so all pairs are compared in blocks; else only sets that share an
    element of their prefixes, and only those are verified that positions and bitmaps
    leave possible.
    """
    lists = lists.select("id", "s", F.size("s").cast("long").alias("n")).where((F.col("n") > 0) & (prefix(F.col("n")) > 0))
    if bits:
        lists = settled(lists, "lists")
        known = [r[0] for r in lists.select(F.explode("s")).distinct().limit(bits + 1).collect()]
        if len(known) <= bits:
            return by_bitmaps(lists, known, need)
    # Whole groups come to a task before they are made: halves of groups would be shuffled as arrays. Slots are made there, too: no codec shortens them.
    each = with_counts(lists, bits > 0).repartition("id").withColumn("__slot", F.xxhash64("element"))
    sets = each.groupBy("id").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("df", "element"))), lambda x: x["element"]).alias("s"), *bitmap())
    # Elements of no other set are the rarest: they come first, and aren't kept.
    sets = sets.withColumn("m", F.size("s").cast("long")).where(F.col("n") - F.col("m") < prefix(F.col("n")))
    sets = settled(sets, "ranked")
    alone = F.when(F.col("n") > F.col("m"), F.col("id"))
    reps, members = classes(sets, F.coalesce(alone.cast("string"), F.lit("")), F.col("n"), F.xxhash64("s"), F.xxhash64(F.reverse("s")))
    reps = settled(reps, "representatives")
    rows = reps.select("id", "n", "m", *MAPS, F.posexplode(F.slice("s", F.lit(1), F.greatest(prefix(F.col("n")) - F.col("n") + F.col("m"), F.lit(0)).cast("int"))).alias("at", "element"))
    rows = rows.withColumn("at", F.col("n") - F.col("m") + F.col("at") + 1)
    least = need(F.col("x.n"), F.col("y.n"))
    first = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    met = meetings(rows, "element").where((least <= first) & (least <= F.least("x.m", "y.m")))
    met = met.where((F.col("x.m") - without("x", "y") >= least) & (F.col("y.m") - without("y", "x") >= least))
    pairs = settled(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    side = lambda c, s: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(s))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    found = both.where(F.col("common") >= need(F.col("na"), F.col("nb"))).select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "common")
    return of_members(found, members, of_equal(reps))


def of_equal(reps: DataFrame) -> DataFrame:
    return reps.select(F.col("id").alias("rep"), (2 * F.col("n")).alias("total"), F.col("n").alias("common"))


def by_bitmaps(lists: DataFrame, known: list, need: Callable[[Column, Column], Column]) -> DataFrame:
    """The same for sets over few elements, by the bits they have in common."""
    kind = dict(lists.select(F.explode("s").alias("element")).dtypes)["element"]
    slots = lists.sparkSession.createDataFrame([(e, k) for k, e in enumerate(known)], f"element {kind}, __slot long")
    each = lists.select("id", "n", F.explode("s").alias("element")).join(F.broadcast(slots), "element")
    sets = settled(each.groupBy("id").agg(F.first("n").alias("n"), *bitmap()), "bitmaps")
    reps, members = classes(sets, *map(F.col, MAPS))
    reps = settled(reps, "representatives")
    x, y = in_blocks(reps, F.ceil(F.lit(reps.count() / BLOCK)))
    common = reduce(add, (F.bit_count(F.col(f"x.{m}").bitwiseAND(F.col(f"y.{m}"))) for m in MAPS)).cast("long")
    met = x.join(y, ["__i", "__j"]).where(MET).where((common >= need(F.col("x.n"), F.col("y.n"))))
    found = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total"), common.alias("common"))
    return of_members(found, members, of_equal(reps))


def jaccard_pairs(sets: DataFrame, threshold: float = 0.5, bits: int = 64 * WORDS) -> DataFrame:
    """a, b, sim of all pairs of sets (id, element) with Jaccard similarity `threshold` or more; exact."""
    return similar_lists(as_lists(sets), threshold, bits)


def similar_lists(lists: DataFrame, threshold: float, bits: int = 64 * WORDS) -> DataFrame:
    """The same of sets as lists (id, s) of different elements."""
    prefix = lambda n: n - F.ceil(threshold * n - 1e-9) + 1
    need = lambda n, m: F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    pairs = overlaps(lists, prefix, need, bits)
    return pairs.select("a", "b", (F.col("common") / (F.col("total") - F.col("common"))).alias("sim")).where(F.col("sim") >= threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, sim of those candidate pairs that are similar."""
    whole = sets.groupBy("id").agg(F.collect_set(F.xxhash64("element")).alias("s"))
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("sim")).where(F.col("sim") >= threshold)


def minhash(indexed: DataFrame, m: int, n_hashes: int = 20, start: int = 1, plus: int = 501) -> DataFrame:
    """id, h0.. of sets (id, ix): least (j ix + plus) mod m for j from `start`; numbers, not half-made signatures, are shuffled."""
    return indexed.repartition("id").groupBy("id").agg(*(F.min((F.col("ix") * (start + k) + plus) % m).alias(f"h{k}") for k in range(n_hashes)))


def lsh_pairs(signatures: DataFrame, bands: int = 10, rows: int = 2) -> DataFrame:
    """a, b: pairs of ids that agree in a band. Equal signatures meet as one.

    A pair comes from its first band only: rows take what they have in the bands before along, so no pair is shuffled to be told from its like.
    """
    names = [f"h{k}" for k in range(bands * rows)]
    reps, members = classes(settled(signatures.select("id", *names), "signatures"), *map(F.col, names))
    banded = reps.select("id", F.array(*names).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    banded = banded.select("id", "band", F.slice("h", F.col("band") * rows + 1, rows).alias("key"), F.slice("h", F.lit(1), F.col("band") * rows).alias("before"))
    at = lambda s, k, r: F.get(F.col(f"{s}.before"), k * rows + r)
    same = [F.coalesce(reduce(Column.__and__, (at("x", k, r) == at("y", k, r) for r in range(rows))), F.lit(False)) for k in range(bands - 1)]
    met = meetings(banded, "band", "key").where(~reduce(Column.__or__, same, F.lit(False)))
    return of_members(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), members)


def agreeing(pairs: DataFrame, signatures: DataFrame, bands: int = 10, rows: int = 2) -> DataFrame:
    """Those pairs (a, b) whose signatures agree in a band."""
    side = lambda c, s: signatures.select(F.col("id").alias(c), F.array(*(f"h{k}" for k in range(bands * rows))).alias(s))
    same = [reduce(Column.__and__, (F.col("x")[k * rows + r] == F.col("y")[k * rows + r] for r in range(rows))) for k in range(bands)]
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(reduce(Column.__or__, same)).select(*pairs.columns)
