r"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become template words: a few replacements over the whole text turn names
(capitalised words, those that open a sentence included), numbers and units after numbers into typed
placeholders, then drop punctuation and case. Hashes of all runs of `window`
template words of the documents meet those of the benchmark in a hash join. The
benchmark is also asked for in lower case, where names are words like others. A
window with under `literals` words that aren't placeholders says little as a
template; it is compared with its values, so only copies match it.

Matches of one item at shifts (place of the item's first word) that lie at most `slack` apart are one passage, so an
inserted word doesn't split it. A passage covers an item if its windows hold `coverage` of
the item's words. Its slots must then be consistent: within the passage each
value of the item's placeholders has one value in the document, and the other
way round. So re-parameterised questions count, and texts that merely share a form
do not. Items of fewer words than a window are one window of their own length;
of fewer than 3 words they can't be told from chance and match nothing.

Windows are hashed and looked up as the words are exploded, so only hits leave a
task. The benchmark's windows are broadcast only if a count of their words is at most
`broadcast_words`; else both sides are shuffled.

Nulls and empty texts hold no passages; repeated rows of a doc_id are one
document; rows with a null id are told apart by a hash of their text. Null item_ids match nothing. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, table, unused

UNITS = "mm cm m km in ft yd mile miles mg g kg t lb oz ml l s sec min h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent °c °f kb mb gb tb hz khz mhz ghz w kw v mph"
SLOT = "\x01"
HEAD = 3
NAMES = r"(?<![\p{L}\p{N}'’-])\p{Lu}(?=\p{Ll})[\p{L}'’-]*"
NUMBERS = r"\d[\d.,:/]*"
PUNCTUATION = r"[.,;:!?\"'()\[\]{}|*<>_\-«»“”‘’…¿¡#$%&€£]+"
BLANK = " \t\n\x0b\x0c\r"


def marked_words(text: Column) -> Column:
    """Words without punctuation and case; names, numbers and units have a mark before them."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NAMES, SLOT + "p$0")
    t = F.regexp_replace(t, NUMBERS, SLOT + "n$0")
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    t = F.regexp_replace(t, rf"({SLOT}n[\d.,:/]*[)\"']*\s?)((?i:{units}))(?![\p{{L}}\d{SLOT}])", f"$1{SLOT}u$2")
    # A blank text gives one empty word.
    return F.split(F.btrim(F.lower(F.regexp_replace(t, PUNCTUATION, "")), F.lit(BLANK)), SPACE)


def template(word: Column) -> Column:
    """The template word of a marked word: its placeholders without their values."""
    return F.when(word.contains(SLOT), F.regexp_replace(word, f"({SLOT}.)[^{SLOT}]*", "$1")).otherwise(word)


def windows(df: DataFrame, keep: list[str], shortest: int) -> DataFrame:
    """keep, marked and pos: every place of a run of `shortest` words or more."""
    rows = df.select(*keep, marked_words(F.col("text")).alias("marked"))
    each = rows.select(*keep, "marked", F.posexplode_outer("marked").alias("pos", "word"))  # outer: else a filter on the size splits every text twice
    return each.where((F.col("pos") <= F.size("marked") - shortest) & (F.col("word") != "")).drop("word")


def words_at(width: int) -> Column:
    return F.slice("marked", F.col("pos") + 1, width)


def head() -> Column:
    """Hash of the first template words."""
    return F.xxhash64(*(template(F.get("marked", F.col("pos") + k)) for k in range(HEAD)))


def hash_of(words: Column, width: int, literals: int) -> Column:
    """Of `width` marked words as a template; with their values if under `literals` of them are literal."""
    each = [F.get(words, F.lit(k)) for k in range(width)]
    few = F.size(F.filter(words, lambda t: ~t.contains(SLOT))) < min(literals, width)
    return F.when(few, F.xxhash64(F.lit("values"), *each)).otherwise(F.xxhash64(*map(template, each)))


def benchmark_windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """item_id, size (the item's words), width, at, head, hash, asked (the window's marked words); items as they stand and in lower case."""
    both = benchmark.unionByName(benchmark.withColumn("text", F.lower("text")))
    each = windows(both.select("item_id", F.col("text").cast("string").alias("text")), ["item_id"], HEAD).withColumn("size", F.size("marked"))
    # A short item is one window.
    each = each.withColumn("width", F.least("size", F.lit(window))).where((F.col("pos") <= F.col("size") - F.col("width")))
    asked = F.slice("marked", F.col("pos") + 1, F.col("width"))
    hashed = reduce(lambda c, k: F.when(F.col("width") == k, hash_of(F.col("asked"), k, literals)).otherwise(c), range(HEAD, window), hash_of(F.col("asked"), window, literals))
    out = each.select("item_id", "size", "width", F.col("pos").alias("at"), head().alias("head"), asked.alias("asked")).withColumn("hash", hashed)
    return materialize(out.dropDuplicates(["item_id", "at", "hash", "asked"]), "bench-windows")


def identity() -> list[Column]:
    """doc_id, and for a null id a hash of the text."""
    return [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).alias("nameless")]


def matches(docs: DataFrame, benchmark: DataFrame, window: int, literals: int, broadcast_words: int) -> DataFrame:
    """doc_id, nameless, item_id, size, width, at, pos, asked, said: windows of the documents that are ones of the benchmark."""
    wanted = benchmark_windows(benchmark.where("item_id is not null"), window, literals)
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # at most `window` numbers
    words = wanted.agg(F.sum("width")).first()[0] or 0
    each = windows(docs.select(*identity(), "text"), ["doc_id", "nameless"], min(widths, default=window))
    if words <= broadcast_words:
        # Few windows start with the first words of one of the benchmark's; only those are hashed whole.
        each = each.withColumn("head", head()).join(F.broadcast(wanted.select("head").distinct()), "head", "left_semi")
    found = []
    for width in widths or [window]:
        here = each.where(F.col("pos") <= F.size("marked") - width).select("doc_id", "nameless", "pos", words_at(width).alias("said"))
        here = here.withColumn("hash", hash_of(F.col("said"), width, literals))
        these = wanted.where(F.col("width") == width).drop("head")
        found.append(here.join(F.broadcast(these) if words <= broadcast_words else these, "hash").select("doc_id", "nameless", "item_id", "size", "width", "at", "pos", "asked", "said"))
    return reduce(DataFrame.unionByName, found)


def passages(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, literals: int = 4, slack: int = 3, broadcast_words: int = 4_000_000) -> DataFrame:
    """doc_id, nameless, item_id, shift (place of the item's first word), covered, size (words): covered items with consistent slots."""
    met = matches(docs, benchmark, window, literals, broadcast_words)
    by = ["doc_id", "nameless", "item_id", "size"]
    slots = F.filter(F.arrays_zip("asked", "said"), lambda x: x["asked"].contains(SLOT) | x["said"].contains(SLOT))
    met = met.select(*by, (F.col("pos") - F.col("at")).alias("shift"), F.sequence("at", F.col("at") + F.col("width") - 1).alias("held"), slots.alias("slots"))
    shifts = met.groupBy(*by, "shift").agg(F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # The shifts of an item within one document.
    order = Window.partitionBy(*by).orderBy("shift")
    edge = F.when(F.col("shift") - F.lag("shift").over(order) <= slack, 0).otherwise(1)
    near = shifts.withColumn("edge", edge).withColumn("passage", F.sum("edge").over(order))
    runs = near.groupBy(*by, "passage").agg(
        F.min("shift").alias("shift"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).cast("long").alias("covered"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )
    side = lambda name: F.size(F.array_distinct(F.transform("slots", lambda x: x[name])))
    consistent = (F.size("slots") == side("asked")) & (F.size("slots") == side("said"))
    whole = runs.where((F.col("covered") >= coverage * F.col("size")) & consistent)
    return whole.select("doc_id", "nameless", "item_id", "shift", "covered", "size")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a passage of the benchmark."""
    i, n = unused(docs, "hit_id", "hit_text")
    hit = passages(docs, benchmark, **options).select(F.col("doc_id").alias(i), F.col("nameless").alias(n)).distinct()
    kept = docs.join(hit.where(F.col(i).isNotNull()).select(i), F.col("doc_id") == F.col(i), "left_anti")
    bare = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    return kept.join(hit.where(F.col(i).isNull()).select(n), bare == F.col(n), "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("nameless")


QUERIES = {"op6_decontaminate": op6_decontaminate}
