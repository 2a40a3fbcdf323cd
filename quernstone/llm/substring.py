"""Substring duplicates by MinHash banding of paragraphs, with exact passages beside it.

Paragraphs are lines. Those of `min_banded` words or more get MinHash signatures of
their `shingle`-word runs; `bands` of `rows` values, chosen for recall at the
threshold, make them collide, exact Jaccard similarity of the whole sets
verifies, and components of verified pairs are classes. The line with the least
(doc_id, text, position) of a class stays; the others are repeats. `common.linked`
loses no verified pair of a bucket, however many lines meet there.

Passages that are copied into other surroundings are found by pieces: the words of
a text are cut where the hash of a word pair is the least within `radius` words to
either side, so a passage is cut alike wherever it stands. Pieces that occur
again, but for the first, form runs. A run ends within a piece; so the words
before and after it are compared with those of the occurrence that its end pieces repeat,
as far as they agree. Lines and runs that meet or overlap are one span; spans of
`min_words` words or more are repeated passages.

Lower-cased words between ASCII separators are compared. Nulls, empty texts and
texts without words have no passages. Repeated rows of a doc_id and a text are one
document; rows of one doc_id with several texts are judged apart. Null ids come
last. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hashes, linked, materialize, prefixes, remix, rolled, signed, similar_sets, table, tokens, unused

SEPARATORS = " \t\n\x0b\x0c\r"
#: Meetings in a bucket beyond which paragraphs meet by their rarest shingles instead.
DENSE = 64
NO_ID = (1 << 63) - 1


def tune(threshold: float, recall: float = 0.99, most: int = 24) -> tuple[int, int]:
    """bands and rows with the recall at the threshold: most rows that need at most `most` values."""
    best = (1, 1)
    for rows in range(1, 7):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def cuts(h: np.ndarray, radius: int) -> np.ndarray:
    """Starts of the pieces of a text's word hashes."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    pair = remix(np.concatenate([rolled(h, 2), h[-1:]])) if n > 1 else h
    padded = np.concatenate([np.full(radius, np.uint64(2**64 - 1)), pair, np.full(radius, np.uint64(2**64 - 1))])
    least = padded[: n].copy()
    for k in range(1, 2 * radius + 1):
        np.minimum(least, padded[k : k + n], out=least)
    at = np.flatnonzero(least == pair)
    return at if len(at) and at[0] == 0 else np.append(0, at)


def split_lines(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and their number in each line that has some."""
    if not text:
        return [], np.zeros(0, np.int64)
    lines = [t for t in (tokens(x) for x in text.split("\n")) if t]
    return [w for t in lines for w in t], np.array([*map(len, lines)], np.int64)


def digests(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of the words of each piece, in order; together the pieces are the text."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    place = (np.arange(len(h)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = remix(h ^ remix(place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)))
    return remix(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))


def band_keys(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shingle: int, mult: np.ndarray, plus: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """lines x bands: hashes of the least values of each line's shingles. Lines have `shingle` words or more."""
    g = rolled(h, shingle)
    edges = np.stack([starts, starts + sizes - shingle + 1], 1).ravel()
    edges[-1] = min(edges[-1], len(g))
    key = np.zeros((bands, len(starts)), np.uint64)
    for v in range(bands * rows):
        x = (g * mult[v] + plus[v]) >> np.uint64(13)
        x = np.append(x, np.uint64(2**64 - 1))
        low = np.minimum.reduceat(x, edges)[::2]
        key[v // rows] = remix(key[v // rows] ^ (low + np.uint64(v // rows + 1)))
    return key.T


def units(docs: DataFrame, radius: int, shingle: int, min_banded: int, bands: int, rows: int) -> DataFrame:
    """doc_id, sig, first, words, before, after, para, keys: a row for each piece (with the words of its neighbours) and each long line (with band hashes)."""
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 62, bands * rows, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    plus = rng.integers(1, 1 << 62, bands * rows, dtype=np.int64).astype(np.uint64)

    def of(text: str | None) -> tuple:
        words, lines = split_lines(text)
        h = hashes(words)
        s = cuts(h, radius)
        m = np.diff(np.append(s, len(h)))
        ends = np.cumsum(lines)
        long = lines >= max(min_banded, shingle)
        ls, lm = (ends - lines)[long], lines[long]
        keys = band_keys(h, ls, lm, shingle, mult, plus, bands, rows) if len(ls) else np.zeros((0, bands), np.uint64)
        n = len(s) + len(ls)
        around = np.zeros((2, n), np.int32)
        around[0, 1 : len(s)], around[1, : max(0, len(s) - 1)] = m[:-1], m[1:]
        line_para = remix(digests(h, ends - lines, lines))[long]
        return np.append(s, ls), np.append(m, lm), around[0], around[1], np.append(digests(h, s, m), line_para), np.append(np.zeros(len(s), bool), np.ones(len(ls), bool)), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "sig"))
            parts: list = []
            size, start = 0, 0
            for k, t in enumerate(batch.column("text")):
                parts.append(of(t.as_py()))
                size += len(parts[-1][0])
                if size >= 200_000:
                    yield block(ids[start : k + 1], sigs[start : k + 1], parts)
                    parts, size, start = [], 0, k + 1
            if parts:
                yield block(ids[start:], sigs[start:], parts)

    def block(ids: np.ndarray, sigs: np.ndarray, parts: list) -> pa.RecordBatch:
        each = [len(x[0]) for x in parts]
        s, m, before, after, para, long, keys = (np.concatenate([x[k] for x in parts]) for k in range(7))
        ends = pa.array(np.append(0, np.cumsum(long * bands)).astype(np.int32), mask=np.append(~long, False))
        lists = pa.ListArray.from_arrays(ends, pa.array(signed(np.ascontiguousarray(keys).ravel())))
        flat = [pa.array(np.repeat(ids, each)), pa.array(np.repeat(sigs, each)), *(pa.array(x.astype(np.int32)) for x in (s, m, before, after)), pa.array(signed(para))]
        return pa.RecordBatch.from_arrays([*flat, lists], NAMES)

    return identified(docs).mapInArrow(run, "doc_id long, sig long, first int, words int, before int, after int, para long, keys array<long>")


NAMES = ["doc_id", "sig", "first", "words", "before", "after", "para", "keys"]


def text_sig() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (the largest long for null), sig of the text, and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_sig().alias("sig"), F.col("text").cast("string").alias("text"))


def looked_up(docs: DataFrame, wanted: DataFrame, of, schema: str) -> DataFrame:
    """What `of` (doc_id, sig, words, places) makes of each document with rows in wanted (doc_id, sig and others); the places of a document are no more than its words."""
    others = [c for c in wanted.columns if c not in ("doc_id", "sig")]
    places = wanted.groupBy("doc_id", "sig").agg(F.collect_set(F.struct(*others)).alias("places"))
    rows = identified(docs).join(places, ["doc_id", "sig"])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, s, t, p in zip(batch.column("doc_id").to_pylist(), batch.column("sig").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                found = of(d, s, tokens(t.as_py()), p.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    return rows.mapInArrow(run, schema)


def similar(firsts: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """id, component of lines (para) with a similar one. firsts, written down: para, keys, words and keep, where each line stands first."""
    banded = firsts.select("para", F.explode("keys").alias("key"))
    # A window would gather a hot bucket; counts are summed in part first.
    full = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(banded.join(full, "key", "left_semi").select("key", F.col("para").alias("id"), F.lit(True).alias("own")), "buckets")
    wanted = firsts.join(met.select(F.col("id").alias("para")).distinct(), "para", "left_semi")

    def sets(d: int, s: int, words: list[bytes], places: list) -> list:
        runs = (rolled(hashes(words[p["first"] : p["first"] + p["words"]]), shingle) for p in places)
        return [(p["para"], np.unique((g >> np.uint64(32)).astype(np.uint32).view(np.int32))) for p, g in zip(places, runs, strict=True)]

    of = looked_up(docs, wanted.select("keep.doc_id", "keep.sig", "keep.first", "words", "para"), sets, "id long, elements array<int>")
    elements = materialize(of.groupBy("id").agg(F.min("elements").alias("elements")), "shingles")
    split = lambda ids: prefixes(elements.join(ids, "id", "left_semi"), threshold)
    out = linked(met, lambda pairs: similar_sets(pairs, elements, threshold), None, split, DENSE)
    discard(met, elements)
    return out


def common_length(a: str, b: str) -> Column:
    """How many first elements of two arrays agree."""
    odd = F.array_position(F.zip_with(a, b, lambda x, y: x == y), F.lit(False))
    shorter = F.least(F.size(a), F.size(b))
    return F.coalesce(F.when(odd > 0, odd - 1).otherwise(shorter), F.lit(0)).cast("int")


def exact_runs(found: DataFrame, docs: DataFrame, min_words: int, radius: int) -> DataFrame:
    """doc_id, sig, first, words: runs of repeated pieces, to their true edges. found: as of `units`, written down."""
    pieces = found.where("keys is null").drop("keys")
    place = F.struct("doc_id", "sig", "first")
    keep = materialize(pieces.groupBy("para").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").select("para", "keep"), "repeated")
    marked = pieces.join(keep, "para").where(place != F.col("keep"))
    # A text's pieces are within one row of docs.
    order = Window.partitionBy("doc_id", "sig").orderBy("first")
    edge = F.when(F.lag(F.col("first") + F.col("words")).over(order) >= F.col("first"), 0).otherwise(1)
    runs = marked.withColumn("edge", edge).withColumn("run", F.sum("edge").over(order)).groupBy("doc_id", "sig", "run").agg(
        F.min("first").alias("first"),
        F.max(F.col("first") + F.col("words")).alias("end"),
        F.min_by(F.struct("keep", "before"), "first").alias("head"),
        F.max_by(F.struct("keep", "words", "after"), "first").alias("tail"),
    )
    reach = radius + 2
    # Beyond the pieces beside it, cuts hide a few more words of the passage at most.
    able = runs.where(F.col("end") - F.col("first") + F.col("head.before") + F.col("tail.after") + 2 * reach >= min_words)
    tail_end = F.col("tail.keep.first") + F.col("tail.words")
    named = [F.col(f"head.keep.{c}").alias(f"head_{c}") for c in ("doc_id", "sig", "first")] + [F.col("tail.keep.doc_id").alias("tail_doc_id"), F.col("tail.keep.sig").alias("tail_sig"), (F.col("tail.keep.first") + F.col("tail.words")).alias("tail_end")]
    able = materialize(able.select("doc_id", "sig", "first", "end", *named, (F.col("head.before") + reach).alias("left_reach"), (F.col("tail.after") + reach).alias("right_reach")), "runs")
    ends = [("doc_id", "sig", "first"), ("doc_id", "sig", "end"), ("head_doc_id", "head_sig", "head_first"), ("tail_doc_id", "tail_sig", "tail_end")]
    none = F.lit(0).alias("none")
    asked = reduce(DataFrame.unionByName, (able.select(*(F.col(c).alias(n) for c, n in zip(e, ("doc_id", "sig", "at"), strict=True)), (none if k % 2 else F.col("left_reach")).alias("back"), (F.col("right_reach") if k % 2 else none).alias("on")) for k, e in enumerate(ends)))
    asked = asked.groupBy("doc_id", "sig", "at").agg(F.max("back").alias("back"), F.max("on").alias("on"))

    def around(d: int, s: int, words: list[bytes], places: list) -> list:
        low = lambda w: (hashes(w) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return [(d, s, p["at"], low(words[max(0, p["at"] - p["back"]) : p["at"]][::-1]), low(words[p["at"] : p["at"] + p["on"]])) for p in places]

    near = materialize(looked_up(docs, asked, around, "doc_id long, sig long, at int, left array<int>, right array<int>").groupBy("doc_id", "sig", "at").agg(F.min("left").alias("left"), F.min("right").alias("right")), "edges")
    side = lambda e, c, name: near.select(*(F.col(n).alias(x) for x, n in zip(e, ("doc_id", "sig", "at"), strict=True)), F.col(c).alias(name))
    out = able
    for e, c, name in zip(ends, ("left", "right", "left", "right"), ("l", "r", "kl", "kr"), strict=True):
        out = out.join(side(e, c, name), list(e), "left")
    before, after = common_length("l", "kl"), common_length("r", "kr")
    return out.select("doc_id", "sig", (F.col("first") - before).alias("first"), (F.col("end") + after - F.col("first") + before).alias("words"))


def repeats(docs: DataFrame, min_words: int = 50, radius: int = 4, shingle: int = 5, min_banded: int = 24, threshold: float = 0.8) -> DataFrame:
    """doc_id, sig, first, words: the repeated passages, in words of the text whose `text_sig` is sig.

    doc_id is the largest long for null ids.
    """
    found = materialize(units(docs, radius, shingle, min_banded, *tune(threshold)), "paragraphs")
    exact = exact_runs(found, docs, min_words, radius)
    lines = found.where("keys is not null")
    place = F.struct("doc_id", "sig", "first")
    firsts = materialize(lines.groupBy("para").agg(F.min_by(F.struct(place.alias("keep"), "words", "keys"), place).alias("f"), F.count("*").alias("n")).select("para", "f.*", "n"), "lines")
    of = similar(firsts, docs, shingle, threshold).withColumnRenamed("id", "para")
    classes = firsts.drop("keys").join(of, "para", "left").where("component is not null or n > 1").withColumn("component", F.coalesce("component", "para"))
    best = materialize(classes.groupBy("component").agg(F.min("keep").alias("keep")), "classes")
    keep = materialize(classes.select("para", "component").join(best, "component").select("para", "keep"), "kept-lines")
    again = lines.join(keep, "para").where(place != F.col("keep")).select("doc_id", "sig", "first", "words")
    spans = exact.unionByName(again)
    order = Window.partitionBy("doc_id", "sig").orderBy("first", "words")
    reached = F.max(F.col("first") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("edge", F.when(reached >= F.col("first"), 0).otherwise(1)).withColumn("span", F.sum("edge").over(order))
    spans = spans.groupBy("doc_id", "sig", "span").agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("words"))
    return spans.where(F.col("words") >= min_words).select("doc_id", "sig", "first", "words")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; lines left blank by that go, other spacing stays."""
    gone, at, out = sorted(spans), 0, []
    for line in text.split("\n"):
        parts, pos, touched = [], 0, False
        for w in words_with_ends(line):
            while gone and gone[0][0] + gone[0][1] <= at:
                gone.pop(0)
            if gone and gone[0][0] <= at:
                touched = True
            else:
                parts.append(line[pos : w])
            pos = w
            at += 1
        parts.append(line[pos:])
        new = "".join(parts)
        if not touched or new.strip(SEPARATORS):
            out.append(new)
    return "\n".join(out)


def words_with_ends(line: str) -> Iterator[int]:
    """End of each word in the line."""
    inside = False
    for i, c in enumerate(line):
        if c in SEPARATORS:
            if inside:
                yield i
            inside = False
        else:
            inside = True
    if inside:
        yield len(line)


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from `text`; texts without words afterwards are dropped, others keep their row.

    Only rows with spans go through Python. `n_chars`, where there is one, follows the text.
    """
    doc, sig, cut = unused(docs, "doc", "sig", "cut")
    by = spans.groupBy(F.col("doc_id").alias(doc), F.col("sig").alias(sig)).agg(F.collect_list(F.struct("first", "words")).alias(cut))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    joined = docs.join(by, (key == F.col(doc)) & (text_sig() == F.col(sig)), "left").drop(doc, sig)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut_text(t.as_py(), [(x["first"], x["words"]) for x in s.as_py()]) for t, s in zip(batch.column("text"), batch.column(cut), strict=True)]
            cols = [pa.array(new, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    changed = joined.where(F.col(cut).isNotNull()).mapInArrow(run, schema).where(F.btrim("text", F.lit(SEPARATORS)) != "")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return joined.where(F.col(cut).isNull()).drop(cut).unionByName(changed)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeats(table(spark, sf_dir, "documents"))
    by = spans.groupBy("doc_id", "sig").agg(F.count("*").alias("n_runs"), F.sum("words").cast("long").alias("repeated_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "words"))), lambda x: F.concat_ws("+", x["first"], x["words"])), ",").alias("runs"))
    return by.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_runs", "repeated_words", "runs")


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
