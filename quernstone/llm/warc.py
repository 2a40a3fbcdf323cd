r"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: records are rows of Spark's text writer, whose separator supplies the
two empty lines after a record; its commit protocol survives lost executors.
Records with equal payloads of at least `min_bytes` bytes refer to the one with
the largest id.

Reading: tasks scan files for the magic `WARC/1.` anywhere, so a magic inside a
payload gives a false candidate. Each candidate states where its successor
starts (its offset, its header and its Content-Length). Candidates that lead to
the very next one form runs; runs form a graph with one exit each, and pointer
jumping from each file's start, doubling its reach in every round, keeps what
can be reached. Records that end past the file are dropped, as is all that
follows a broken link. A payload with a magic inside spans several pieces and is
put together again from the pieces between the ends of its record.

Nulls: a null html is an empty payload, a null url an empty target; a null
page_id is written as an empty id, which never counts as the largest, and read
back as null. A gzip file is one member, as Spark's writer makes it. Rows that repeat a page_id are records of their own; of equal
payloads with the same largest id one is the response. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import if_small, materialize, new_path, table

MAGIC = "WARC/1."
GAP = "\r\n\r\n"


#: Shares that the rows of a digest with more than HOT copies are dealt to, where payloads must be shuffled.
SHARES, HOT = 64, 1000


def with_revisits(records: DataFrame, min_bytes: int = 1000, broadcast_digests: int = 200_000) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to to id, uri, payload (binary).

    Of equal payloads, the row with the largest id is the response; should several
    rows have that id, the one with the least row number is. Only digests that
    occur again are joined: by a broadcast if they are few, else payloads are dealt by
    digest, those of hot digests by digest and share; so no payload goes to one task
    with all its copies, and small payloads stay where they are.
    """
    known = records.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = known.where(F.col("payload_bytes") >= min_bytes)
    ids = large.select("payload_digest", F.coalesce("id", F.lit(-(1 << 63))).alias("id"))
    last = ids.groupBy("payload_digest").agg(F.max("id").alias("last_id"), F.count("*").alias("n")).where("n > 1")
    last = materialize(last, "repeated-digests")
    tied = ids.join(if_small(last, broadcast_digests), "payload_digest").where("id = last_id").groupBy("payload_digest").agg(F.count("*").alias("t")).where("t > 1")
    row = F.lit(None).cast("long")
    if not tied.isEmpty():
        # Row numbers tell equal ids apart; written down, as a rerun may number otherwise.
        known = materialize(known.withColumn("row", F.monotonically_increasing_id()), "numbered")
        large, row = known.where(F.col("payload_bytes") >= min_bytes), F.col("row")
        mine = large.select("payload_digest", F.coalesce("id", F.lit(-(1 << 63))).alias("last_id"), "row").join(if_small(last, broadcast_digests), ["payload_digest", "last_id"])
        last = materialize(last.join(mine.groupBy("payload_digest").agg(F.min("row").alias("last_row")), "payload_digest"), "repeated-digests")
    else:
        last = last.withColumn("last_row", F.lit(None).cast("long"))
    known = known.withColumn("row", row) if "row" not in known.columns else known
    n = last.count()
    if n <= broadcast_digests:
        out = known.join(F.broadcast(last.drop("n")), (known["payload_digest"] == last["payload_digest"]) & (F.col("payload_bytes") >= min_bytes), "left").drop(last["payload_digest"])
    else:
        hot = last.where(F.col("n") > HOT).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        sides = hot.unionByName(last.where(F.col("n") <= HOT).withColumn("share", F.lit(-1))).drop("n")
        # At most 1 / HOT of all rows are hot digests; the dealing of a row must know them.
        marked = known.where(F.col("payload_bytes") >= min_bytes).join(if_small(last.where(F.col("n") > HOT).select("payload_digest", F.lit(True).alias("hot"))), "payload_digest", "left")
        dealt = marked.withColumn("share", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "uri"), F.lit(SHARES)).cast("int")).otherwise(-1)).drop("hot")
        joined = dealt.join(sides, ["payload_digest", "share"], "left").drop("share")
        small = known.where(~(F.col("payload_bytes") >= min_bytes) | F.col("payload_bytes").isNull())
        out = joined.unionByName(small.withColumns({"last_id": F.lit(None).cast("long"), "last_row": F.lit(None).cast("long")}))
    response = F.col("last_id").isNull() | ((F.coalesce("id", F.lit(-(1 << 63))) == F.col("last_id")) & (F.col("last_row").isNull() | (F.col("row") == F.col("last_row"))))
    refers = F.when(~response, F.when(F.col("last_id") != -(1 << 63), F.col("last_id")))
    return out.withColumn("record_type", F.when(response, "response").otherwise("revisit")).withColumn("refers_to", refers).drop("last_id", "last_row", "row")


def record_text(date: str) -> Column:
    """The record up to its closing empty lines. Payloads are UTF-8 here, as the text writer needs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    # A magic in a header would cut it in two; as an escape it is the same target.
    one_line = F.replace(F.regexp_replace(text("uri"), r"[\r\n]+", " "), F.lit(MAGIC), F.lit("WARC%2F1."))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text("id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", one_line),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text("refers_to"), F.lit(">")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, line("X-Revisit-Payload-Length", text("payload_bytes"))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")),
    )


def write(records: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Archives of id (long), uri and payload (binary, UTF-8) below `path`."""
    ready = with_revisits(records, min_bytes).select(record_text(date).alias("value"))
    ready.write.option("lineSep", GAP).option("compression", compression).text(path)


# --- reading ---------------------------------------------------------------------


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic: file, block (start of the split), seq (order in it), body, size with the magic.

    The first piece of a file is what stands before its first magic.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("body"),
    )
    return lines.withColumn("size", F.octet_length("body").cast("long") + len(MAGIC))


def located(found: DataFrame) -> DataFrame:
    """Adds `offset`, where the piece's magic starts, and `end`; the first piece of a file has offset -7.

    Sizes add up within a split, and the splits of a file add up.
    """
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    start = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) - len(MAGIC)
    return found.join(starts, ["file", "block"]).withColumn("offset", start).withColumn("end", F.col("offset") + F.col("size")).drop("start")


def parsed(found: DataFrame) -> DataFrame:
    """Header fields and the bytes that the record states, for pieces that start like a record."""
    as_text = F.col("body").cast("string")
    head = F.col("head")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}: *([^\r]*)\r", 1), F.lit(""))
    opens = (as_text.startswith("0\r\n") | as_text.startswith("1\r\n")) & as_text.contains(GAP)
    out = found.withColumn("opens", opens).withColumn("head", F.when(opens, F.concat(F.substring_index(as_text, GAP, 1), F.lit("\r\n"))))
    out = out.withColumn("head_bytes", F.octet_length("head").cast("long") + 2)
    length = field("Content-Length")
    out = out.withColumn("length", F.when(length.rlike("^[0-9]{1,15}$"), length.cast("long")))
    payload = F.substring("body", (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    return out.withColumns(
        {
            "type": field("WARC-Type"),
            "record_id": field("WARC-Record-ID"),
            "uri": field("WARC-Target-URI"),
            "refers": field("WARC-Refers-To"),
            "stated_digest": field("WARC-Payload-Digest"),
            "stated_length": field("X-Revisit-Payload-Length"),
            "whole": (F.col("head_bytes") + F.col("length") <= F.octet_length("body")),
        }
    ).withColumn("digest", F.when(F.col("whole"), F.sha1(payload)))


def chained(index: DataFrame) -> DataFrame:
    """The rows of `index` (file, offset, next, end) that are reached from offset 0 of their file."""
    order = Window.partitionBy("file").orderBy("offset")
    breaks = F.when(F.lag("next").over(order) == F.col("offset"), 0).otherwise(1)
    runs = materialize(index.withColumn("run", F.sum(breaks).over(order)), "runs")
    size = runs.groupBy("file").agg(F.max("run").alias("runs"))
    exits = runs.groupBy("file", "run").agg(F.max_by("next", "offset").alias("to"))
    target = runs.select("file", F.col("offset").alias("to"), F.col("run").alias("to_run"))
    jumps = exits.join(target, ["file", "to"]).where("to_run <> run").select("file", "run", "to_run", F.col("to").alias("entry"))
    reach = runs.where("offset = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    most = size.agg(F.max("runs")).first()[0] or 0
    span = 1
    while span < most:
        reach, jumps = materialize(reach, "reach"), materialize(jumps, "jumps")
        hop = reach.join(jumps.withColumnRenamed("entry", "at"), ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("at").alias("entry"))
        reach = reach.unionByName(hop).groupBy("file", "run").agg(F.min("entry").alias("entry"))
        second = jumps.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("last"), F.col("entry").alias("at"))
        jumps = jumps.join(second, ["file", "to_run"]).select("file", "run", F.col("last").alias("to_run"), F.col("at").alias("entry"))
        span *= 2
    return runs.join(reach, ["file", "run"]).where("offset >= entry").drop("run", "entry")


FIELDS = ["type", "record_id", "uri", "refers", "stated_digest", "stated_length"]


def index(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, head_bytes, length, digest (null if the payload holds a magic) and FIELDS."""
    slim = parsed(pieces(spark, path)).drop("body", "head")
    found = materialize(located(slim), "pieces")
    ends = found.groupBy("file").agg(F.max("end").alias("file_end"))
    some = found.where("opens and length is not null").withColumn("next", F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(GAP))
    kept = chained(some.select("file", "offset", "next", "end", "head_bytes", "length", "digest", *FIELDS))
    return kept.join(ends, "file").where(F.col("next") <= F.col("file_end")).drop("file_end", "end")


def payloads(spark: SparkSession, path: str, of: DataFrame) -> DataFrame:
    """file, offset and payload of indexed records, put together from the pieces between their ends."""
    files = of.select("file").distinct()
    found = located(pieces(spark, path).join(files, "file", "left_semi"))
    heads = of.select("file", "offset", F.col("offset").alias("owner"), "head_bytes", "length")
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.join(heads, ["file", "offset"], "left")
    for c in ("owner", "head_bytes", "length"):
        owned = owned.withColumn(c, F.last(c, ignorenulls=True).over(order))
    inside = owned.where(F.col("offset") < F.col("owner") + len(MAGIC) + F.col("head_bytes") + F.col("length"))
    parts = inside.groupBy("file", "owner", "head_bytes", "length").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("body").alias("body")))).alias("parts"))
    whole = F.unhex(F.array_join(F.col("parts.body"), MAGIC.encode().hex().upper()))
    payload = F.substring(whole, (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    return parts.select("file", F.col("owner").alias("offset"), payload.alias("payload"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index with the digests of all payloads; those with a magic inside come from a second scan of their files."""
    known = materialize(index(spark, path), "index")
    split = known.where("digest is null")
    if split.isEmpty():
        return known
    put = payloads(spark, path, split).select("file", "offset", F.sha1("payload").alias("joined"))
    return known.join(put, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")


def id_of(c: str) -> Column:
    return F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) to archives and reads them: the contract's columns and `verified`.

    `verified`: the payload read (for a revisit, that of its response, by digest)
    has the stated digest.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    write(pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.encode(html, "UTF-8").alias("payload")), path, min_bytes)
    got = read(spark, path)
    revisit = F.col("type") == "revisit"
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    out = got.select(
        id_of("record_id").alias("page_id"),
        F.when(revisit, F.col("stated_length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, id_of("refers")).alias("refers_to"),
        (revisit | (stated == F.col("digest"))).alias("verified"),
    )
    # A revisit is verified by a response of its digest; only digests that have revisits are joined.
    asked = out.where("record_type = 'revisit'").select("payload_digest").distinct()
    held = materialize(asked.join(out.where("record_type = 'response'").select("payload_digest"), "payload_digest", "left_semi").select("payload_digest", F.lit(True).alias("held")), "held")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    told = out.join(if_small(held), "payload_digest", "left")
    return told.select(*names, (F.col("verified") & ((F.col("record_type") == "response") | F.coalesce("held", F.lit(False)))).alias("verified"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
l AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN l.last IS NULL OR l.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN l.last <> p.page_id THEN l.last END AS refers_to, true AS verified
FROM p LEFT JOIN l ON p.d = l.d AND p.n >= 1000
"""
}
QUERIES = {"op10_warc": op10_warc}
