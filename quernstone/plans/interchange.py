"""Queries that go through the readers and writers: what is written and read back gives the same results in SQL over the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import itemsets, recommend
from ..sources import sinks, tables
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def folder(spark: SparkSession, tag: str) -> str:
    return f"{sinks.shared_dir(spark)}/quernstone/{tag}-{uuid.uuid4().hex}"


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as text files, scanned with a partition hint, split and counted."""
    path = folder(spark, "text")
    sinks.write_text(table(spark, d, "part").select("p_name"), path)
    return tables.text_lines(spark, path, 3).select(F.explode(F.split("value", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n, round(sum(o_totalprice), 2) AS stars, max(strftime(o_orderdate, '%Y-%m-%d')) AS last FROM orders GROUP BY 1")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as JSON lines, read with a declared schema; a malformed line would fail."""
    path = folder(spark, "json")
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").alias("stars"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    sinks.write_json(orders, path)
    return tables.json_lines(spark, path, tables.REVIEW).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("stars"), 2).alias("stars"), F.max("date").alias("last"))


@query("SELECT user_id, business_id, stars FROM (SELECT 'u' || user_id AS user_id, event_type || ', \"quoted\"' AS business_id, round(avg(value), 3) AS stars FROM events GROUP BY 1, 2)")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ratings at three decimals as quoted CSV with a header."""
    path = folder(spark, "csv")
    events = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat("event_type", F.lit(', "quoted"')).alias("business_id")).agg(F.avg("value").alias("stars"))
    sinks.write_csv(events, path, 3)
    return tables.csv_rows(spark, path, tables.RATING)


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 3) AS first, round(sum(CAST(embedding[8] AS DOUBLE)), 3) AS eighth FROM embeddings GROUP BY 1")
def points_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points as headerless CSV of id, label and eight coordinates in full."""
    path = folder(spark, "points")
    sinks.write_csv(table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"d{k}") for k in range(8))), path, header=False)
    x = tables.points(spark, path, 8)
    return x.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0]), 3).alias("first"), F.round(F.sum(F.col("features")[7]), 3).alias("eighth"))


RETAIL = "SELECT strftime(o_orderdate, '%-m/%-d/%Y') || '-' || ltrim(CAST(o_custkey AS VARCHAR), '0') AS basket, CAST(l_suppkey AS BIGINT) AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"SELECT basket, count(DISTINCT item) AS n FROM ({RETAIL}) GROUP BY basket HAVING count(DISTINCT item) > 5")
def retail_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Retail transactions: quoted CSV, ids with leading zeros, baskets by day and customer, written again and re-read."""
    raw, clean = folder(spark, "retail"), folder(spark, "transactions")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    made = {"TRANSACTION_DT": F.date_format("o_orderdate", "M/d/yyyy"), "CUSTOMER_ID": F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "AGE_GROUP": F.lit(None).cast("string"), "PIN_CODE": F.lit("Unknown"), "PRODUCT_SUBCLASS": F.lit("1"), "PRODUCT_ID": F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), "AMOUNT": F.lit("1"), "ASSET": F.lit("2"), "SALES_PRICE": F.lit("3")}
    sinks.write_csv(line.select(*(c.alias(n) for n, c in made.items())), raw)
    sinks.write_csv(tables.transactions(tables.csv_rows(spark, raw, tables.TRANSACTION)), clean)
    pairs = itemsets.baskets(tables.csv_rows(spark, clean, "basket string, item long"), "basket", "item", more_than=5)
    return pairs.groupBy("basket").agg(F.count("*").alias("n"))


@query("SELECT n_name AS run, CAST(2 AS BIGINT) AS n FROM nation")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A log that is appended to twice."""
    path = folder(spark, "log")
    for _ in range(2):
        sinks.append_log(table(spark, d, "nation").select("n_name"), path)
    return tables.csv_rows(spark, path, "run string", header=False).groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) AS BIGINT) AS days FROM orders")
def days_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", scalars.days_between("o_orderdate", "1998-01-01").cast("long").alias("days"))


def lake(spark: SparkSession, d: str) -> str:
    """A lake of JSON files from suppliers (businesses), customers (users), lines (photos, tips) and events (checkins)."""
    path = folder(spark, "lake")
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    attributes = F.create_map(F.lit("Open"), F.when(F.col("s_nationkey") % 2 == 0, "True").otherwise("False"), F.lit("Parking"), F.lit("{'garage': True, 'street': False, 'lot': True}"))
    categories = F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).when(F.col("s_suppkey") % 3 == 1, "none").otherwise("Food, Bars, Pubs")
    sinks.write_json(s.select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("s_acctbal").alias("stars"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("long")).alias("review_count"), F.when(F.col("s_suppkey") % 2 == 0, attributes).alias("attributes"), categories.alias("categories")), f"{path}/business.json")
    sinks.write_json(c.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_acctbal").alias("average_stars"), F.col("c_nationkey").cast("long").alias("fans"), F.lit(1).cast("long").alias("funny"), F.lit(2).cast("long").alias("compliment_cute"), F.when(F.col("c_custkey") % 2 == 0, "None").otherwise("a, b").alias("friends")), f"{path}/user.json")
    line = table(spark, d, "lineitem")
    key = F.col("l_suppkey").cast("string").alias("business_id")
    sinks.write_json(line.where("l_linenumber = 1").select(key), f"{path}/photo.json")
    sinks.write_json(line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.col("o_custkey").cast("string").alias("user_id"), key), f"{path}/tip.json")
    sinks.write_json(s.select(F.col("s_suppkey").cast("string").alias("business_id"), F.create_map(F.lit("Mon-1"), F.col("s_suppkey"), F.lit("Tue-2"), F.lit(5).cast("long")).alias("time")), f"{path}/checkin.json")
    sinks.write_json(table(spark, d, "nation").select(F.col("n_name").alias("review_id")), f"{path}/review_train.json")
    return path


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS business_id, s_acctbal AS b_stars, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) ELSE 0 END AS b_review_count,
CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS b_attributes, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 + (s_nationkey % 2 = 0)::INT ELSE 0 END AS BIGINT) AS b_true,
CAST(CASE WHEN s_suppkey % 3 = 2 THEN 3 ELSE 0 END AS BIGINT) AS b_categories, CAST(s_suppkey + 5 AS BIGINT) AS b_checkins, coalesce(p.n, 0) AS b_photos, coalesce(t.n, 0) AS b_tips
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) p ON p.l_suppkey = s_suppkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) t ON t.l_suppkey = s_suppkey""")
def business_features(spark: SparkSession, d: str) -> DataFrame:
    f = recommend.business_features(tables.json_lake(spark, lake(spark, d)))
    return f.select("business_id", "b_stars", "b_review_count", *(F.col(c).cast("long").alias(c) for c in ("b_attributes", "b_true", "b_categories", "b_checkins", "b_photos", "b_tips")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_acctbal AS u_average_stars, CAST(c_nationkey AS DOUBLE) AS u_fans, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS u_friends,
CAST(3 AS DOUBLE) AS u_praise, coalesce(t.n, 0) AS u_tips FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) t ON o_custkey = c_custkey""")
def user_features(spark: SparkSession, d: str) -> DataFrame:
    f = recommend.user_features(tables.json_lake(spark, lake(spark, d)))
    return f.select("user_id", "u_average_stars", "u_fans", F.col("u_friends").cast("long").alias("u_friends"), "u_praise", F.col("u_tips").cast("long").alias("u_tips"))
