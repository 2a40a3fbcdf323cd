"""Readers: the engine's own tables, and the text, JSON and CSV inputs of data-mining jobs.

Schemas are declared, never inferred. Readers are lazy, so column pruning and
filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, useful long, funny long, cool long, text string, date string"
BUSINESS = "business_id string, city string, stars double, review_count long, latitude double, longitude double, is_open int, attributes map<string,string>, categories string"
USER = "user_id string, average_stars double, fans long, review_count long, useful long, funny long, cool long, friends string, compliment_hot long, compliment_more long, compliment_profile long, compliment_cute long, compliment_list long, compliment_note long, compliment_plain long, compliment_cool long, compliment_funny long, compliment_writer long, compliment_photos long"
CHECKIN = "business_id string, time map<string,long>"
PHOTO = "business_id string"
TIP = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"
TRANSACTION = "TRANSACTION_DT string, CUSTOMER_ID string, AGE_GROUP string, PIN_CODE string, PRODUCT_SUBCLASS string, PRODUCT_ID string, AMOUNT string, ASSET string, SALES_PRICE string"
LAKE = {"business": BUSINESS, "user": USER, "review_train": REVIEW, "checkin": CHECKIN, "photo": PHOTO, "tip": TIP}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Column value; `partitions` deals the lines anew."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lake(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: json_lines(spark, f"{folder}/{name}.json", schema) for name, schema in LAKE.items()}


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Quoted or plain CSV; each file's first line is its header."""
    return spark.read.schema(schema).csv(path, header=header, quote='"', escape='"', mode="FAILFAST")


def points(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """Headerless id, label and coordinates -> id, label, features (array)."""
    names = [f"d{k}" for k in range(dimensions)]
    rows = csv_rows(spark, path, ", ".join(["id long", "label int", *(f"{n} double" for n in names)]), header=False)
    return rows.select("id", "label", F.array(*names).alias("features"))


def rows_of(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """A small list of the driver as a table."""
    return spark.createDataFrame(data, schema)


def transactions(rows: DataFrame) -> DataFrame:
    """`basket` (date-customer, customer without leading zeros) and `item` (product number) of retail transactions."""
    customer: Column = F.ltrim(F.col("CUSTOMER_ID"), F.lit("0"))
    return rows.select(F.concat_ws("-", "TRANSACTION_DT", customer).alias("basket"), F.col("PRODUCT_ID").cast("long").alias("item"))
