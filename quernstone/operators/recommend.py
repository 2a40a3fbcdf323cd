"""Recommenders: item-based collaborative filtering, boosted trees on joined features, and their blend."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, n_keys, n_listed, n_true, sum_of_values, zero_if_null


def ratings_of(df: DataFrame, user: str, item: str, value: str) -> DataFrame:
    """user, item, r: repeated ratings of a pair are averaged."""
    return df.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.avg(value).alias("r"))


def pearson(ratings: DataFrame, default: float = 0.7) -> DataFrame:
    """i, j, n, w for items with common raters, both ways and with themselves; means are over common raters.

    Without variance on a side w is `default`, told by least and largest rating, not
    by rounding.
    """
    a = ratings.select("user", F.col("item").alias("i"), F.col("r").alias("x"))
    b = ratings.select("user", F.col("item").alias("j"), F.col("r").alias("y"))
    m = a.join(b, "user").groupBy("i", "j").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))))
    flat = (F.col("lx") == F.col("hx")) | (F.col("ly") == F.col("hy"))
    return m.select("i", "j", "n", F.when(flat, default).otherwise(F.coalesce(F.try_divide(cov, spread), F.lit(default))).alias("w"))


def predict_cf(ratings: DataFrame, wanted: DataFrame, above: float = 0.0, default_weight: float = 0.7, default: float = 3.5, neighbours: int | None = None) -> DataFrame:
    """user, item, prediction for the distinct pairs of `wanted`.

    Known pairs: the rater's items weighted by correlation above `above` (the best
    `neighbours` of them, if given). Else the item's or the user's average, else
    `default`.
    """
    pairs = wanted.select("user", "item").distinct()
    users, items = ratings.groupBy("user").agg(F.avg("r").alias("user_avg")), ratings.groupBy("item").agg(F.avg("r").alias("item_avg"))
    known = pairs.join(users, "user", "left").join(items, "item", "left")
    near = known.where("user_avg is not null and item_avg is not null").select("user", "item")
    rated = ratings.select("user", F.col("item").alias("j"), "r")
    weights = pearson(ratings, default_weight).select(F.col("i").alias("item"), "j", "w")
    each = near.join(rated, "user").join(weights, ["item", "j"], "left").withColumn("w", F.coalesce("w", F.lit(default_weight))).where(F.col("w") > above)
    if neighbours:
        from pyspark.sql import Window

        best = Window.partitionBy("user", "item").orderBy(F.desc("w"), "j")
        each = each.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= neighbours)
    sums = each.groupBy("user", "item").agg(F.sum(F.col("w") * F.col("r")).alias("top"), F.sum(F.abs("w")).alias("bottom"))
    out = known.join(sums, ["user", "item"], "left")
    weighted = F.when(F.coalesce("top", F.lit(0.0)) == 0, default).otherwise(clip(F.try_divide("top", "bottom")))
    choice = F.when(F.col("user_avg").isNotNull() & F.col("item_avg").isNotNull(), weighted).otherwise(F.coalesce("item_avg", "user_avg", F.lit(default)))
    return out.select("user", "item", choice.alias("prediction"))


def with_features(pairs: DataFrame, *sides: tuple[DataFrame, str]) -> DataFrame:
    """pairs left-joined with each (features, key); what is missing is 0."""
    out = pairs
    for side, key in sides:
        out = out.join(side, key, "left")
    return out.na.fill(0)


def business_features(lake: dict[str, DataFrame]) -> DataFrame:
    b = lake["business"].select(
        "business_id", *(zero_if_null(c).alias(f"b_{c}") for c in ("stars", "review_count", "latitude", "longitude", "is_open")),
        n_keys("attributes").alias("b_attributes"), n_true("attributes").alias("b_true"), n_listed("categories").alias("b_categories"),
    )
    checkins = lake["checkin"].groupBy("business_id").agg(F.sum(sum_of_values("time")).alias("b_checkins"))
    photos = lake["photo"].groupBy("business_id").agg(F.count("*").alias("b_photos"))
    tips = lake["tip"].groupBy("business_id").agg(F.count("*").alias("b_tips"))
    return with_features(b, (checkins, "business_id"), (photos, "business_id"), (tips, "business_id"))


def user_features(lake: dict[str, DataFrame]) -> DataFrame:
    praise = ["funny", "cool", "compliment_cool", "compliment_funny", "compliment_photos", "compliment_more", "compliment_cute"]
    u = lake["user"].select(
        "user_id", *(zero_if_null(c).alias(f"u_{c}") for c in ("average_stars", "fans", "review_count", "useful")),
        n_listed("friends").alias("u_friends"), sum((zero_if_null(c) for c in praise), F.lit(0.0)).alias("u_praise"),
    )
    tips = lake["tip"].groupBy("user_id").agg(F.count("*").alias("u_tips"))
    return with_features(u, (tips, "user_id"))


def boosted(features: list[str], label: str, trees: int = 100, depth: int = 3, step: float = 0.1, subsample: float = 1.0, columns: str = "all") -> Pipeline:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=columns, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt])


def predict_boosted(train: DataFrame, test: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """test with `prediction`; keys stay in their rows."""
    return boosted(features, label, **options).fit(train).transform(test).drop("features")


def grid_search(train: DataFrame, features: list[str], label: str, depths: list[int], steps: list[float], trees: int = 20, folds: int = 3) -> DataFrame:
    """depth, step, rmse by cross-validation."""
    pipe = boosted(features, label, trees=trees)
    gbt = pipe.getStages()[1]
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, depths).addGrid(gbt.stepSize, steps).build()
    model = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=42, parallelism=2).fit(train)
    rows = [(int(p[gbt.maxDepth]), float(p[gbt.stepSize]), float(m)) for p, m in zip(grid, model.avgMetrics, strict=True)]
    return train.sparkSession.createDataFrame(rows, "depth int, step double, rmse double")


def blend(cf: DataFrame, model: DataFrame, weight: float = 0.1) -> DataFrame:
    """user, item, prediction: `weight` of the first, the rest of the second."""
    return cf.select("user", "item", F.col("prediction").alias("p")).join(model.select("user", "item", F.col("prediction").alias("q")), ["user", "item"]).select("user", "item", (weight * F.col("p") + (1 - weight) * F.col("q")).alias("prediction"))
