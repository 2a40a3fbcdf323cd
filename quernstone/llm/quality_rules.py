"""Quality rules: exact text statistics, then robust multivariate outliers.

DataFrame functions only. Statistics come from arrays within the row. Their
transformed vectors are judged per language and source by the minimum covariance
determinant: from two starts (the quartiles' scales, and the covariance of signs),
concentration steps keep the `h` share of rows with the least Mahalanobis
distance and estimate location and scatter from them, until locations settle;
the start that ends with the lesser determinant counts. Every step is one aggregation of sums by group (partial sums first, so a
hot group is no burden) and one histogram of distances for the h-quantile.
Scatter is rescaled to be consistent at the normal law. A source's estimate is drawn
towards that of its language, and that towards all rows', as if the larger had
given it `prior_rows` rows; so groups of any size go the same way. A document is rejected
beyond the chi-squared quantile `p`.

Nulls: a null text has no words; null languages and sources are values of their
own. Texts under the base rule's 20 words are never judged by distance and do not
shape the estimates. Repeated rows count each. Empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, chi2_cdf, chi2_quantile, discard, if_small, materialize, table

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside the columns `keep`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(BLANK))
    rows = docs.select(*keep, text.alias("text"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    one = F.transform("words", lambda w: F.xxhash64(w))
    wide = rows.withColumn("one", one)
    n = F.col("n_words").cast("int")
    for name, of, step in (("two", "one", 1), ("four", "two", 2), ("window", "four", 4)):
        m = F.greatest(n - (2 * step - 1), F.lit(0))
        a, b = F.slice(of, F.lit(1), m), F.slice(of, F.lit(step + 1), m)
        wide = wide.withColumn(name, F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)))
    # A struct array is sorted only where some window repeats.
    repeats = F.size(F.array_distinct("window")) < F.size("window")
    placed = F.sort_array(F.transform("window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    wide = wide.withColumn("placed", F.when(repeats, placed).otherwise(F.lit(None)))
    same = lambda x, k: F.col("placed")[k]["h"] == x["h"]
    last = F.size("placed") - 1
    twin = F.filter("placed", lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(x, F.least(k + 1, last))))
    wide = wide.withColumn("starts", F.sort_array(F.transform(twin, lambda x: x["i"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("free"))
    covered = F.aggregate(
        "starts",
        zero,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW).cast("long"), i + WINDOW - acc["free"])).alias("n"),
            (i + WINDOW).cast("long").alias("free"),
        ),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    wide = wide.withColumn("lines", lines)
    out = wide.select(
        *keep,
        "n_words",
        F.length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """Transformed statistics: length, word length, symbols, repeated words (with lines)."""
    n = F.col("n_words")
    return {
        "x0": F.log1p(n),
        "x1": F.log(F.col("word_chars") / n),
        "x2": F.log1p(100.0 * F.col("n_symbols") / n),
        "x3": F.log1p(100.0 * (F.col("n_repeat_words") + F.col("n_dup_lines")) / n),
    }


DIM = 4
PAIRS = list(combinations_with_replacement(range(DIM), 2))
#: Floors of the standard deviations: below, differences are noise.
FLOOR = [0.25, 0.05, 0.5, 0.5]
BIN = 16.0


def inverse_cholesky(scale: float) -> dict[str, Column]:
    """Columns w{i}{j} of the inverse of the lower Cholesky factor of columns s{i}{j} times `scale`, floors added."""
    s = lambda i, j: F.col(f"s{max(i, j)}{min(i, j)}") * scale + (F.lit(FLOOR[i] ** 2) if i == j else 0)
    low: dict = {}
    for i in range(DIM):
        for j in range(i + 1):
            rest = s(i, j) - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    inv: dict = {}
    for i in range(DIM):
        inv[i, i] = 1 / low[i, i]
        for j in range(i):
            inv[i, j] = -sum((low[i, k] * inv[k, j] for k in range(j, i)), F.lit(0.0)) / low[i, i]
    return {f"w{i}{j}": inv[i, j] for i, j in inv}


def distance() -> Column:
    """Squared Mahalanobis distance from x, m and w columns."""
    total: Column = F.lit(0.0)
    for i in range(DIM):
        z = sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


M = [f"m{i}" for i in range(DIM)]
S = [f"s{j}{i}" for i, j in PAIRS]
W = [f"w{i}{j}" for i in range(DIM) for j in range(i + 1)]


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means m and scatter s of x by group, with the number of rows; rounded, as sums come in any order."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(F.avg(f"x{i}").alias(f"m{i}") for i in range(DIM)),
        *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{j}{i}") for i, j in PAIRS),
    )
    return sums.select(*by, "n", *(F.round(m, 9).alias(m) for m in M), *(F.round(F.col(f"p{j}{i}") - F.col(f"m{i}") * F.col(f"m{j}"), 9).alias(f"s{j}{i}") for i, j in PAIRS))


def quartiles(rows: DataFrame) -> DataFrame:
    """g, m (medians) and d (the quartiles' scale), from histograms of values to two decimals, so partitions don't matter."""
    each = rows.select("g", F.posexplode(F.array(*(F.round(f"x{i}", 2) for i in range(DIM)))).alias("dim", "x")).groupBy("g", "dim", "x").agg(F.count("*").alias("n"))
    order, every = Window.partitionBy("g", "dim").orderBy("x"), Window.partitionBy("g", "dim")
    upto = each.withColumn("upto", F.sum("n").over(order) / F.sum("n").over(every))
    at = lambda q: F.min(F.when(F.col("upto") >= q, F.col("x")))
    q = upto.groupBy("g", "dim").agg(at(0.25).alias("low"), at(0.5).alias("m"), at(0.75).alias("high"))
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    return q.groupBy("g").agg(*(pick(i, F.col("m")).alias(f"m{i}") for i in range(DIM)), *(pick(i, (F.col("high") - F.col("low")) / 1.349).alias(f"d{i}") for i in range(DIM)))


def starts(rows: DataFrame) -> DataFrame:
    """g, start, m, s: the quartiles' scales alone, and with the correlations of the standardized rows' directions."""
    middle = materialize(quartiles(rows), "quartiles")
    diagonal = middle.select("g", F.lit(0).alias("start"), *M, *((F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"s{j}{i}") for i, j in PAIRS))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(F.col(f"d{i}"), F.lit(FLOOR[i])) for i in range(DIM)]
    length = sum((v * v for v in z), F.lit(1e-9))
    turned = rows.join(if_small(middle), "g").groupBy("g").agg(*(F.avg(z[i] * z[j] / length).alias(f"c{j}{i}") for i, j in PAIRS))
    back = lambda i, j: F.round(DIM * F.col(f"c{j}{i}") * F.greatest(F.col(f"d{i}"), F.lit(FLOOR[i])) * F.greatest(F.col(f"d{j}"), F.lit(FLOOR[j])), 9)
    signs = middle.join(turned, "g").select("g", F.lit(1).alias("start"), *M, *(back(i, j).alias(f"s{j}{i}") for i, j in PAIRS))
    return diagonal.unionByName(signs)


def fit(rows: DataFrame, h: float = 0.75) -> DataFrame:
    """Location m and scatter s by g. rows: g (not null) and x, written down.

    A step is taken by the groups and starts whose determinant falls by it; there
    are finitely many sets of kept rows, so steps come to an end.
    """
    correction = h / chi2_cdf(chi2_quantile(h, DIM), DIM + 2)
    by, fields = ["g", "start"], [*M, *S, *W, "d"]
    determinant = F.round(-sum((F.log(F.col(f"w{i}{i}")) for i in range(DIM)), F.lit(0.0)), 6)
    # Of the starts any step is better.
    at = materialize(starts(rows).withColumns(inverse_cholesky(1.0)).withColumn("d", F.lit(float("inf"))), "start")
    while True:
        near = rows.join(if_small(at.select(*by, *M, *W)), "g").withColumn("bin", F.floor(F.log2(distance() + 1e-6) * BIN))
        cut = materialize(quantile_bin(near.groupBy(*by, "bin").agg(F.count("*").alias("n")), by, h), "cut")
        kept = near.join(if_small(cut), by).where(F.col("bin") <= F.col("cut")).select(*by, *(f"x{i}" for i in range(DIM)))
        new = moments(kept, by).withColumns(inverse_cholesky(correction)).withColumn("d", determinant)
        both = at.select(*by, F.struct(*fields).alias("old")).join(new.select(*by, F.struct(*fields).alias("new")), by)
        better = F.col("new.d") < F.col("old.d")
        now = materialize(both.select(*by, better.alias("better"), F.when(better, F.col("new")).otherwise(F.col("old")).alias("b")).select(*by, "better", "b.*"), "step")
        discard(at, cut)
        at = now
        if not now.agg(F.max("better")).first()[0]:
            break
    best = at.groupBy("g").agg(F.min(F.struct("d", "start", *M, *S)).alias("b"))
    return best.select("g", *(F.col(f"b.{m}").alias(m) for m in M), *((F.col(f"b.{x}") * correction).alias(x) for x in S))


def quantile_bin(counts: DataFrame, by: list[str], h: float) -> DataFrame:
    """Least bin that holds the share h of its group's rows with those below."""
    order = Window.partitionBy(*by).orderBy("bin")
    every = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(every))
    return upto.where(F.col("upto") >= F.col("all") * h).groupBy(*by).agg(F.min("bin").alias("cut"))


def drawn(child: DataFrame, prior_rows: float) -> DataFrame:
    """Columns m and s of rows with n, m, s and their parent's pm and ps: the estimate of n rows with `prior_rows` of the parent's."""
    a = F.col("n") / (F.col("n") + prior_rows)
    gap = lambda i: F.col(f"m{i}") - F.col(f"pm{i}")
    m = {f"m{i}": a * F.col(f"m{i}") + (1 - a) * F.col(f"pm{i}") for i in range(DIM)}
    s = {f"s{j}{i}": a * F.col(f"s{j}{i}") + (1 - a) * F.col(f"ps{j}{i}") + a * (1 - a) * gap(i) * gap(j) for i, j in PAIRS}
    return child.withColumns(m | s).drop("n", *(f"p{x}" for x in M + S))


def judge(docs: DataFrame, p: float = 0.9999999, prior_rows: float = 200, h: float = 0.75) -> DataFrame:
    """The statistics with `distance` (squared) and `kept`, beside doc_id."""
    # As JSON a null differs from any text, and from a value that isn't there.
    levels = [F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.lit("{}")]
    named = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    stats = statistics(named.withColumns({f"g{k}": g for k, g in enumerate(levels)}), ["doc_id", "g0", "g1", "g2"])
    stats = materialize(stats, "statistics")
    rows = stats.where(~F.col("base_failed")).withColumns(vector())
    vectors = materialize(rows.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *(f"x{i}" for i in range(DIM))), "vectors")
    model = materialize(fit(vectors, h), "model")
    groups = rows.groupBy("g0", "g1", "g2").agg(F.count("*").alias("n"))
    langs = groups.groupBy("g1", "g2").agg(F.sum("n").alias("n"))
    own = lambda df, g: df.join(model.withColumnRenamed("g", g), g)
    parent = lambda df, g: df.select(F.col(g), *(F.col(x).alias(f"p{x}") for x in M + S))
    by_lang = drawn(own(langs, "g1").join(parent(model.withColumnRenamed("g", "g2"), "g2"), "g2"), prior_rows)
    by_source = drawn(own(groups, "g0").join(parent(by_lang, "g1"), "g1"), prior_rows)
    params = materialize(by_source.select("g0", *M, *S).withColumns(inverse_cholesky(1.0)).select("g0", *M, *W), "parameters")
    judged = stats.join(if_small(params), "g0", "left").withColumns(vector_safe()).withColumn("distance", F.when(~F.col("base_failed"), F.round(distance(), 6)))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(p, DIM))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def vector_safe() -> dict[str, Column]:
    """As `vector`, null where the base rule failed (no words: no logarithm)."""
    return {k: F.when(~F.col("base_failed"), v) for k, v in vector().items()}


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
