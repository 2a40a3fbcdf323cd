"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

DataFrame functions only. A rule fits its host and all subdomains where the
url's path starts with the rule's; the longest rule wins, equal ones by order.
Urls that a rule decides are the labelled ones. They train trees on binned
lexical features: one aggregation by distinct bins, then for each level of each
tree one histogram of gradients (nodes x features x bins, so bounded), from which
the driver picks splits. The rates of blocked urls by suffix and by first path element
leave out the fold of the url at hand where it is a labelled one. Other urls are judged by the trees: block at a chance
of one half or more. Without labelled urls, or with one class only, all others
get that class or, without any, allow.

Nulls and urls without `://` have an empty host and path, fit no rule and are
judged by their features (length zero for null). Rows that repeat are judged
alike. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, materialize, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Upper edges of each feature's bins.
EDGES = {
    "length": [20, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100, 150, 300],
    "host_length": [8, 12, 15, 18, 20, 22, 25, 30, 40, 60],
    "depth": [0, 1, 2, 3, 4, 6, 9],
    "host_dots": [0, 1, 2, 3, 4],
    "digit_ratio": [0.0, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5],
    "entropy": [2.0, 3.0, 3.4, 3.6, 3.8, 4.0, 4.2, 4.4, 4.7, 5.0],
    "parameters": [0, 1, 2, 4, 8],
    "hyphens": [0, 1, 2, 4],
    "path_end": [0, 1, 2],
    "secure": [0],
    "suffix_rate": [0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98],
    "section_rate": [0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98],
}


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    shape = "://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def match(rules: tuple[tuple[str, str], ...], value: int) -> Column:
    """The verdict (0) or text (1) of the longest rule that fits columns host and path."""
    found = []
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, rest = rule[1].partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        found.append(F.when(fits & F.col("path").startswith("/" + rest), F.lit(rule[value])))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features, `suffix` (last label of the host) and `section` (first path element)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "length": n,
            "host_length": F.length("host"),
            "depth": count_of(F.col("path"), "/"),
            "host_dots": count_of(F.col("host"), "."),
            "digit_ratio": F.coalesce(count_of(url, string.digits) / F.nullif(n, F.lit(0)), F.lit(0.0)),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.when(query == "", 0).otherwise(count_of(query, "&") + 1),
            "hyphens": count_of(url, "-"),
            "path_end": F.when(F.col("path").endswith("/"), 0).when(F.col("path").rlike(r"\.\w{1,5}$"), 2).otherwise(1),
            "secure": url.startswith("https").cast("int"),
            "suffix": F.substring_index("host", ".", -1),
            "section": F.regexp_extract("path", "^/([^/]*)", 1),
        }
    )


#: Labelled urls are dealt to so many folds.
FOLDS = 5


def rates(labelled: DataFrame, by: str, smooth: float = 20.0) -> DataFrame:
    """Share of blocked urls by value and fold, drawn towards one half: of the other folds, and of all for fold -1."""
    sums = labelled.groupBy(by, "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    whole = sums.groupBy(by).agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    of = lambda y, n: ((y + smooth / 2) / (n + smooth)).alias(f"{by}_rate")
    each = sums.join(whole, by).select(by, "fold", of(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")))
    return each.unionByName(whole.select(by, F.lit(-1).cast("int").alias("fold"), of(F.col("all_y"), F.col("all_n"))))


def bins(features: list[str]) -> Column:
    """Array of bin numbers."""
    return F.array(*(sum(((F.col(f) > e).cast("int") for e in EDGES[f]), F.lit(0)) for f in features))


class Trees:
    """Boosted trees over the array column `bin`; a tree is a dict from node to (feature, bin) or a value."""

    def __init__(self, start: float) -> None:
        self.start, self.trees = start, []

    @staticmethod
    def node(tree: dict, depth: int) -> Column:
        """Number of the node that a row is in after `depth` splits, from 1."""
        at: Column = F.lit(1)
        for level in range(depth):
            move = at
            for k in range(1 << level, 2 << level):
                if isinstance(tree.get(k), tuple):
                    f, b = tree[k]
                    move = F.when(at == k, 2 * k + (F.col("bin")[f] > b).cast("int")).otherwise(move)
            at = move
        return at

    @staticmethod
    def value(tree: dict, k: int = 1) -> Column:
        if not isinstance(tree.get(k), tuple):
            return F.lit(float(tree.get(k, 0.0)))
        f, b = tree[k]
        return F.when(F.col("bin")[f] <= b, Trees.value(tree, 2 * k)).otherwise(Trees.value(tree, 2 * k + 1))

    def margin(self) -> Column:
        return sum((self.value(t) for t in self.trees), F.lit(self.start))


def boost(rows: DataFrame, n_trees: int = 16, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss. rows: bin (array), n, y (sums over equal bins)."""
    n, y = rows.agg(F.sum("n"), F.sum("y")).first()
    if not n:
        return Trees(-10.0)
    if y in (0, n):
        return Trees(10.0 if y else -10.0)
    model = Trees(math.log(y / (n - y)))
    for _ in range(n_trees):
        tree: dict = {}
        p = 1 / (1 + F.exp(-model.margin()))
        scored = rows.select("bin", (F.col("y") - p * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        for level in range(depth):
            spread = scored.select(Trees.node(tree, level).alias("node"), "g", "h", F.posexplode("bin").alias("feature", "at")).where(F.col("node") >= 1 << level)
            hist = spread.groupBy("node", "feature", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict = {}
            for r in sorted(hist, key=lambda r: (r.node, r.feature, r["at"])):
                by.setdefault(r.node, {}).setdefault(r.feature, []).append((r["at"], r.g, r.h))
            for node, features in by.items():
                total_g, total_h = (sum(x[i] for x in features[0]) for i in (1, 2))
                tree[node] = rate * total_g / (total_h + l2)
                best = (1e-3, None)
                for f, cells in features.items():
                    g = h = 0.0
                    for at, cg, ch in cells[:-1]:
                        g, h = g + cg, h + ch
                        gain = g * g / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
                        if h > 1 and total_h - h > 1 and gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, at, rate * g / (h + l2), rate * (total_g - g) / (total_h - h + l2)))
                if best[1]:
                    f, at, left, right = best[1]
                    tree[node], tree[2 * node], tree[2 * node + 1] = (f, at), left, right
        model.trees.append(tree)
    return model


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (the trees' chance, for every url)."""
    host, path = split_url(F.col("url"))
    known = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = known.withColumn("rule", match(rules, 1)).withColumn("by_rule", match(rules, 0))
    fold = F.when(F.col("by_rule").isNotNull(), F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")).otherwise(-1)
    known = materialize(lexical(known).withColumn("fold", fold), "urls")
    labelled = known.where("by_rule is not null").withColumn("y", (F.col("by_rule") == "block").cast("long"))
    rated = known
    for by in ("suffix", "section"):
        rated = rated.join(if_small(materialize(rates(labelled, by), by)), [by, "fold"], "left").withColumn(f"{by}_rate", F.coalesce(f"{by}_rate", F.lit(0.5)))
    rated = rated.select("page_id", "host", "path", "rule", "by_rule", bins(list(EDGES)).alias("bin"))
    blocked = (F.col("by_rule") == "block").cast("long")
    train = rated.where("by_rule is not null").groupBy("bin").agg(F.count("*").alias("n"), F.sum(blocked).alias("y"))
    model = boost(materialize(train, "bins"))
    scored = rated.withColumn("block_score", F.round(1 / (1 + F.exp(-model.margin())), 9))
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filters": op9_url_filters}
