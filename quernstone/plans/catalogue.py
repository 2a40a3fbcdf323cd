"""The query catalogue over the star schema, with the same results in DuckDB SQL where SQL can tell them.

Stand-ins: users are customers or event users, items are parts, suppliers, brands
or event types, ratings are event values scaled to 1..5. Doubles are rounded so
that the order of sums does not show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coefficients
from ..operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from ..sources import sinks
from ..sources.sinks import settled
from ..sources.tables import table
from ..streaming import sketches as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- relational ----------------------------------------------------------------


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return relational.word_count(table(spark, d, "documents").select(F.lower("text").alias("value")))


def sales(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (year(l_shipdate) = 1997) AS n_in_year,
count(DISTINCT o_custkey) AS n_users, count(DISTINCT l_partkey) AS n_items FROM {JOINED}""")
def review_profile(spark: SparkSession, d: str) -> DataFrame:
    return relational.profile(sales(spark, d), F.year("l_shipdate") == 1997, "o_custkey", "l_partkey")


@query(f"SELECT o_custkey, count(*) AS n FROM {JOINED} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(sales(spark, d), "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top10_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT CAST(ascii(p_name) % 10 AS INTEGER) AS \"partition\", count(*) AS n FROM part GROUP BY 1")
def partition_study(spark: SparkSession, d: str) -> DataFrame:
    placed = relational.placed_by_first_letter(table(spark, d, "part").select("p_name"), "p_name", 10)
    return relational.partition_sizes(placed)


CITY = """SELECT n_name AS city, round(avg(l_quantity), 6) AS average
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY average DESC, city"""


@query(CITY)
def city_average(spark: SparkSession, d: str) -> DataFrame:
    """Items, orders and customers meet on their keys; the few nations are broadcast by the planner."""
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    # Sums by nation do not need names: join those to 25 rows.
    sums = line.join(orders.join(customer, "o_custkey"), "o_orderkey").groupBy("n_nationkey").agg(F.avg("l_quantity").alias("a"))
    named = sums.join(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("city")), "n_nationkey")
    return named.select("city", F.round("a", 6).alias("average")).orderBy(F.desc("average"), "city")


@query(f"{CITY} LIMIT 10")
def city_average_top10(spark: SparkSession, d: str) -> DataFrame:
    return city_average(spark, d).limit(10)


# --- itemsets ------------------------------------------------------------------


def as_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("size").cast("long").alias("size"), F.array_join(F.col("items").cast("array<string>"), "|").alias("items"), "n")


def itemset_sql(pairs: str, share: float, sizes: int) -> str:
    """All itemsets up to `sizes` in that share of the baskets, each level from sets that are frequent."""
    support = f"(SELECT greatest(1, ceil({share} * count(DISTINCT basket))) FROM b)"
    levels, parts = [], []
    for k in range(2, sizes + 1):
        names = ", ".join(f"i{j}" for j in range(1, k))
        levels.append(f"f{k - 1} AS (SELECT {names} FROM l{k - 1} GROUP BY ALL HAVING count(*) >= {support})")
        levels.append(f"l{k} AS (SELECT p.*, k.item AS i{k} FROM l{k - 1} p JOIN f{k - 1} USING ({names}) JOIN k ON p.basket = k.basket AND k.item > p.i{k - 1})")
    for k in range(1, sizes + 1):
        names = ", ".join(f"i{j}" for j in range(1, k + 1))
        parts.append(f"SELECT CAST({k} AS BIGINT) AS size, concat_ws('|', {names}) AS items, count(*) AS n FROM l{k} GROUP BY {names} HAVING count(*) >= {support}")
    return f"""WITH b AS (SELECT DISTINCT basket, item FROM ({pairs})),
k AS (SELECT * FROM b WHERE item IN (SELECT item FROM b GROUP BY item HAVING count(*) >= {support})), l1 AS (SELECT basket, item AS i1 FROM k){''.join(', ' + x for x in levels)}
{' UNION ALL '.join(parts)}"""


BRANDS = "SELECT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
#: Supports are shares of the baskets.
BRAND_SHARE, SUPPLIER_SHARE, DAILY_SHARE, CROSS_SHARE = 0.0054, 0.2, 0.01, 0.027


def brand_rows(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("p_partkey"))
    return line.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item")), "p_partkey")


def brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(brand_rows(spark, d), "basket", "item")


def in_share(pairs: DataFrame, share: float) -> DataFrame:
    return itemsets.frequent(pairs, itemsets.support_of(pairs, share))


@query(itemset_sql(BRANDS, BRAND_SHARE, 4))
def frequent_itemsets_brand(spark: SparkSession, d: str) -> DataFrame:
    return as_rows(in_share(brand_pairs(spark, d), BRAND_SHARE))


@query(itemset_sql(f"SELECT o_custkey AS basket, l_suppkey AS item FROM {JOINED}", SUPPLIER_SHARE, 10))
def frequent_itemsets_supplier(spark: SparkSession, d: str) -> DataFrame:
    return as_rows(in_share(itemsets.baskets(sales(spark, d), "o_custkey", "l_suppkey"), SUPPLIER_SHARE))


DAILY = "SELECT strftime(ts, '%Y-%m-%d') || '-' || user_id AS basket, event_type AS item FROM events"
DAILY_BASKETS = f"SELECT * FROM ({DAILY}) WHERE basket IN (SELECT basket FROM ({DAILY}) GROUP BY basket HAVING count(DISTINCT item) > 2)"


def daily_itemsets(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "events").select(F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), "user_id").alias("basket"), "event_type")
    return in_share(itemsets.baskets(keyed, "basket", "event_type", more_than=2), DAILY_SHARE)


@query(itemset_sql(DAILY_BASKETS, DAILY_SHARE, 6))
def frequent_itemsets_daily(spark: SparkSession, d: str) -> DataFrame:
    return as_rows(daily_itemsets(spark, d))


@query(f"""SELECT size, string_agg(line, ',' ORDER BY line) AS line FROM (
SELECT size, '(' || chr(39) || replace(items, '|', chr(39) || ', ' || chr(39)) || chr(39) || ')' AS line FROM ({itemset_sql(DAILY_BASKETS, DAILY_SHARE, 6)})) GROUP BY size""")
def itemset_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.itemset_report(daily_itemsets(spark, d)).withColumn("size", F.col("size").cast("long"))


@query(itemset_sql(BRANDS, CROSS_SHARE, 3))
def fpgrowth_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    baskets = itemsets.weighed(brand_rows(spark, d))
    n = baskets.agg(F.sum("n")).first()[0] or 0
    return as_rows(itemsets.weighed_fpgrowth(baskets, max(1, math.ceil(CROSS_SHARE * n))))


# --- similarity ----------------------------------------------------------------


def jaccard_sql(sets: str, threshold: float) -> str:
    return f"""WITH s AS ({sets}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.element = y.element AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(c / (p.n + q.n - c), 6) AS sim FROM c JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE c / (p.n + q.n - c) >= {threshold}"""


def rounded_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@query(jaccard_sql("SELECT DISTINCT user_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS element FROM events", 0.5))
def jaccard_exact(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "events").select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("element")).distinct()
    return rounded_pairs(similarity.jaccard_pairs(sets, 0.5))


SHINGLES = """SELECT DISTINCT doc_id AS id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS element
FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i
  FROM (SELECT doc_id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents))"""


def similar_texts(spark: SparkSession, d: str) -> DataFrame:
    lists = similarity.shingle_lists(table(spark, d, "documents"), hashed=True)
    return similarity.similar_lists(similarity.once_an_id(lists), 0.5, bits=0)


@query(jaccard_sql(SHINGLES, 0.5))
def near_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    return rounded_pairs(similar_texts(spark, d))


SIGNATURES = f"""s AS ({SHINGLES}), i AS (SELECT element, dense_rank() OVER (ORDER BY element) - 1 AS ix FROM (SELECT DISTINCT element FROM s)),
m AS (SELECT count(*) AS m FROM i),
h AS (SELECT id, {', '.join(f'min((ix * {k + 1} + 501) % m) AS h{k}' for k in range(20))} FROM s JOIN i USING (element), m GROUP BY id)"""


def signatures(spark: SparkSession, d: str) -> DataFrame:
    indexed, m = relational.numbered(similarity.shingles(table(spark, d, "documents")), "element", "id")
    return similarity.minhash(indexed, max(m, 1))


@query(f"WITH {SIGNATURES} SELECT id, {', '.join(f'CAST(h{k} AS BIGINT) AS h{k}' for k in range(20))} FROM h")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return signatures(spark, d)


BANDS = " UNION ALL ".join(f"SELECT id, {k} AS band, h{2 * k} AS x, h{2 * k + 1} AS y FROM h" for k in range(10))
CANDIDATES = f"""{SIGNATURES}, e AS ({BANDS}), c AS (SELECT DISTINCT p.id AS a, q.id AS b FROM e p JOIN e q ON p.band = q.band AND p.x = q.x AND p.y = q.y AND p.id < q.id)"""


@query(f"WITH {CANDIDATES} SELECT a, b FROM c")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.lsh_pairs(signatures(spark, d))


@query(f"""WITH {CANDIDATES}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
k AS (SELECT a, b, count(*) AS k FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b AND x.element = y.element GROUP BY 1, 2)
SELECT a, b, round(k / (p.n + q.n - k), 6) AS sim FROM k JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE k / (p.n + q.n - k) >= 0.5""")
def lsh_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are far more than similar pairs, and each would take two whole sets along: so bands are compared of similar pairs only."""
    return rounded_pairs(similarity.agreeing(similar_texts(spark, d), settled(signatures(spark, d), "signatures"), 10, 2))


# --- recommendation ------------------------------------------------------------

STARS = "least(5.0, 1.0 + value / 25.0)"
TRAIN = f"SELECT user_id AS \"user\", event_type AS item, avg({STARS}) AS r FROM events WHERE event_id % 10 <> 0 AND user_id % 25 <> 0 AND event_type <> 'error' GROUP BY 1, 2"
WEIGHTS = """t AS (%s),
w AS (SELECT x.item AS i, y.item AS j, count(*) AS n,
  CASE WHEN min(x.r) = max(x.r) OR min(y.r) = max(y.r) THEN 0.7 ELSE
  (sum(x.r * y.r) - sum(x.r) * sum(y.r) / count(*)) / sqrt((sum(x.r * x.r) - sum(x.r) * sum(x.r) / count(*)) * (sum(y.r * y.r) - sum(y.r) * sum(y.r) / count(*))) END AS w
  FROM t x JOIN t y USING ("user") GROUP BY 1, 2)""" % TRAIN
PREDICTED = f"""{WEIGHTS}, q AS (SELECT DISTINCT user_id AS "user", event_type AS item FROM events WHERE event_id % 10 = 0),
ua AS (SELECT "user", avg(r) AS ua FROM t GROUP BY 1), ia AS (SELECT item, avg(r) AS ia FROM t GROUP BY 1),
e AS (SELECT q."user", q.item, coalesce(w.w, 0.7) AS w, t.r FROM q JOIN ia USING (item) JOIN t ON t."user" = q."user" LEFT JOIN w ON w.i = q.item AND w.j = t.item),
p AS (SELECT "user", item, sum(w * r) AS a, sum(abs(w)) AS b FROM e WHERE w > 0 GROUP BY 1, 2),
f AS (SELECT q."user", q.item, CASE WHEN ua IS NOT NULL AND ia IS NOT NULL THEN CASE WHEN coalesce(a, 0) = 0 THEN 3.5 ELSE greatest(0.0, least(5.0, a / b)) END
  ELSE coalesce(ia, ua, 3.5) END AS prediction FROM q LEFT JOIN ua USING ("user") LEFT JOIN ia USING (item) LEFT JOIN p ON p."user" = q."user" AND p.item = q.item)"""


def stars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("item"), F.least(F.lit(5.0), 1.0 + F.col("value") / 25.0).alias("stars"))


def split_ratings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training ratings, without some users and one item so that fallbacks are used, and the rest."""
    rows = stars(spark, d)
    train = rows.where("event_id % 10 <> 0 and user % 25 <> 0 and item <> 'error'")
    return recommend.ratings_of(train, "user", "item", "stars"), rows.where("event_id % 10 = 0")


@query(f"WITH {WEIGHTS} SELECT i, j, n, round(w, 4) AS w FROM w WHERE i <> j")
def item_pearson(spark: SparkSession, d: str) -> DataFrame:
    return recommend.pearson(split_ratings(spark, d)[0]).where("i <> j").withColumn("w", F.round("w", 4))


@query(f'WITH {PREDICTED} SELECT "user", item, round(prediction, 4) AS prediction FROM f')
def item_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = split_ratings(spark, d)
    return recommend.predict_cf(train, test).withColumn("prediction", F.round("prediction", 4))


TESTED = f'WITH {PREDICTED}, y AS (SELECT user_id AS "user", event_type AS item, {STARS} AS stars FROM events WHERE event_id % 10 = 0), j AS (SELECT y.*, coalesce(f.prediction, 0) AS prediction FROM y LEFT JOIN f USING ("user", item))'


def tested(spark: SparkSession, d: str) -> DataFrame:
    train, test = split_ratings(spark, d)
    return relational.with_default(test, recommend.predict_cf(train, test), ["user", "item"], "prediction")


@query(f"{TESTED} SELECT round(sqrt(avg((stars - prediction) * (stars - prediction))), 6) AS rmse FROM j")
def prediction_rmse(spark: SparkSession, d: str) -> DataFrame:
    return relational.rmse(tested(spark, d), "stars", "prediction").select(F.round("rmse", 6).alias("rmse"))


def bins_sql(value: str) -> str:
    return f"{TESTED} SELECT CAST((v >= 1)::INT + (v >= 2)::INT + (v >= 3)::INT + (v >= 4)::INT AS BIGINT) AS bin, count(*) AS n FROM (SELECT {value} AS v FROM j) GROUP BY 1"


@query(bins_sql("round(prediction, 6)"))
def prediction_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(tested(spark, d).withColumn("v", F.round("prediction", 6)), "v")


@query(bins_sql("round(abs(stars - prediction), 6)"))
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(tested(spark, d).withColumn("v", F.round(F.abs(F.col("stars") - F.col("prediction")), 6)), "v")


FEATURES = ["c_acctbal", "n_lines", "quantity", "n_parts"]


def order_features(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_partkey").alias("n_parts"))
    return recommend.with_features(orders, (customer, "o_custkey"), (lines, "o_orderkey"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, coalesce(c_acctbal, 0) AS c_acctbal, coalesce(n_lines, 0) AS n_lines, coalesce(quantity, 0) AS quantity, coalesce(n_parts, 0) AS n_parts
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def user_item_features(spark: SparkSession, d: str) -> DataFrame:
    return order_features(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", *FEATURES)


def rating_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    train, test = split_ratings(spark, d)
    of_user = train.groupBy("user").agg(F.avg("r").alias("u_avg"), F.count("*").alias("u_n"))
    of_item = train.groupBy("item").agg(F.avg("r").alias("i_avg"), F.count("*").alias("i_n"))
    names = ["u_avg", "u_n", "i_avg", "i_n"]
    rows = lambda df: recommend.with_features(df, (of_user, "user"), (of_item, "item"))
    return rows(train), rows(test.select("user", "item").distinct()), names


@query()
def gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = rating_features(spark, d)
    return recommend.predict_boosted(train, test, names, "r", trees=100).select("user", "item", "prediction")


@query()
def hybrid_predict(spark: SparkSession, d: str) -> DataFrame:
    ratings, test = split_ratings(spark, d)
    return recommend.blend(recommend.predict_cf(ratings, test), gbt_predict(spark, d))


@query()
def gbt_grid_search(spark: SparkSession, d: str) -> DataFrame:
    train, _, names = rating_features(spark, d)
    return recommend.grid_search(train, names, "r", [2, 3], [0.1], trees=5, folds=2)


# --- graphs --------------------------------------------------------------------

SHARED = 34
EDGES = f"""p AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS item FROM {JOINED}),
e AS (SELECT x.u AS src, y.u AS dst, count(*) AS common FROM p x JOIN p y ON x.item = y.item AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {SHARED}),
l AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_edges(sales(spark, d), "o_custkey", "l_suppkey", SHARED)


@query(f"WITH {EDGES} SELECT src, dst, common FROM e")
def co_review_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d)


@query(f"""WITH RECURSIVE {EDGES}, r(id, reached) AS (SELECT src, src FROM l UNION SELECT r.id, l.dst FROM r JOIN l ON l.src = r.reached)
SELECT id, min(reached) AS component FROM r GROUP BY id""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges_of(spark, d))


def lpa_sql(rounds: int = 5) -> str:
    steps = ["l0 AS (SELECT DISTINCT src AS id, src AS label FROM l)"]
    for k in range(rounds):
        votes = f"SELECT l.src AS id, label, row_number() OVER (PARTITION BY l.src ORDER BY count(*) DESC, label) AS place FROM l JOIN l{k} ON l.dst = l{k}.id GROUP BY l.src, label"
        steps.append(f"l{k + 1} AS (SELECT id, label FROM ({votes}) WHERE place = 1)")
    return f"WITH {EDGES}, {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query(lpa_sql())
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(edges_of(spark, d))


def betweenness_sql(levels: int = 12) -> str:
    """Shortest paths level by level, then for every edge and pair of ends the share of their paths that take it."""
    steps = ["p0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS v, CAST(1 AS DOUBLE) AS n FROM l)", "a0 AS MATERIALIZED (SELECT s, v, 0 AS d, n FROM p0)"]
    for k in range(1, levels + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT p.s, l.dst AS v, sum(p.n) AS n FROM p{k - 1} p JOIN l ON l.src = p.v WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} a WHERE a.s = p.s AND a.v = l.dst) GROUP BY 1, 2)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT s, v, {k}, n FROM p{k})")
    return f"""WITH {EDGES}, {', '.join(steps)}
SELECT src, dst, round(sum(x.n * y.n / z.n), 4) AS betweenness FROM l
JOIN a{levels} x ON x.v = src JOIN a{levels} y ON y.v = dst JOIN a{levels} z ON z.s = x.s AND z.v = y.s
WHERE x.d + 1 + y.d = z.d AND src < dst GROUP BY src, dst"""


@query(betweenness_sql())
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(edges_of(spark, d)).withColumn("betweenness", F.round("betweenness", 4))


@query()
def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return graph.girvan_newman(graph.co_edges(sales(spark, d), "o_custkey", "l_suppkey", 36))


# --- sketches ------------------------------------------------------------------


@query("SELECT b AS batch, round(pow(1 - exp(-9 * (b + 1) * 100 / 69997.0), 9), 6) AS fpr FROM (SELECT unnest(generate_series(0, 49)) AS b)")
def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    return sketches.bloom_series(spark)


def folded(m: int, key: str = "key") -> str:
    codes = f"list_transform(generate_series(1, length({key})), lambda i: CAST(ascii(substr({key}, i, 1)) AS BIGINT))"
    return f"list_reduce({codes}, lambda a, b: (a * 256 + b) % {m})"


HASHED = "[" + ", ".join(f"(x * {a} + {b}) % 69997" for a, b in coefficients(9)) + "]"


@query(f"""WITH k AS (SELECT CAST(user_id AS VARCHAR) AS key, min(event_id) AS first FROM events GROUP BY 1), x AS (SELECT *, {folded(69997)} AS x FROM k),
s AS (SELECT key, first, unnest({HASHED}) AS bit FROM x), a AS (SELECT bit, min(first) AS set_at FROM s GROUP BY 1),
r AS (SELECT key, first, max(set_at) AS ready FROM s JOIN a USING (bit) GROUP BY 1, 2)
SELECT event_id, ready < event_id AS seen, first = event_id AS new FROM events JOIN r ON CAST(user_id AS VARCHAR) = key""")
def bloom_seen(spark: SparkSession, d: str) -> DataFrame:
    return sketches.bloom_seen(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id")


def fm_sql() -> str:
    zeros = lambda a, b: f"max(length(bin((x * {a} + {b}) % 6999)) - length(rtrim(bin((x * {a} + {b}) % 6999), '0')))"
    rs = ", ".join(f"{zeros(a, b)} AS r{j}" for j, (a, b) in enumerate(coefficients(50)))
    means = ", ".join(f"(pow(2, r{g}) + pow(2, r{g + 1})) / 2" for g in range(0, 50, 2))
    return f"""WITH k AS (SELECT DISTINCT event_id // 300 AS batch, CAST(user_id AS VARCHAR) AS key FROM events), x AS (SELECT *, {folded(6999)} AS x FROM k),
r AS (SELECT batch, count(*) AS truth, {rs} FROM x GROUP BY batch)
SELECT CAST(batch AS BIGINT) AS batch, truth, CAST(list_median([{means}]) AS DOUBLE) AS estimate FROM r""".replace("list_median(", "list_aggregate(").replace("])", "], 'median')")


@query(fm_sql())
def fm_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.flajolet_martin(table(spark, d, "events"), F.floor(F.col("event_id") / 300).cast("long"), "user_id")


@query()
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.approx_count_distinct("user_id", 0.01).alias("n_users"))


RESERVOIR = "SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS priority FROM events ORDER BY priority, event_id LIMIT 100"


@query("SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT)")
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    return relational.bernoulli(table(spark, d, "events").select("event_id", "event_type"), "event_id", 0.2)


@query(RESERVOIR)
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return sketches.reservoir(table(spark, d, "events"), "event_id")


@query(RESERVOIR)
def stream_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_reservoir(streams.read_events(spark, d), "event_id")


@query(f"""WITH e AS (SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch, CAST(user_id AS VARCHAR) AS key FROM events),
k AS (SELECT DISTINCT batch, key FROM e), x AS (SELECT *, {folded(69997)} AS x FROM k), s AS (SELECT batch, key, unnest({HASHED}) AS bit FROM x),
a AS (SELECT bit, min(batch) AS set_at FROM s GROUP BY 1), f AS (SELECT key, min(batch) AS first FROM k GROUP BY 1),
r AS (SELECT s.batch, s.key, max(set_at) < s.batch AS seen, any_value(first) = s.batch AS new FROM s JOIN a USING (bit) JOIN f ON f.key = s.key GROUP BY 1, 2)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (seen) AS seen, count(*) FILTER (seen AND new) AS wrong FROM r GROUP BY batch""")
def stream_bloom(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_bloom(streams.read_events(spark, d), "user_id")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_windowed(streams.read_events(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# --- clustering ----------------------------------------------------------------

MOMENTS = """SELECT CAST(label AS BIGINT) AS cluster, CAST(i - 1 AS BIGINT) AS dim, count(*) AS n, sum(x) AS total, sum(x * x) AS squares
FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2"""


@query(f"SELECT cluster, dim, n, round(total, 4) AS total, round(squares, 4) AS squares FROM ({MOMENTS})")
def cluster_moments(spark: SparkSession, d: str) -> DataFrame:
    m = clustering.moments(table(spark, d, "embeddings"), "label", "embedding")
    return m.select(F.col("cluster").cast("long").alias("cluster"), F.col("dim").cast("long").alias("dim"), "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query(f"""WITH m AS (SELECT cluster, dim, total / n AS mean, sqrt(greatest(1e-9, squares / n - pow(total / n, 2))) AS sd FROM ({MOMENTS})),
v AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS d FROM embeddings),
g AS (SELECT vec_id, cluster, d, sqrt(sum(pow((x - mean) / sd, 2))) AS distance FROM v JOIN m USING (dim) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS place FROM g)
SELECT vec_id, CASE WHEN distance < 2 * sqrt(d) THEN cluster ELSE -1 END AS cluster, round(distance, 4) AS distance FROM b WHERE place = 1""")
def mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings")
    known = clustering.summaries(points, "label", "embedding")
    at = points.select("vec_id", F.size("embedding").alias("d"), clustering.nearest(known, "embedding").alias("at"))
    near = F.col("at.distance") < 2 * F.sqrt("d")
    return at.select("vec_id", F.when(near, F.col("at.cluster")).otherwise(-1).cast("long").alias("cluster"), F.round("at.distance", 4).alias("distance"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query()
def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bfr(vectors(spark, d), 10)[0]


@query()
def bfr_assign(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bfr(vectors(spark, d), 10)[1]
