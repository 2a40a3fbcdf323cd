"""Worked fixtures of the core operators."""

import math
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quernstone.functions import scalars
from quernstone.operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from quernstone.plans import catalogue, interchange
from quernstone.sources import sinks, tables

SF = "/root/testdata/sf0.001"
RATHER_SLOW = {"gbt_grid_search", "girvan_newman", "bfr_rounds", "bfr_assign", "gbt_predict", "hybrid_predict", "label_propagation", "connected_components"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(x):
    return f"{x:.5g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql() | interchange.SQL) - RATHER_SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF)
    names = sorted(got.columns)
    asked = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in asked)


def test_word_count_trailing_space(spark):
    lines = spark.createDataFrame([("a b",), ("c c c ",)], "value string")
    assert rows(relational.word_count(lines)) == [("", 1), ("a", 1), ("b", 1), ("c", 3)]
    assert rows(relational.word_count(lines, keep_empty=False)) == [("a", 1), ("b", 1), ("c", 3)]


def test_frequent_itemsets_levels_and_fpgrowth(spark):
    data = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "a"), (4, "d"), (4, None)]
    pairs = itemsets.baskets(spark.createDataFrame(data, "k long, i string"), "k", "i")
    want = {(("a",), 3), (("b",), 3), (("c",), 2), (("a", "b"), 3), (("a", "c"), 2), (("b", "c"), 2), (("a", "b", "c"), 2)}
    level = {(tuple(r["items"]), r.n) for r in itemsets.frequent(pairs, 2).collect()}
    assert level == want == {(tuple(r["items"]), r.n) for r in itemsets.by_fpgrowth(pairs, 2).collect()}
    assert rows(sinks.itemset_report(itemsets.frequent(pairs, 3)))[0] == (1, "('a'),('b')")
    assert {(tuple(r["items"]), r.n) for r in itemsets.containing(itemsets.frequent(pairs, 2), pairs).collect()} == want
    assert itemsets.baskets(spark.createDataFrame(data, "k long, i string"), "k", "i", more_than=2).select("basket").distinct().count() == 2


def test_frequent_itemsets_go_on_until_a_level_is_empty(spark):
    data = [(k, i) for k in range(3) for i in "abcde"] + [(k, i) for k in range(3, 5) for i in "abcd"] + [(5, "a")]
    pairs = itemsets.baskets(spark.createDataFrame(data, "k long, i string"), "k", "i")
    sets = [set("abcde")] * 3 + [set("abcd")] * 2 + [{"a"}]
    for support in (3, 4):
        counts = {c: sum(s.issuperset(c) for s in sets) for k in range(1, 6) for c in combinations("abcde", k)}
        want = {(len(c), c, n) for c, n in counts.items() if n >= support}
        assert max(want)[0] == (5 if support == 3 else 4)
        assert {(r.size, tuple(r["items"]), r.n) for r in itemsets.frequent(pairs, support).collect()} == want


def test_item_cf_worked_example(spark):
    # The best known case: user 1's only positive neighbour of item 3 is item 2, rated 1.
    data = [(1, 1, 4.0), (1, 2, 1.0), (1, 4, 4.0), (2, 1, 2.0), (2, 2, 5.0), (2, 3, 5.0), (2, 4, 1.0), (3, 1, 5.0), (3, 2, 2.0), (3, 3, 1.0), (3, 4, 5.0)]
    ratings = recommend.ratings_of(spark.createDataFrame(data, "u long, i long, s double"), "u", "i", "s")
    wanted = spark.createDataFrame([(1, 3), (9, 3), (1, 9), (9, 9)], "user long, item long")
    got = {(r.user, r["item"]): r.prediction for r in recommend.predict_cf(ratings, wanted).collect()}
    assert got[1, 3] == pytest.approx(1.0)
    assert got[9, 3] == pytest.approx(3.0) and got[1, 9] == pytest.approx(3.0) and got[9, 9] == 3.5
    w = {(r.i, r.j): r.w for r in recommend.pearson(spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0)], "user long, item long, r double")).collect()}
    assert w[1, 2] == 0.7


TEXTBOOK = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("D", "E"), ("D", "F"), ("D", "G"), ("E", "F"), ("F", "G")]


def test_betweenness_and_communities(spark):
    edges = spark.createDataFrame(TEXTBOOK, "src string, dst string")
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges).collect()}
    assert got == pytest.approx({("B", "D"): 12, ("A", "B"): 5, ("B", "C"): 5, ("D", "E"): 4.5, ("D", "G"): 4.5, ("D", "F"): 4, ("E", "F"): 1.5, ("F", "G"): 1.5, ("A", "C"): 1})
    labels = graph.girvan_newman(edges)
    assert [r.members for r in graph.members(labels, "component").collect()] == [["A", "B", "C"], ["D", "E", "F", "G"]]
    assert {r.component for r in graph.components(edges).collect()} == {"A"}
    assert sinks.community_report(graph.members(labels, "component")).first().line == "'A', 'B', 'C'"
    assert sinks.edge_report(graph.edge_betweenness(edges)).first().line == "('B', 'D'),12.0"


def test_betweenness_by_joins(spark):
    edges = spark.createDataFrame([*TEXTBOOK, ("X", "Y"), ("Y", "Z")], "src string, dst string")
    by = lambda df: {(r.src, r.dst): r.betweenness for r in df.collect()}
    assert by(graph.betweenness_by_joins(edges)) == pytest.approx(by(graph.edge_betweenness(edges)))
    assert graph.betweenness_by_joins(edges.limit(0)).count() == 0


def test_missing_predictions_are_zero(spark):
    truth = spark.createDataFrame([(1, 1, 4.0), (1, 2, 3.0)], "user long, item long, stars double")
    got = relational.with_default(truth, spark.createDataFrame([(1, 1, 4.0)], "user long, item long, prediction double"), ["user", "item"], "prediction")
    assert relational.rmse(got, "stars", "prediction").first().rmse == pytest.approx((9 / 2) ** 0.5)


def test_samples(spark):
    df = spark.range(20000).select((F.col("id") + 2 * 10**15).alias("id"))
    assert abs(relational.bernoulli(df, "id", 0.2).count() - 4000) < 300
    got = [r.id for r in sketches.reservoir(df, "id", 1000).collect()]
    assert len(set(got)) == 1000 and abs(sum(got) / 1000 - 2 * 10**15 - 10000) < 1000
    assert got == [r.id for r in sketches.reservoir(df.repartition(5), "id", 1000).collect()]


def test_lists_without_values(spark):
    df = spark.createDataFrame([("",), ("none",), ("None",), (None,), ("a",), ("a, b",)], "c string")
    assert [r[0] for r in df.select(scalars.n_listed("c")).collect()] == [0, 0, 0, 0, 1, 2]


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u"}\n{"user_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.json_lines(spark, str(tmp_path / "r.json"), tables.REVIEW).collect()


def test_modularity_of_the_textbook_split(spark):
    edges = spark.createDataFrame(TEXTBOOK, "src string, dst string")
    cut = edges.where("not (src = 'B' and dst = 'D')")
    assert graph.modularity(edges, graph.components(cut), cut) == pytest.approx(0.4691, abs=1e-4)


def test_co_edges(spark):
    data = [("u1", "b1"), ("u1", "b2"), ("u1", "b3"), ("u2", "b2"), ("u2", "b3"), ("u3", "b1"), ("u3", "b2")]
    df = spark.createDataFrame(data, "u string, b string")
    assert {(r.src, r.dst) for r in graph.co_edges(df, "u", "b", 2).collect()} == {("u1", "u2"), ("u1", "u3")}
    assert graph.co_edges(df, "u", "b", 3).count() == 0
    with pytest.raises(ValueError):
        graph.co_edges(df, "u", "b", 0)


def test_sketch_arithmetic(spark):
    assert scalars.n_hashes(69997, 100, 50) == 9 and scalars.n_hashes(10, 100, 50) == 1
    series = {r.batch: r.fpr for r in sketches.bloom_series(spark).collect()}
    assert (series[17], series[24], series[33], series[49]) == (0.000001, 0.000009, 0.000088, 0.001213)
    one = spark.range(1)
    zeros = [one.select(scalars.trailing_zeros(F.lit(x))).first()[0] for x in (0, 7, 8, 12)]
    assert zeros == [1, 0, 3, 2]
    assert one.select(scalars.bytes_mod(F.lit("ab"), 6999)).first()[0] == 3933
    assert one.select(scalars.bytes_mod(F.lit(""), 6999)).first()[0] == 0
    assert one.select(scalars.bytes_mod(F.lit("é"), 6999)).first()[0] == int("é".encode().hex(), 16) % 6999


def test_bfr_sets_and_purity(spark):
    points = [(i, [float(10 * (i % 4)) + (i * 7 % 5) / 10, float(20 * (i % 4 // 2)) + (i * 3 % 7) / 10]) for i in range(200)]
    points += [(200 + i, [500.0 + i / 10, 500.0]) for i in range(2)] + [(299, [-900.0, 400.0])]
    df = spark.createDataFrame(points, "id long, features array<double>")
    rounds, assigned = clustering.bfr(df, 4, batches=2)
    last = rounds.orderBy(F.desc("round")).first()
    assert last.n_ds + last.n_cs + last.n_rs == len(points)
    got = {r.id: r.cluster for r in assigned.collect()}
    assert len(got) == len(points) and got[299] == -1


def test_jaccard_is_exact(spark):
    sets = {1: "abcdef", 2: "abcdeg", 3: "xyz", 4: "xyz", 5: "abc", 6: "q"}
    df = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "id long, element string")
    want = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in sets for b in sets if a < b}
    got = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(df, 0.5).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5})


def test_sources_and_features(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"TRANSACTION_DT","CUSTOMER_ID","AGE_GROUP","PIN_CODE","PRODUCT_SUBCLASS","PRODUCT_ID","AMOUNT","ASSET","SALES_PRICE"\n"11/1/2000","01741797","","Unknown","1","078895770025","1","2","3"\n')
    got = tables.transactions(tables.csv_rows(spark, str(tmp_path / "t.csv"), tables.TRANSACTION)).first()
    assert tuple(got) == ("11/1/2000-1741797", 78895770025)
    (tmp_path / "r.json").write_text('{"user_id": "u", "stars": 4.0, "date": "2018-01-01"}\n')
    assert tables.json_lines(spark, str(tmp_path / "r.json"), tables.REVIEW).first().stars == 4.0
    (tmp_path / "p.csv").write_text("0,1,0.5,1.5\n")
    assert tables.points(spark, str(tmp_path / "p.csv"), 2).first().features == [0.5, 1.5]
    df = spark.createDataFrame([({"A": "True", "B": "{'x': True, 'y': False}", "C": "no"}, "None", "a, b")], "m map<string,string>, f string, c string")
    assert tuple(df.select(scalars.n_true("m"), scalars.n_keys("m"), scalars.n_listed("f"), scalars.n_listed("c")).first()) == (2, 3, 0, 2)
    sinks.write_csv(spark.createDataFrame([("x", 2.25)], "k string, v double"), str(tmp_path / "out"), 1)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().v in ("2.3", "2.2")


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in "dbacab"], "k string")
    assert rows(relational.dense_index(df, "k")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_label_propagation_joins_cliques(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10)]
    labels = {r.id: r.label for r in graph.label_propagation(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({labels[k] for k in (0, 1, 2)}) == 1 and len({labels[k] for k in (11, 12, 13)}) == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["city", "average"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert math.isfinite(__spark_entry__.entry(spark).first().average)


def test_overlaps_by_prefixes_and_by_bitmaps(spark, monkeypatch):
    """equal, near and unlike sets, hot elements dealt to blocks, on both ways."""
    monkeypatch.setattr(similarity, "BLOCK", 20)
    sets = {i: frozenset((i * i * k + 7 * k + i) % 60 for k in range(1, 3 + i % 9)) for i in range(90)}
    sets |= {i: sets[i - 90] if i % 2 else sets[i - 90] | {99} for i in range(90, 130)}
    df = spark.createDataFrame([(i, f"e{x}") for i, s in sets.items() for x in s], "id long, element string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {k: v for k, v in want.items() if v >= 0.5}
    for bits in (0, 512):
        got = [((r.a, r.b), r.sim) for r in similarity.jaccard_pairs(df, 0.5, bits).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_shingles_of_an_id_that_comes_twice(spark):
    """lists are made without a shuffle, but rows of one id are still one set."""
    docs = spark.createDataFrame([(1, "a b c d"), (1, "b c d e"), (2, "A b  c d e"), (3, None), (4, "x y")], "doc_id long, text string")
    lists = similarity.once_an_id(similarity.shingle_lists(docs))
    assert {r.id: sorted(r.s) for r in lists.collect()} == {1: ["a b c", "b c d", "c d e"], 2: ["a b c", "b c d", "c d e"]}


def test_signatures_shuffle_numbers(spark):
    """keys are numbered as by dense_index; least hashes aren't half made before the shuffle by id."""
    df = spark.createDataFrame([(i, f"k{(i * j * j) % 23}") for i in range(20) for j in range(5)], "id long, element string").distinct()
    indexed, m = relational.numbered(df, "element", "id")
    assert rows(indexed) == rows(df.join(relational.dense_index(df, "element"), "element").select("id", "ix")) and m == df.select("element").distinct().count()
    plan = similarity.minhash(indexed, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") < plan.index("hashpartitioning(id")


def test_lsh_pairs_of_equal_signatures(spark):
    """ids of equal signatures are paired among themselves and with all that agree with one of them."""
    data = [(1, 1, 2, 3, 4), (2, 1, 2, 3, 4), (3, 1, 2, 9, 9), (4, 0, 0, 3, 4), (5, 1, 0, 3, 0)]
    signed = spark.createDataFrame(data, "id long, h0 long, h1 long, h2 long, h3 long")
    assert rows(similarity.lsh_pairs(signed, 2, 2)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
    pairs = spark.createDataFrame([(1, 2), (1, 5), (3, 4), (2, 4)], "a long, b long")
    assert rows(similarity.agreeing(pairs, signed, 2, 2)) == [(1, 2), (2, 4)]


def test_betweenness_makes_its_edges_once(spark):
    """F8: the count, the driver and the roots read what was written down."""
    made = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame(TEXTBOOK, "src string, dst string").mapInArrow(each, "src string, dst string")
    assert graph.edge_betweenness(edges).count() == made.value == len(TEXTBOOK)


def test_json_of_several_tasks(spark, tmp_path):
    """each partition writes its own file."""
    sinks.write_json(spark.range(100).repartition(3), str(tmp_path / "j"))
    assert len(list((tmp_path / "j").glob("part-*"))) == 3 and spark.read.json(str(tmp_path / "j")).count() == 100


def test_fpgrowth_of_weighed_baskets(spark):
    """equal baskets are mined as one, with the counts of all."""
    sets = ["abcde", "abc", "abc", "abcde", "ad", "bce", "e", "abde"]
    pairs = spark.createDataFrame([(k, c) for k, s in enumerate(sets) for c in s + s[0]] + [(0, None)], "basket long, item string")
    baskets = itemsets.weighed(pairs)
    assert {"".join(r["items"]): r.n for r in baskets.collect()} == {"abcde": 2, "abc": 2, "ad": 1, "bce": 1, "e": 1, "abde": 1}
    for support in (2, 3, 4):
        counts = {c: sum(set(s).issuperset(c) for s in sets) for k in range(1, 6) for c in combinations("abcde", k)}
        assert {(tuple(r["items"]), r.n) for r in itemsets.weighed_fpgrowth(baskets, support).collect()} == {x for x in counts.items() if x[1] >= support}


def test_meetings_shuffle_rows_once(spark, monkeypatch):
    """every pair of a key's rows once, hot keys in blocks; both sides of the others are one shuffle."""
    data = [(i, f"k{i % 7}" if i < 60 else "hot") for i in range(120)]
    df = spark.createDataFrame(data, "id long, element string")
    want = sorted((a, b) for (a, x), (b, y) in combinations(data, 2) if x == y)
    for block in (8192, 20):
        monkeypatch.setattr(similarity, "BLOCK", block)
        met = similarity.meetings(df, "element")
        assert rows(met.select(F.least("x.id", "y.id"), F.greatest("x.id", "y.id"))) == want
    monkeypatch.setattr(similarity, "BLOCK", 8192)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = similarity.meetings(df, "element")
        met.collect()
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_of_few_elements_are_broadcast(spark, monkeypatch):
    """the sets aren't shuffled by element where the elements are few, and the counts are the same."""
    lists = spark.createDataFrame([(i, 3, [i % 5, 100 + i % 3, 200 + i]) for i in range(20)], "id long, n long, s array<long>")
    few = similarity.with_counts(lists, True)
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similarity, "COUNTED", 2)
    assert rows(few) == rows(similarity.with_counts(lists, True)) == rows(similarity.with_counts(lists, False)) != []


def tables_left(spark, made):
    """How many tables are left in the shared folder besides those that were there."""
    import os

    folder = f"{sinks.shared_dir(spark)}/quernstone".removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = made()
    return found, len(set(os.listdir(folder)) - before)


def test_components_keep_one_table(spark):
    """what a round doesn't need any more is deleted, so disk doesn't grow with the rounds."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)], "src long, dst long")
    labels, left = tables_left(spark, lambda: graph.components(edges))
    assert rows(labels) == [(k, 0) for k in range(41)] + [(90, 90), (95, 90), (100, 90)] and left == 1


def test_lsh_pairs_come_from_their_first_band(spark, monkeypatch):
    """each pair once without a distinct over pairs; hot bands in blocks, large classes in lists."""
    signed = {i: (i % 3, i % 2, i % 5, i % 4, 0 if i < 40 else i, 1) for i in range(60)} | {i: (7, 7, 7, 7, 7, 7) for i in range(60, 75)}
    df = spark.createDataFrame([(i, *s) for i, s in signed.items()], "id long, h0 long, h1 long, h2 long, h3 long, h4 long, h5 long")
    agree = lambda x, y: any(x[k : k + 2] == y[k : k + 2] for k in (0, 2, 4))
    want = [(a, b) for a, b in combinations(sorted(signed), 2) if agree(signed[a], signed[b])]
    for block, listed in ((8192, 1024), (16, 4)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "LISTED", listed)
        pairs = similarity.lsh_pairs(df, 3, 2)
        assert rows(pairs) == want
        assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_label_propagation_keeps_one_table(spark):
    """links and the labels of past rounds are deleted; without a round labels are still read."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    labels, left = tables_left(spark, lambda: graph.label_propagation(edges, 3))
    assert [r.id for r in labels.orderBy("id").collect()] == [1, 2, 3, 4] and left == 1
    assert rows(graph.label_propagation(edges, 0)) == [(k, k) for k in (1, 2, 3, 4)]


def test_girvan_newman_leaves_no_tables(spark):
    """what a round has read is deleted when its edges are on the driver."""
    edges = spark.createDataFrame(TEXTBOOK, "src string, dst string")
    labels, left = tables_left(spark, lambda: graph.girvan_newman(edges))
    assert rows(labels) == [(v, "A" if v in "ABC" else "D") for v in "ABCDEFG"] and left == 0
