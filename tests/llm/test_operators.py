"""Small cases of the training-data operators: nulls, empties, ties, and brute force."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import common, decontaminate, language_model, mixing, quality_model, quality_rules, simhash, substring, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t", "en", "a", 3, "x"), (None, "one two three four", "en", None, 18, "x"), (4, "same words here again", "en", "a", 21, "x"), (4, "same words here again", "en", "a", 21, "x"), (5, "long " * 30000, "en", "b", 150000, "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_rules_against_brute_force(real, edge):
    def brute(text):
        w = WORD.findall(text or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))

    for docs in (real, edge):
        got = quality_rules.statistics(docs.withColumn("written", F.col("text")), ["written"]).collect()
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.written) for r in got)
    judged = quality_rules.judge(edge).collect()
    assert len(judged) == len(EDGE) and not any(r.kept for r in judged if r.base_failed)
    assert quality_rules.judge(edge.limit(0)).count() == 0


def test_unigrams_against_brute_force(spark, real):
    docs = real.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    train = docs.where(common.fold("doc_id", 7) != 2)
    lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    rows = docs.collect()
    counts = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in lower(r.text))
    n, v = sum(counts.values()), len(counts)
    # Few known words, so that most counts come from the join.
    got = {r.doc_id: r for r in language_model.learn_and_score(docs, train, vocabulary=64, known=256, rounds=2).collect()}
    for r in rows:
        w = lower(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert g.score < 0
    assert sum(g.score for g in got.values()) > sum(g.base_score for g in got.values())


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, "a b a c a b d. " * 5 + f"w{i}") for i in range(40)], "doc_id long, text string")
    counts = language_model.counted(docs, language_model.np.concatenate)
    v = language_model.vocabulary_of(counts, vocabulary=64)
    model = language_model.fit(docs, v, rounds=3)
    np = language_model.np
    for context in (0, v.size * (v.classes + 1) + v.classes):
        p = 10 ** model.log10(np.full(v.size, context), np.arange(v.size))
        assert p.sum() == pytest.approx(1.0)


def test_language_model_grows():
    sizes = [language_model.vocabulary_for(10**k) for k in range(14)]
    assert sizes[0] == 4096 and sizes == sorted(sizes) and sizes[12] == 200_000 and sizes[13] > 2 * sizes[12]
    for n in sizes:
        assert 32 * n <= language_model.weights_for(n) <= 128 * n
    # A word of 1 / vocabulary of all tokens is a symbol, whatever `known` is given.
    words = [(64 * k, 10) for k in range(1, 100)]
    v = language_model.Vocabulary(1000, 100, [*words, (language_model.END, 10)], {0: (1000, 100)}, 100)
    assert v.head == 99 and v.most == 100
    assert not language_model.Vocabulary(1000, 100, words, {0: (1000, 100)}, 99).head


def test_language_model_without_training(edge):
    got = language_model.learn_and_score(edge, edge.limit(0), rounds=1).collect()
    assert len(got) == len(EDGE) and all(r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_mixing_meets_targets(real, edge):
    got = mixing.balance(real).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) <= max(20, 0.1 * r.g) and r.over <= 0 for r in got)
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.balance(real.repartition(n)).collect()) for n in (1, 3))
    assert a == b
    assert mixing.balance(edge).count() == len(EDGE) and mixing.balance(edge.limit(0)).count() == 0


def test_targets_reshare(spark):
    rows = [("a", 100, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 100, 1)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, n long"), (5, 2, 1), 1.5, 2).collect()}
    want, caps, weights, left, open_ = {}, {s: 2 * n for s, n, _ in rows}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 2200, set(x[0] for x in rows)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > caps[s]}
        if not full:
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
        open_ -= full
    want |= {s: weights[s] * level for s in open_}
    assert got == pytest.approx(want)


def test_decontamination_slots(spark, edge):
    q = "A train leaves Boston at 60 mph and after 3 hours it has covered how many miles says Anna to Anna and then 60 of them."
    moved = q.replace("Boston", "Paris").replace("60", "75").replace("Anna", "Zoe")
    opened = "Alice has 5 apples and gives 3 of them to Dave. How many are left?"
    rows = [(1, f"Noise here. {moved} more noise"), (2, q.replace("and then 60", "and then 61")), (3, q), (4, None), (5, ""), (6, q.lower()), (7, "so what is two plus two then")]
    rows += [(8, q.replace("it has", "it surely has")), (None, q), (None, "nothing of the kind"), (9, opened.replace("Alice", "Bob").replace("Dave", "Carol").replace("5", "7").replace("3", "2")), (10, "1 2 3 4 5 6 7 8 9 10"), (11, "11 12 13 14 15 16 17 18 19 20")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("hit_id", "hit_text", "nameless", "size", "marked", "pos")})
    bench = spark.createDataFrame([(1, q), (2, None), (3, "too short"), (None, q), (4, "What is two plus two?"), (5, opened), (6, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string").withColumn("extra", F.lit(1))
    # Numbers alone match by value only.
    want = [("1", 1, 2), ("10", 6, 0), ("3", 1, 0), ("6", 1, 0), ("7", 4, 1), ("8", 1, 0), ("9", 5, 0), ("None", 1, 0)]
    for most in (10**6, 0):  # broadcast, and shuffled
        assert sorted((str(r.doc_id), r.item_id, r.shift) for r in decontaminate.passages(docs, bench, broadcast_words=most).collect()) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["11", "2", "4", "5", "None"]
    assert decontaminate.passages(edge, bench).count() == 0
    for d, i in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.passages(d, i).count() == 0 and decontaminate.clean(d, i).count() == d.count()


def test_decontamination_against_brute_force(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text.lower().split() for r in bench.collect()}
    grams = {}
    for k, w in items.items():
        for i in range(len(w) - 7):
            grams.setdefault(" ".join(w[i : i + 8]), set()).add((k, i))
    want = set()
    for r in real.collect():
        w, hit = (r.text or "").lower().split(), {}
        for i in range(len(w) - 7):
            for k, at in grams.get(" ".join(w[i : i + 8]), ()):
                hit.setdefault(k, set()).update(range(at, at + 8))
        want |= {(r.doc_id, k) for k, v in hit.items() if len(v) >= 0.5 * len(items[k])}
    assert want and want == {(r.doc_id, r.item_id) for r in decontaminate.passages(real, bench).collect()}


def test_simhash_against_brute_force(spark, real, edge):
    def brute(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    docs = [(r.doc_id, r.text) for r in real.collect()] + [(10**6 + k, t[1]) for k, t in enumerate(EDGE[:6])]
    fps = {i: brute(t) for i, t in docs}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == root(i) for i in ids)
    assert simhash.near_duplicates(edge).count() == len(EDGE)


def test_dense_buckets_are_exact(spark, monkeypatch):
    rng = language_model.np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}

    def groups(links):
        of = {x: x for x in fps}
        for a, b in sorted(links) * 40:
            of[a] = of[b] = min(of[a], of[b])
        return of

    for dense in (10**6, 8):
        monkeypatch.setattr(simhash, "DENSE", dense)
        got = {(r.a, r.b) for r in simhash.link_exact(df, 2).collect()}
        assert groups(got) == groups(want)


def groups_of(ids, links):
    of = {x: x for x in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    return {x: root(x) for x in ids}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def families():
    """Sets by id: a chain, a star, copies with few changes, strangers that share many elements."""
    rng, sets = np.random.default_rng(5), {}
    row = list(range(400))
    for k in range(60):  # neighbours are alike, others less and less
        sets[len(sets)] = set(row[k * 3 : k * 3 + 40])
    base = list(range(1000, 1050))
    for k in range(80):  # alike to the centre, not to each other
        sets[len(sets)] = {*base[: 45], *range(10**6 + 6 * k, 10**6 + 6 * k + 5)} if k else set(base)
    for k in range(80):
        sets[len(sets)] = {*range(2000, 2100)} - {2000 + int(i) for i in rng.choice(100, 4, replace=False)}
    for k in range(80):
        sets[len(sets)] = {*range(3000, 3030), *range(2 * 10**6 + 40 * k, 2 * 10**6 + 40 * k + 20)}
    return sets


@pytest.mark.parametrize("dense", [1, 8, 10**6])
def test_links_in_a_bucket_are_exact(spark, dense):
    sets = families()
    want = groups_of(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert len(set(want.values())) > 80
    elements = common.materialize(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, elements array<int>"), "sets")
    tried = []

    def confirm(pairs):
        tried.append(pairs.count())
        return common.similar_sets(pairs, elements, 0.8)

    # One bucket holds all; three others some of them.
    buckets = elements.select(F.explode(F.array(F.lit(0).cast("long"), F.col("id") % 3 + 1)).alias("key"), "id", F.lit(True).alias("own"))
    split = lambda ids: common.prefixes(elements.join(ids, "id", "left_semi"), 0.8)
    got = {r.id: r.component for r in common.linked(common.materialize(buckets, "b"), confirm, None, split, dense).collect()}
    assert {k: got.get(k, k) for k in sets} == want
    if dense == 1:  # strangers don't meet all strangers
        assert sum(tried) < len(sets) ** 2 / 4


def test_copies_cost_one_pair_each(spark):
    n = 500
    sets = common.materialize(spark.range(n).select("id", F.array(*(F.lit(k) for k in range(9))).alias("elements")), "sets")
    tried = []

    def confirm(pairs):
        tried.append(pairs.count())
        return common.similar_sets(pairs, sets, 0.8)

    buckets = common.materialize(sets.select(F.explode(F.array(F.lit(1).cast("long"), F.col("id") % 5 + 2)).alias("key"), "id", F.lit(True).alias("own")), "b")
    assert {r.component for r in common.linked(buckets, confirm).collect()} == {0}
    assert sum(tried) <= 2 * n


def shingles_of(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_near_copies_against_brute_force(spark, real):
    rng = np.random.default_rng(2)
    docs = {r.doc_id: r.text for r in real.collect()}
    top = max(docs) + 1
    for i, text in list(docs.items())[:60]:  # scattered and block edits of any size
        w = (text or "").split()
        if len(w) > 40:
            v = list(w)
            for k in rng.choice(len(w), max(1, len(w) // 100), replace=False):
                v[k] = f"new{k}"
            docs[top + i] = " ".join(v)
            docs[2 * top + i] = " ".join(w[: 10] + [f"block{i}x{k}" for k in range(len(w) // int(rng.integers(5, 20)))] + w[10:])
    sets = {i: shingles_of(t) for i, t in docs.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and (sets[a] == sets[b] or jaccard(sets[a], sets[b]) >= 0.8)]
    want = groups_of(docs, pairs)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    least = set(want.values())
    assert len(docs) - len(least) > 80
    # Nothing goes that brute force keeps; of what should go at most one in fifty stays.
    assert least <= kept and len(kept - least) <= 0.02 * (len(docs) - len(least))


def test_one_near_copy_stays(spark):
    text = " ".join(f"word{i * 37 % 1000}" for i in range(200))
    near = text.replace("word37 ", "other ")
    rows = [(5, text), (3, near), (9, "quite another text about nothing at all"), (7, text), (11, None), (12, ""), (9, "quite another text about nothing at all"), (None, near), (9, "an other row of nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("stay", "row", "at", "id", "key", "n", "w", "component")})
    got = simhash.one_of_each(docs)
    assert sorted(r.doc_id for r in got.collect()) == [3, 9, 11] and got.columns == docs.columns
    assert simhash.one_of_each(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.where("doc_id = 3")).count() == 1


def test_repeats_are_cut(spark, edge):
    passage = " ".join(f"shared{i}" for i in range(80))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(60))
    rows = [(1, f"{own(1)}\n{passage}\n{own(2)}"), (2, f"{own(3)} {passage} {own(4)}"), (3, own(5)), (4, None), (None, f"{passage} {own(6)}"), (2, "another row of two"), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "sig", "cut", "first", "words")})
    spans = substring.repeats(docs)
    # To the true edges.
    assert sorted((r.doc_id, r["first"], r.words) for r in spans.collect()) == [(2, 60, 80), (7, 0, 80), (substring.NO_ID, 0, 80)]
    left = substring.remove(docs, spans)
    assert left.columns == docs.columns
    words = sorted((str(r.doc_id), (r.text or "").split()) for r in left.collect())
    assert words == sorted([("1", rows[0][1].split()), ("2", f"{own(3)} {own(4)}".split()), ("3", own(5).split()), ("4", []), ("None", own(6).split()), ("2", "another row of two".split())])
    assert substring.repeats(edge.limit(0)).count() == 0 and substring.remove(edge.limit(0), substring.repeats(edge.limit(0))).count() == 0
    assert {r.doc_id for r in substring.repeats(edge).collect()} == {5}  # a text of one word repeats itself


def test_repeats_against_brute_force(spark, real):
    docs = sorted((r.doc_id, r.text or "") for r in real.collect())
    seen, need, found = set(), {}, {}
    for i, text in docs:
        w = text.lower().split()
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            if run in seen:
                need.setdefault(i, set()).update(range(k, k + 50))
            seen.add(run)
    for r in substring.repeats(real).collect():
        found.setdefault(r.doc_id, set()).update(range(r["first"], r["first"] + r.words))
    assert need and sum(len(v & found.get(i, set())) for i, v in need.items()) >= 0.99 * sum(map(len, need.values()))
    # What more is found lies in documents with lines that are near copies, or where passages meet.
    assert sum(len(v - need.get(i, set())) for i, v in found.items()) <= 0.1 * sum(map(len, found.values()))


def test_similar_paragraphs_are_cut_whole(spark):
    line = [f"word{i}" for i in range(120)]
    near = [*line[:30], "changed", *line[31:90], "again", *line[91:]]
    half = [*line[:70], *(f"half{i}" for i in range(50))]
    docs = spark.createDataFrame([(k, f"words opening{k}\n{' '.join(x)}\nclosing{k} words") for k, x in enumerate((line, near, half))], "doc_id long, text string")
    got = sorted((r.doc_id, r["first"], r.words) for r in substring.repeats(docs).collect())
    assert got == [(1, 2, 120), (2, 2, 70)]


def toxic_corpus(spark, n=1200):
    rng = np.random.default_rng(4)
    calm, vile = [f"calm{k}" for k in range(60)], [f"vile{k}word" for k in range(8)]
    rows, labels = [], []
    for i in range(n):
        w = [calm[k] for k in rng.integers(0, 60, 80)]
        if i % 3 == 0:
            at = int(rng.integers(0, 60))
            w[at : at + 12] = [vile[k] if j % 3 else calm[k] for j, k in enumerate(rng.integers(0, 8, 12))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(n, ""), (n + 1, None), (n + 2, "\n \t"), (None, "calm1 calm2")]
    labels += [(n, 1), (n + 1, 0), (n + 2, 1), (None, 1), (1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learned(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.learn(docs, labels)
    assert all(k.startswith(b"vile") for k, v in model.words.items() if v > 0) and len(model.words) >= 8
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in range(1200)) and got[1200] == got[1201] < 0.7
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in range(1203) if i >= 1200 or i % 3] + ["None"])


@pytest.mark.parametrize("texts", [[("", 1), (None, 0)], [("a b", 0), ("", 1)], [("a b", 1)], [("", 0), ("a b c", 1)]])
def test_toxicity_without_words_of_both_kinds(spark, texts):
    model = toxicity.fit(spark.createDataFrame(texts, "text string, y int"))
    assert model.score([]) == sum(y for _, y in texts) / len(texts)


def test_segments_against_brute_force():
    def brute(scores, low, high):  # the best segment, then those on either side of it
        best = max(((sum(scores[a:b]), a - b, a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
        s, m, a = best
        return [] if s <= 0 else brute(scores, low, a) + [(a, a - m)] + brute(scores, a - m, high)

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        hits = [(i, float(rng.choice([0.37, 1.01, 2.03, 3.07])) + i * 1e-6) for i in range(n) if rng.random() < 0.4]
        scores = [-0.5003] * n
        for i, s in hits:
            scores[i] = s
        assert [x[:2] for x in toxicity.maximal(hits, -0.5003)] == brute(scores, 0, n)


def test_segments_are_linear():
    import time

    took = []
    for n in (50_000, 400_000):
        hits = [(3 * i, 1.0) for i in range(n)]
        began = time.process_time()
        assert len(toxicity.maximal(hits, -0.6)) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


def test_rate_and_passages(spark, edge):
    assert sum(n * math.exp(toxicity.solve_rate([(-0.5, 90), (2.0, 5)]) * s) for s, n in [(-0.5, 90), (2.0, 5)]) == pytest.approx(95)
    assert toxicity.solve_rate([(-0.5, 10)]) == 1.0 == toxicity.solve_rate([])
    model = toxicity.Model({b"vile%d" % k: 3.0 for k in range(9)}, {}, 5, -0.5)
    model.weights = [-2.0, 1.5, 1.0]
    calm = " ".join(f"calm{k}" for k in range(40))
    words = toxicity.plain(f"{calm} vile1, vile2 calm1 vile3 {calm}")
    assert model.segments(words) == [(40, 44, 8.5)]
    assert model.score(model.significant(words)) > 0.7 > model.score([])
    assert toxicity.score(edge, model, ["doc_id", "text", "score"][:2]).count() == len(EDGE)
    assert toxicity.fit(spark.createDataFrame([], "text string, y int")).score([]) == 0.0


def test_urls(spark):
    data = [(1, "http://Sub.EXAMPLE.com/en/7?x"), (2, "http://a.com/en/1"), (3, "https://x.net/de/"), (4, "http://example.net/de/88"), (5, "no scheme"), (6, None), (7, "http://h.org/Es/"), (7, "http://h.org/es/#f")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(data, "page_id long, url string")).collect()]
    assert {x[:4] for x in got} == {(1, "sub.example.com", "/en/7", "example.com/en/7"), (2, "a.com", "/en/1", "com/en/"), (3, "x.net", "/de/", "net/de/"), (4, "example.net", "/de/88", "example.net/de/8"), (5, "", "", None), (6, "", "", None), (7, "h.org", "/Es/", None), (7, "h.org", "/es/", "org/es/")}
    assert all(x[4] in ("allow", "block") for x in got)


def test_warc_round_trip(spark):
    big = "x" * 1500
    data = [(1, "u", big), (2, "u", big), (3, None, None), (4, "u\r\nWARC/1.0", "a WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n"), (5, "u", "é" * 700), (6, "u", ""), (7, "u", "WARC/1." * 400)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert len(got) == len(data) and all(r.verified for r in got.values())
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert all(r.payload_bytes == len((t or "").encode()) for (i, _, t) in data for r in [got[i]])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    real = warc.op10_warc(spark, SF).select(*names).collect()
    asked = con.execute(f"SELECT {', '.join(names)} FROM ({warc.ORACLE_SQL['op10_warc']})").fetchall()
    assert sorted(map(str, map(tuple, real))) == sorted(map(str, asked))


def test_warc_ties_and_hot_digests(spark, monkeypatch):
    big = "x" * 1500
    data = [(1, "u", big), (2, "u", big), (2, "u", big), (2, "v", big), (None, "u", big), (3, None, None), (4, "u", ""), (6, "a", "y" * 1200), (7, "a", "y" * 1200)]
    df = spark.createDataFrame(data, "id long, uri string, html string").withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    monkeypatch.setattr(warc, "HOT", 2)
    for most in (10**6, 0):  # broadcast, and dealt by digest and share
        got = [(str(r.id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_revisits(df, 1000, most).collect()]
        assert sorted(got, key=str) == sorted([("1", 1500, "revisit", 2), ("2", 1500, "response", None), ("2", 1500, "revisit", 2), ("2", 1500, "revisit", 2), ("None", 1500, "revisit", 2), ("3", 0, "response", None), ("4", 0, "response", None), ("6", 1200, "revisit", 7), ("7", 1200, "response", None)], key=str)
    pages = df.select(F.col("id").alias("page_id"), F.col("uri").alias("url"), "html").withColumn("row", F.lit(1))
    again = warc.round_trip(pages).collect()
    assert len(again) == len(data) and all(r.verified for r in again)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ftrl_against_plain_python():
    rng, rates = np.random.default_rng(1), quality_model.Rates()
    examples = [(np.unique(rng.integers(0, 30, 6)), None, int(rng.random() < 0.5)) for _ in range(80)]
    examples = [(i, rng.random(len(i)), y) for i, _, y in examples]
    z, n = [0.0] * 30, [0.0] * 30

    def weight(k):
        if abs(z[k]) <= rates.l1:
            return 0.0
        return -(z[k] - math.copysign(rates.l1, z[k])) / ((rates.beta + math.sqrt(n[k])) / rates.alpha + rates.l2)

    for i, x, y in examples * 2:
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in zip(i, x, strict=True))))
        for k, v in zip(i, x, strict=True):
            g, w = (p - y) * v, weight(k)
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / rates.alpha * w
            n[k] += g * g
    state = quality_model.ftrl(examples, np.zeros(30), np.zeros(30), rates)
    state = quality_model.ftrl(examples, *state, rates)  # a second round goes on from the first
    assert state[0] == pytest.approx(z) and state[1] == pytest.approx(n)
    assert rates.weights(*state) == pytest.approx([weight(k) for k in range(30)])


def test_quality_features_and_scores(spark, edge):
    i, x = quality_model.features("One two. one TWO!", 1 << 18)
    assert i[0] == 0 and x[0] == 1.0 and len(i) == len(x) == 1 + 3 + 3 + 4 + 3 + 1
    kinds = np.split(x[1:] ** 2, np.cumsum([3, 3, 4, 3]))
    assert [k.sum() for k in kinds] == pytest.approx([1.0] * 5)
    assert [len(v) for v in quality_model.features(None, 64)] == [1, 1]
    rows = [(k, ("fine words in a row " if k % 2 else "BUY NOW!!! $$$ ") * (k % 5 + 1), k % 2) for k in range(60)] + [(60, None, 1), (61, "", 0)]
    train = spark.createDataFrame(rows, "doc_id long, text string, y int")
    w = quality_model.fit(train)
    assert (w == quality_model.fit(train.repartition(3))).all()
    got = quality_model.score(train.withColumn("score", F.lit(2)), w, ["doc_id", "text", "y"])
    assert all((r.score > 0.5) == (r.y == 1) for r in got.collect() if r.doc_id < 60)
    assert quality_model.score(edge, w).count() == len(EDGE) and quality_model.score(edge.limit(0), w).count() == 0
    assert not quality_model.fit(train.limit(0)).any()


def test_determinant_against_numpy(spark):
    rng = np.random.default_rng(6)
    good = rng.normal(size=(300, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0.3, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]]) + [4, 1, 2, 3]
    bad = rng.normal(size=(60, 4)) * 0.2 + [9, -4, 7, 9]
    x = np.concatenate([good, bad])
    rows = common.materialize(spark.createDataFrame([("g", *map(float, r)) for r in x] + [("one", 1.0, 2.0, 3.0, 4.0)], "g string, x0 double, x1 double, x2 double, x3 double"), "vectors")
    got = {r.g: r for r in quality_rules.fit(rows).collect()}
    h, correction = 0.75, 0.75 / common.chi2_cdf(common.chi2_quantile(0.75, 4), 6)
    floor = np.diag(np.square(quality_rules.FLOOR))
    best = None
    for _ in range(60):  # many random starts
        keep = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            m, s = x[keep].mean(0), np.cov(x[keep].T, bias=True) * correction + floor
            d = ((x - m) @ np.linalg.inv(s) * (x - m)).sum(1)
            keep = np.argsort(d)[: math.ceil(h * len(x))]
        m, s = x[keep].mean(0), np.cov(x[keep].T, bias=True) * correction
        if best is None or np.linalg.slogdet(s + floor)[1] < best[0]:
            best = (np.linalg.slogdet(s + floor)[1], m, s)
    m = np.array([got["g"][f"m{i}"] for i in range(4)])
    s = np.array([[got["g"][f"s{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    # Distances are cut in bins, so a few rows more or less are kept.
    assert np.abs(m - best[1]).max() < 0.1 and np.abs(s - best[2]).max() < 0.15
    assert [got["one"][f"m{i}"] for i in range(4)] == [1.0, 2.0, 3.0, 4.0]


def test_small_groups_are_drawn_to_their_parents(spark):
    columns = ["n double", *(f"m{i} double" for i in range(4)), *(f"{x} double" for x in quality_rules.S)]
    own, above = [2.0, *([1.0] * 4), *([3.0] * 10)], [*([5.0] * 4), *([1.0] * 10)]
    df = spark.createDataFrame([own], ", ".join(columns)).withColumns({f"p{x}": F.lit(v) for x, v in zip(quality_rules.M + quality_rules.S, above, strict=True)})
    got = quality_rules.drawn(df, 2.0).first()
    assert got.m0 == 3.0 and got.s00 == 0.5 * 3 + 0.5 * 1 + 0.25 * 16
    docs = spark.createDataFrame([(k, f"word{k} " * 30, lang, src) for k in range(30) for lang, src in ((None, None), ("", "a"), ('{"level":1}', "b"))], "doc_id long, text string, lang string, source string")
    assert quality_rules.judge(docs).count() == 90


def test_trees_against_plain_python(spark):
    rng = np.random.default_rng(3)
    cells = {}
    for _ in range(400):
        b = tuple(int(v) for v in rng.integers(0, 4, 3))
        n, y = cells.get(b, (0, 0))
        cells[b] = (n + 1, y + int(rng.random() < (0.9 if b[0] > 1 and b[2] < 2 else 0.2)))
    rows = [(list(b), n, y) for b, (n, y) in cells.items()]
    model = urls.boost(spark.createDataFrame(rows, "bin array<int>, n long, y long"), n_trees=3, depth=2)

    def leaf(tree, b, k=1):
        while isinstance(tree.get(k), tuple):
            k = 2 * k + (b[tree[k][0]] > tree[k][1])
        return k

    total = {b: model.start for b in cells}
    for tree in model.trees:
        grad = {b: (y - n / (1 + math.exp(-total[b])), n / (1 + math.exp(-total[b])) / (1 + math.exp(total[b]))) for b, (n, y) in cells.items()}
        sums = lambda keep: tuple(sum(grad[b][i] for b in cells if keep(b)) for i in (0, 1))
        gain = lambda g, h: g * g / (h + 1.0)
        for k, split in tree.items():
            inside = lambda b, k=k: leaf({j: v for j, v in tree.items() if j < k}, b) == k
            if isinstance(split, tuple):
                whole = gain(*sums(inside))
                options = {(f, t): gain(*sums(lambda b: inside(b) and b[f] <= t)) + gain(*sums(lambda b: inside(b) and b[f] > t)) - whole for f in range(3) for t in range(3)}  # noqa: B023
                assert options[split] == pytest.approx(max(options.values()))
            else:
                g, h = sums(inside)
                assert split == pytest.approx(0.3 * g / (h + 1.0))
        total = {b: v + tree[leaf(tree, b)] for b, v in total.items()}
    got = spark.createDataFrame(rows, "bin array<int>, n long, y long").select("bin", model.margin().alias("m")).collect()
    assert {tuple(r.bin): r.m for r in got} == pytest.approx(total)


def test_url_rates_leave_out_the_own_fold(spark):
    rows = [("a", f, y) for f, ys in enumerate(((1, 1), (0, 0), (1, 0))) for y in ys]
    got = {(r.suffix, r.fold): r.suffix_rate for r in urls.rates(spark.createDataFrame(rows, "suffix string, fold int, y int"), "suffix", 2.0).collect()}
    assert got == pytest.approx({("a", 0): 2 / 6, ("a", 1): 4 / 6, ("a", 2): 3 / 6, ("a", -1): 4 / 8})


def test_url_trees_learn_what_rules_block(spark):
    data = [(k, f"http://{'shop' if k % 2 else 'blog'}{k}.{'com/en/' if k % 2 else 'net/de/'}{'9' * 20 if k % 2 else 'a'}") for k in range(200)]
    data += [(1000 + k, f"http://other{k}.info/{'9' * 20 if k % 2 else 'a'}") for k in range(20)] + [(2000, "http://x.info/" + "long/" * 20000), (None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string").withColumns({c: F.lit(1) for c in ("fold", "y", "bin", "n")})
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(data)
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k in range(200)) and all(got[1000 + k].verdict == ("block" if k % 2 else "allow") for k in range(20))
    assert urls.judge(pages.limit(0)).count() == 0 and {r.verdict for r in urls.judge(pages.where("page_id >= 1000")).collect()} == {"allow"}


def test_tilt_is_that_of_the_dual(spark, real):
    got = mixing.balance(real).collect()
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source and r["size"] > 0]
        mean = sum(r["size"] for r in rows) / sum(1 for r in got if r.source == source)
        slopes = [math.log(r.rate) / (r["size"] / mean) for r in rows if r.rate < 2]
        assert max(slopes, default=0) - min(slopes, default=0) < 1e-6
        assert sum(r.rate * r["size"] for r in rows) == pytest.approx(rows[0].target, rel=1e-6)


def test_mixing_with_clashing_names_and_many_sources(spark):
    rows = [(k, f"word{k} " * (k % 7), f"site{k % 97}" if k % 11 else None) for k in range(600)] + [(None, "a b c", "site1"), (5, "word5 " * 5, "site5")]
    names = ("copy", "row", "h", "size", "sid", "copies", "rate", "whole", "target", "n", "own_source", "ix")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "_copy"]
    words, want = Counter(), {r.source: r.taken for r in mixing.balance(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    for r in got.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r["copy"] == "copy" and r["_copy"] in (1, 2)
    assert {k: v for k, v in want.items() if v} == dict(words)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_names_and_storage(spark):
    assert common.unused(spark.range(1).withColumn("A", F.lit(1)), "a", "id", "a", "b") == ["_a", "_id", "__a", "b"]
    df = common.materialize(spark.range(3), "gone")
    path = df.settled_at
    common.discard(df, df, spark.range(1))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
