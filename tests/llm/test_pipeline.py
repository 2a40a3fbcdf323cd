"""The pipeline's stages and all of it, on a planted corpus and on edge tables."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases, and the labels and benchmark of the smallest tables."""
    path = tmp_path_factory.mktemp("corpus")
    prose = lambda k, n=120: " ".join(f"own{k}x{i}" for i in range(n))
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id")
    own = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200")
    vile = own.join(toxic, "doc_id").orderBy("doc_id").select(F.col("text")).first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = " ".join(f"shared{i}" for i in range(90))
    near = prose(1).replace("own1x60 ", "")
    rows = [(10**6, prose(1)), (10**6 + 1, prose(1)), (10**6 + 2, near), (10**6 + 3, f"{prose(2)} {passage} {prose(3)}"), (10**6 + 4, f"{prose(4)} {passage} {prose(5)}"), (10**6 + 5, f"{prose(6)} {item} {prose(7)}"), (10**6 + 6, prose(8)), (10**6 + 7, None), (10**6 + 8, ""), (None, prose(9))]
    planted = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in rows] + [(10**6 + 9, vile, "en", "planted", len(vile))], DOCS)
    own.select("doc_id", "text", "lang", "source", "n_chars").unionByName(planted).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path), vile


def test_stages_take_effect(spark, folder):
    path, vile = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        names = docs.columns
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/stage-{name}")
        docs = spark.read.parquet(f"{path}/stage-{name}")
        assert docs.columns == (names if name != "mixing" else [*names, "copy"])
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    of = lambda name: {k - 10**6 for k in seen[name] if k and k >= 10**6} | ({None} & seen[name].keys())
    assert 9 not in of("toxicity") and of("toxicity") == {*range(9), None}
    assert of("simhash") == {0, 3, 4, 5, 6, 7, None}  # 7 and 8 have no words
    assert seen["substring"][10**6 + 4].split() == [f"own4x{i}" for i in range(120)] + [f"own5x{i}" for i in range(120)] and "shared5" in seen["substring"][10**6 + 3]
    assert of("decontamination") == of("substring") - {5}
    assert not any(t == vile for t in seen["mixing"].values())
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_edge_tables(spark, folder):
    path = folder[0]
    long = "long text " * 20000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three", None, None, 3), (None, None, None, None, None), (4, "same", "en", "a", 4), (4, "same", "en", "a", 4), (4, "other", "en", "a", 5), (5, long, "en", "b", 10)]
    clash = {c: F.lit(1) for c in ("copy", "score", "id", "key", "own", "sig", "cut", "stay", "row", "size", "h", "text_", "component", "hit_id", "rate")}
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows, DOCS).withColumns(clash), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            extra = set(out.columns) - set(docs.columns)
            assert out.columns[: len(docs.columns)] == docs.columns and len(extra) == (name == "mixing")
            got = out.collect()
            assert len(got) <= 2 * docs.count()
            if name == "simhash" and docs.count():
                assert sorted(str(r.doc_id) for r in got) == ["1", "4", "5", "None"]
            if name in ("toxicity", "decontamination"):
                assert len(got) == docs.count()
