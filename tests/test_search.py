import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions import vectors as vx
from loam.operators import diversify, lexical, search

SCHEMA = "query_id int, score double, rel_path string, chunk_index int, chunk_id string"


def hits(spark, scores, paths=None):
    return spark.createDataFrame([(1, float(s), (paths or "abcdefgh")[i], i, str(i)) for i, s in enumerate(scores)], SCHEMA)


@pytest.mark.parametrize(
    ("scores", "alpha", "delta", "kept"),
    [
        ([1, 0.95, 0.9, 0.7, 0.4], 0.92, 0, [1, 0.95]),
        ([0.8, 0.78, 0.74, 0.5], 0, 0.05, [0.8, 0.78]),
        ([1, 0.961, 0.93, 0.5], 0.94, 0.04, [1, 0.961]),
        ([0.5], 0.9, 0.1, [0.5]),
        ([0.6, 0.6, 0.6], 0.9, 0.1, [0.6, 0.6, 0.6]),
        ([-0.5, -0.6], 0.9, 0, [-0.5]),
    ],
)
def test_threshold(spark, scores, alpha, delta, kept):
    got = search.threshold(hits(spark, scores), alpha, delta).orderBy(F.desc("score")).collect()
    assert [r["score"] for r in got] == kept


def test_threshold_of_nothing(spark):
    assert search.threshold(spark.createDataFrame([], SCHEMA), 0.9, 0.1).count() == 0


def test_ranking_is_total(spark):
    df = spark.createDataFrame([(1, 0.8, "z", 1, "x"), (1, 0.9, "a", 2, "y"), (1, 0.9, "a", 0, "z")], SCHEMA)
    got = search.ranked(df).orderBy("rank").collect()
    assert [(r["rel_path"], r["chunk_index"]) for r in got] == [("a", 0), ("a", 2), ("z", 1)]


def test_unique_keeps_the_best_of_a_file(spark):
    got = search.unique(hits(spark, [1, 0.9, 0.85], "aab")).orderBy("rel_path").collect()
    assert [(r["rel_path"], r["score"]) for r in got] == [("a", 1.0), ("b", 0.85)]


@pytest.mark.parametrize(("limit", "window", "want"), [(3, 0, 20), (5, 50, 50), (5, 2, 5), (10, 0, 50)])
def test_window(limit, window, want):
    assert search.Options(limit=limit, window=window).normalized().window == want


def test_options_defaults():
    o = search.Options().normalized()
    assert (o.alpha, o.delta, o.mmr_lambda) == (0.85, 0.1, 0.5)
    off = search.Options(alpha=-1, delta=-1, mmr_lambda=-1).normalized()
    assert (off.alpha, off.delta, off.mmr_lambda) == (0, 0, 1)
    with pytest.raises(ValueError):
        search.Options(rerank="other").normalized()


@pytest.mark.parametrize(("w", "want"), [(0.25, 0.75), (0, 1.0), (0.5, 0.5), (1, 0.0)])
def test_fusion(spark, w, want):
    df = spark.createDataFrame([(1.0, 0.0)], "c double, t double")
    assert df.select(vx.fused(F.col("c"), F.col("t"), w)).first()[0] == pytest.approx(want)


def test_cosine_of_odd_vectors_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 0]


def test_mmr():
    x = np.array([[1, 0], [0.9, -0.1], [0, 1]], float)
    q = np.array([1, 0.3])
    rel = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    assert diversify.select(rel, x, 2, 0.5) == [0, 2]
    assert diversify.select(rel, x, 3, 1.0) == [0, 1, 2]
    y = np.array([[1, 0], [0.95, 0.05], [0, 1]], float)
    assert diversify.select(y @ [1, 0] / np.linalg.norm(y, axis=1), y, 3, 0.0) == [0, 2, 1]


def test_bm25(spark):
    df = spark.createDataFrame([(0.99, "generic.md", ["t"], "some other words"), (0.90, "target.md", ["t"], "bm25 rerank")], "score double, rel_path string, tags array<string>, content string")
    df = df.withColumns({"chunk_index": F.lit(0), "chunk_id": F.col("rel_path")})
    got = search.ranked(lexical.rerank(df, "bm25 rerank")).orderBy("rank").collect()
    assert [r["rel_path"] for r in got] == ["target.md", "generic.md"]
    assert got[1]["bm25_score"] == 0 and got[1]["score"] == pytest.approx(0.7)
    assert [r["score"] for r in lexical.rerank(df, "!!!").orderBy("rel_path").collect()] == [0.99, 0.90]


def test_tokens(spark):
    df = spark.createDataFrame([("搜图 BM25, a_b É1",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["搜", "图", "bm25", "a_b", "é1"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("DOCS\\NESTED", "docs/nested"), ("./a/./b//c/", "a/b/c"), ("/a/../../b", "/b"), (".", ""), ("a/..", ""), ("../a", "../a"), ("C:/X/y", "c:/x/y"), ("  /A/b ", "/A/b")],
)
def test_paths(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(tx.normalize_path(F.col("p"))).first()[0] == want


def test_semantic_tags(spark):
    raw = [" Go ", "go", "图像", "http://x.y", "a\tb", "123", "!!", "x", "y" * 40, "ok"]
    df = spark.createDataFrame([(raw,)], "t array<string>")
    assert df.select(tx.normalize_semantic_tags(F.col("t"))).first()[0] == ["go", "图像", "ok"]
    assert df.select(tx.normalize_semantic_tags(F.col("t"), most=1)).first()[0] == ["go"]


def test_batch_equals_single(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = e.where("vec_id in (3, 40)").select(F.col("vec_id").alias("query_id"), "vector")
    whole = search.batch_topk(e, q, 5).collect()
    parts = search.batch_topk(e.repartition(7), q, 5, most_queries=1, block_bytes=64).collect()
    key = lambda r: (r["query_id"], r["rank"])
    assert [(r["query_id"], r["vec_id"]) for r in sorted(whole, key=key)] == [(r["query_id"], r["vec_id"]) for r in sorted(parts, key=key)]
    assert search.batch_topk(e.limit(0), q, 5).count() == 0 and search.batch_topk(e, q.limit(0), 5).count() == 0


def test_tsv_lines(spark):
    df = spark.createDataFrame([("a\tb\nc", "d\u0000e\tf\n")], "x string, y string")
    assert df.select(tx.tsv_line([F.col("x"), F.col("x")])).first()[0] == "a b c\ta b c"
    assert df.select(tx.tsv_record([F.col("y")])).first()[0] == "de f\n\u0000"


def test_batch_scores_odd_vectors_zero_and_keeps_ties(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 0.0, 0.0, 9.0]), (7, []), (8, [-1.0, 0.0]), (9, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    q = spark.createDataFrame([(100, [2.0, 0.0])], "query_id long, vector array<double>")
    for how in ({}, {"block_bytes": 8}):
        got = {r["vec_id"]: (r["rank"], r["score"]) for r in search.batch_topk(e.repartition(1), q, 8, **how).collect()}
        assert got == {1: (1, 1.0), 2: (2, 1.0), 9: (3, 1.0), 3: (4, 0.0), 4: (5, 0.0), 5: (6, 0.0), 6: (7, 0.0), 7: (8, 0.0)}
        assert [r["vec_id"] for r in search.batch_topk(e, q, 2, **how).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.batch_topk(e, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id long, vector array<double>"), 2)


def test_mmr_beyond_one_group_picks_the_same(spark):
    rng = np.random.RandomState(4)
    rows = [(float(s), f"p{i % 7}", i, str(i), v.tolist()) for i, (s, v) in enumerate(zip(rng.random_sample(60), rng.standard_normal((60, 6)), strict=True))]
    df = spark.createDataFrame(rows, "score double, rel_path string, chunk_index int, chunk_id string, vector array<double>")
    q = rng.standard_normal(6).tolist()
    picks = [[r["chunk_id"] for r in diversify.mmr(df, q, 9, lam, most=most).orderBy("rank").collect()] for lam in (0.5, 0.2) for most in (100, 10)]
    assert picks[0] == picks[1] and picks[2] == picks[3] and len(picks[0]) == 9


def test_flags_agree_with_the_stages(spark):
    o = search.Options(limit=1, alpha=0.8, delta=0.2).normalized()
    df = hits(spark, [1, 0.9, 0.85, 0.5], "abad").withColumn("collection_id", F.lit("c"))
    marked = search.windowed(df, o)
    assert search.explain(marked, o).first().asDict() == {"scopes": 1, "top_score": 1.0, "retrieved": 4, "after_threshold": 3, "after_unique": 2, "final": 1}
    want = search.unique(search.threshold(df, o.alpha, o.delta))
    assert sorted(r["chunk_id"] for r in marked.where("single").collect()) == sorted(r["chunk_id"] for r in want.collect())


def test_tokens_of_capitals_with_dots(spark):
    assert spark.createDataFrame([("İstanbul IŞIK",)], "t string").select(tx.tokens(F.col("t"))).first()[0] == ["istanbul", "işik"]
