import pytest
from compare import database, same

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loam.llm import decontamination, mixing, ngram_join, queries, toxicity  # noqa: E402
from loam.llm.common import stored  # noqa: E402

AT = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark):
    same(queries.QUERIES[name](spark, AT), database(AT), queries.ORACLES[name])


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    steps = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{AT}/labels.parquet"), toxicity.held_out)
    calm = stored(steps["toxicity"](spark, docs, AT), "t1")
    assert calm.columns == docs.columns
    assert ids(calm) == {r[0] for r in toxicity.score(docs, model).where("score < 0.5").select("doc_id").collect()}
    single = stored(steps["ngram_jaccard_join"](spark, calm, AT), "t2")
    assert ids(single) == {r[0] for r in ngram_join.jaccard_classes(calm).where("kept").select("doc_id").collect()}
    clean = stored(steps["decontamination"](spark, single, AT), "t3")
    hit = ids(decontamination.contaminated(single, spark.read.parquet(f"{AT}/benchmark.parquet")))
    assert hit and ids(clean) == ids(single) - hit
    mixed = stored(steps["mix_sources"](spark, clean, AT), "t4")
    sized = mixing.sizes(clean)
    copies = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(sized).collect() if r["copies"]}
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == copies
    assert mixed.columns == docs.columns
    ordered = steps["token_output"](spark, mixed, AT).select("slot", "doc_ids").collect()
    assert sorted(r["slot"] for r in ordered) == list(range(len(ordered)))
    assert {i for r in ordered for i in r["doc_ids"]} == set(copies)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, AT)
        assert got.count() == 0, name


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids, repeated ids, null, empty and very long texts, and columns of names that stages might use themselves."""
    docs = spark.read.parquet(f"{AT}/documents.parquet").limit(60).drop("n_chars")
    item = spark.read.parquet(f"{AT}/benchmark.parquet").first()["text"]
    long = "lorem ipsum dolor " * 40_000
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    odd = [(None, f"first {item} last", "en", "src1"), (None, near, "en", "src1"), (None, near + "!", "en", "src2"), (5, near.upper(), "en", "src2"), (5, "something else that is here", "en", None), (None, None, None, None), (None, "", "en", "src1"), (None, long, "en", "src3")]
    rows = docs.union(spark.createDataFrame(odd, docs.schema))
    extra = ["score", "__score", "__id", "kept", "row_file", "row_place", "copies", "h", "item_id", "source_size"]
    for k, c in enumerate(extra):
        rows = rows.selectExpr("*", f"{k} AS {c}")
    rows = stored(rows, "odd")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, AT)
        assert out.columns == rows.columns, name
        rows = stored(out, name)
        texts[name] = [r["text"] for r in rows.select("text").collect()]
        assert rows.where(" or ".join(f"{c} <> {k}" for k, c in enumerate(extra))).count() == 0
    assert sum((t or "").lower().startswith("one two three") for t in texts["ngram_jaccard_join"]) == 1
    assert long in texts["ngram_jaccard_join"] and None in texts["toxicity"] and "" in texts["decontamination"]
    assert any(item in (t or "") for t in texts["ngram_jaccard_join"]) and not any(item in (t or "") for t in texts["decontamination"])
    assert "something else that is here" in texts["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, rows, AT)
    assert last.count() > 0
