import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from loam.llm import lexical_search as ls
from loam.llm.common import stored

DOCS = "doc_id long, text string, score string, item long, block string"
ITEMS = "item_id long, text string, doc_id long"


def against_sql(spark, docs: list[tuple], items: list[tuple], **options) -> int:
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([i[0] for i in items], pa.int64()), "text": pa.array([i[1] for i in items], pa.string())}))
    want = con.execute(ls.ORACLE).fetchall()
    made = spark.createDataFrame([(*d, "s", 1, "b") for d in docs], DOCS).repartition(3)
    got = ls.search(made, spark.createDataFrame([(*i, 9) for i in items], ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(got)


def corpus(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "klmnprst" for b in "aeiou"] + ["İz", "Straße", "naïve", "ÉTÉ", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 40]))) + rng.choice(["", ".", "\n", " X9_y"])) for i in range(n)]


def test_equal_to_sql_over_many_shards_and_blocks(spark, monkeypatch):
    docs = corpus(400)
    items = [(k, t) for k, t in corpus(30, seed=2)] + [(7, "ka KA ka, ke"), (7, "ka KA ka, ke"), (90, "unheard-of"), (91, None), (92, " .,;"), (None, "日本 x9")]
    assert against_sql(spark, docs, items) > 250
    monkeypatch.setattr(ls, "BLOCK", 4)
    against_sql(spark, docs, items, most_terms=300, block_items=5)


def test_ties_repeated_rows_and_nulls(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(5, "same words here")] * 3 + [(99, None), (98, ""), (97, "?! ..")]
    against_sql(spark, docs, [(1, "same here"), (2, "words words")])
    # null ids come last among equals
    made = spark.createDataFrame([(None, "one two", "", 0, "")] * 3 + [(4, "one two", "", 0, "")] * 2, DOCS)
    got = ls.search(made, spark.createDataFrame([(1, "two", 0)], ITEMS)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [4, 4, None, None, None] and [r.rank for r in got] == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", 0, "")], DOCS), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert ls.search(none, items).count() == 0
    assert ls.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert ls.search(docs, items).count() == 1


def shard_of(lists: dict[str, list[tuple[int, int]]], lengths: list[int]) -> dict:
    names = list(lists)
    triples = [(d, names.index(t), n) for t, found in lists.items() for d, n in found]
    doc, term, tf = (np.array(x) for x in zip(*triples, strict=True))
    s = ls.make_shard(doc, term, tf, pa.array(names), np.array(lengths), len(lengths), sum(lengths))
    return {k: np.asarray(v) if not isinstance(v, (bytes, pa.Array)) else v for k, v in s.items()}


def test_postings_come_back():
    rng = np.random.RandomState(4)
    lengths = rng.randint(1, 2000, 90_000)
    lists = {
        "far": [(0, 1), (70_000, 300), (89_999, 70_000)], "all": [(d, 1 + d % 3) for d in range(0, 90_000, 2)], "one": [(5, 1)],
        "mixed": [(d, int(n)) for d, n in zip(np.unique(rng.randint(0, 90_000, 5000)).tolist(), rng.randint(1, 400, 5000), strict=False)],
    }
    s = shard_of(lists, lengths.tolist())
    p = ls.Postings(s, lengths, len(lengths), int(lengths.sum()))
    for t, name in enumerate(s["terms"].to_pylist()):
        doc, u = p.list(t)
        assert doc.tolist() == [d for d, _ in lists[name]]
        assert u.tolist() == ls.impact(np.array([n for _, n in lists[name]]), lengths[doc], len(lengths), int(lengths.sum())).tolist()
        assert s["bounds"][t] == u.max()


def test_blocks_without_hope_stay_compressed():
    """A rare term decides; of the common term only blocks with candidates are read."""
    n = 50_000
    lists = {"rare": [(d, 9) for d in range(100, 130)], "common": [(d, 1) for d in range(n)]}
    s = shard_of(lists, [200] * n)
    p = ls.Postings(s, np.array([200] * n), n, 200 * n)
    at = {t: k for k, t in enumerate(s["terms"].to_pylist())}
    found, score = ls.best(p, [(at["rare"], 8000), (at["common"], 3)], 10)
    assert len(p.block) <= 3 < s["blocks"][-1] and set(found) == set(range(100, 130)) and len(set(score)) == 1


def test_a_reader_has_one_shard_at_a_time(spark, monkeypatch):
    """Vectorised readers take a row group at once, so a file of many shards must not be one; values are flat, for lists become objects of the JVM."""
    kept = {}
    monkeypatch.setattr(ls, "stored", lambda df, name, **how: kept.setdefault(name, stored(df, name, **how)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        against_sql(spark, corpus(400), [(1, "ka ke 日本")], most_terms=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shards = kept["lexical-shards"]
    assert {t for n, t in shards.dtypes if n != "ids"} == {"string", "binary"}
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    assert all(m.num_row_groups == m.num_rows for m in files) and max(m.num_rows for m in files) > 5
