import numpy as np

from loam.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, goal = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left, total = goal - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / total for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    rng = np.random.RandomState(2)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i:02d}": int(rng.choice([0, 10, 1000, 100_000])) + int(rng.randint(0, 50)) for i in range(n)} | {None: 77}
        df = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_takes_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = mixing.sizes(docs)
    got = mixing.systematic_mix(sized).toPandas()
    assert len(got) == 1000 and got.copies.between(0, 2).all()
    per = got.assign(taken=got.copies * got["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= 3 * per.largest).all()
    again = mixing.systematic_mix(mixing.sizes(docs.repartition(7))).toPandas()
    assert dict(zip(got.doc_id, got.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))


def test_copies_follow_the_definition(spark):
    rows = [(i, "a", 10) for i in range(500)] + [(1000 + i, "b", 30) for i in range(200)]
    got = mixing.systematic_mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    for _, g in got.groupby("source"):
        rate = g.target.iloc[0] / g.source_size.iloc[0]
        assert abs(g.copies.sum() - rate * len(g)) <= 1
        assert set(g.copies) <= {int(np.floor(rate)), int(np.floor(rate)) + 1}


def test_odd_rows(spark):
    rows = [(1, None, "a", "x", "y"), (2, "", "a", None, None), (3, "one two\tthree\n\x0bfour", None, None, None), (None, "w " * 50_000, "b", None, None), (5, " x  y", "b", None, None), (5, " x  y", "b", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sized = mixing.sizes(docs)
    got = mixing.systematic_mix(sized).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 4, 50_000]
    assert all(r["copies"] == 0 for r in got if r["source"] == "a")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {3}
    assert mixing.systematic_mix(sized.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "a b c", "s", None, None)] * 3 + [(1, "d e f", "s", None, None), (2, "g", None, None, None), (2, "g", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sized = mixing.sizes(docs)
    want = sum(r["copies"] for r in mixing.systematic_mix(sized).collect())
    assert mixing.mixed_documents(docs).count() == want


def test_rows_without_ids_and_clashing_columns(spark):
    """Null ids of one source and size are dealt copies one by one; columns keep names that the job might use itself."""
    names = ["size", "copies", "copy", "row_file", "row_place", "mark", "hashed", "bucket", "rank", "__copies", "a.b"]
    rows = [(None if i % 2 else i, f"word{i} other words", "s" if i % 3 else None, *range(i, i + len(names))) for i in range(300)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {tuple(r) for r in got} <= set(rows) and len({r["text"] for r in got}) > 100
    want = sum(r["copies"] for r in mixing.systematic_mix(mixing.sizes(docs)).collect())
    assert len(got) == want


def test_null_ids_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(900)], "doc_id long, text string, source string")
    marks = mixing.sizes(docs).select("mark").distinct().count()
    assert marks == 900
