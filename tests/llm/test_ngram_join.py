import re

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import ngram_join as nj
from loam.llm import textarrays as ta

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def grams(text, n=5):
    w = WORD.findall((text or "").lower())
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(docs, threshold=0.8):
    """(class, links) of each id, by comparing all pairs."""
    ids = sorted(docs)
    sets = {i: grams(docs[i]) for i in ids}
    links = {i: [j for j in ids if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in ids}
    root = {}
    for i in ids:
        if i in root:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        for j in seen:
            root[j] = min(seen)
    return {i: (root[i], len(links[i])) for i in ids}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def corpus(seed=1, n=40):
    rng = np.random.RandomState(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = {}
    for k in range(n):
        words = list(rng.choice(vocab, rng.randint(3, 120)))
        docs[10 * k] = " ".join(words)
        for c in range(rng.randint(0, 5)):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randint(len(near))] = "changed"
            docs[10 * k + c + 1] = " ".join(near).upper() if c == 2 else ", ".join(near)
    return docs


def test_equals_all_pairs(spark):
    docs = corpus() | {5001: None, 5002: "", 5003: "!!! ...", 5004: "", 6000: "one two", 6001: "One, two!"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert result(nj.jaccard_classes(df)) == brute(docs)


def test_small_blocks_change_nothing(spark):
    base = " ".join(f"b{i}" for i in range(60)).split()
    docs = {i: " ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1 :]]) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs)
    assert result(nj.jaccard_classes(df)) == want
    assert result(nj.jaccard_classes(df, cell_rows=7, cell_words=300)) == want


def test_documents_query_equals_all_pairs(spark, sf_dir):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert result(nj.jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute(docs)


def test_odd_rows(spark):
    schema = "doc_id long, text string, node long, cell string, bands string, row_file string, row long, file string, _metadata string"
    assert nj.jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    rest = ("x", "y", "z", 1, "f", "m")
    rows = [(1, "a b c d e f", 1, *rest), (1, "a b c d e f", 2, *[None] * 6), (2, "a b c d e f", 3, *rest), (None, "A b, c d e f", 4, *rest), (None, "q r s", 5, *rest), (None, "q r s", 5, *rest), (None, None, 6, *rest)]
    got = sorted((tuple(r) for r in nj.jaccard_classes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), (None, 1, 3, False), (None, None, 1, True), (None, None, 1, False), (None, None, 0, True)], key=str)
    other = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f")]
    got = [tuple(r) for r in nj.jaccard_classes(spark.createDataFrame(other, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    named = spark.createDataFrame([("b", "a b c"), ("a", "a b c")], "doc_id string, text string")
    assert result(nj.jaccard_classes(named)) == {"a": ("a", 1), "b": ("a", 1)}


def test_rows_are_named_by_file_and_place(spark, tmp_path):
    spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "e")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = nj.jaccard_rows(docs).collect()
    assert len({(r["file"], r["row"]) for r in rows}) == 4 and sorted(r["kept"] for r in rows) == [False, False, True, True]
    wide, file, row = nj.numbered(docs)
    assert {(r[file], r[row]) for r in wide.collect()} == {(r["file"], r["row"]) for r in rows}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_large_components_by_block_and_by_bucket(spark, bound):
    """A chain whose neighbours alone are near, and a dense group, both beyond a block: as all pairs have it."""
    chain = {i: " ".join(f"c{k}" for k in range(10 * i, 10 * i + 100)) for i in range(40)}
    dense = {1000 + i: " ".join([*(f"d{k}" for k in range(60 - i % 9)), f"x{i}"]) for i in range(40)}
    docs = chain | dense
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert result(nj.jaccard_classes(df, cell_rows=5, broadcast_rows=bound)) == brute(docs)


def test_a_long_chain_of_candidates_costs_what_its_buckets_hold(spark):
    n = 6000
    rows = [(i, 0, 10, 1, [-i - 1, i // 2, 10_000_000 + (i + 1) // 2]) for i in range(n)]
    members = spark.createDataFrame(rows, "node long, comp long, n long, copies long, bands array<long>")
    placed = nj.placements(members, 1024, 400_000).groupBy("grp", "band", "cell").count().toPandas()["count"]
    assert placed.sum() <= 2 * n and (placed**2).sum() <= 4 * n
    dense = spark.createDataFrame([(i, 0, 10, 1, [1, 2, 3]) for i in range(3000)], "node long, comp long, n long, copies long, bands array<long>")
    assert nj.placements(dense, 1024, 400_000).count() == 9000


def test_long_text(spark):
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    got = result(nj.jaccard_classes(spark.createDataFrame([(1, long), (2, long + " end"), (3, "z")], "doc_id long, text string")))
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


@pytest.mark.parametrize(("t", "r"), [(0.8, 0.999), (0.5, 0.95), (0.9, 0.99)])
def test_bands_reach_the_recall(t, r):
    bands, rows = nj.choose_bands(t, r, 160)
    assert bands * rows <= 160 and 1 - (1 - t**rows) ** bands >= r


def test_words_are_those_of_the_pattern():
    texts = ["Ab cD9 é!x", "", "tail", "head ß", None, "a" * 50 + " b"]
    got = []
    for w in ta.blocks(pa.array(texts), 4):
        got += [(w.first + r, bytes(w.data[s:e]).decode()) for r, s, e in zip(w.row, w.start, w.end, strict=True)]
    assert got == [(i, x) for i, t in enumerate(texts) for x in WORD.findall((t or "").lower())]


def test_components(spark):
    from loam.llm.common import components

    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (102, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
