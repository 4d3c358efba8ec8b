import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loam.llm import collocations as co

DOCS = "doc_id long, text string, lang string, f string, range int, words string"


def automaton(counts: dict[tuple, int]) -> co.Automaton:
    """Of paths with counts; a path's beginnings weigh what the counts say of them, or nothing."""
    words = sorted({w for path in counts for w in path}, key=lambda w: w.encode())
    flat = sorted({path[:k] for path in counts for k in range(1, len(path) + 1)}, key=lambda p: [w.encode() for w in p])
    levels, before = [], {(): 0}
    for d in range(1, max(map(len, flat)) + 1):
        own = [p for p in flat if len(p) == d]
        levels.append((np.array([before[p[:-1]] for p in own]), np.array([words.index(p[-1]) for p in own]), np.array([counts.get(p, 0) for p in own], np.int64)))
        before = {p: i for i, p in enumerate(own)}
    return co.Automaton.of(pa.array(words), levels)


def listed(a: co.Automaton) -> dict[tuple, int]:
    names = a.words.to_pylist()
    return {tuple(names[c[i]] for c in path): int(w) for path, weight in a.paths() for i, w in enumerate(weight)}


def made_up(n: int, seed: int) -> dict[tuple, int]:
    rng = random.Random(seed)
    out: dict[tuple, int] = {}
    for _ in range(n):
        path = tuple(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
        for k in range(1, len(path) + 1):
            out[path[:k]] = out.get(path[:k], 0) + 1
    return out


def test_automaton_keeps_paths_and_shares_states():
    counts = made_up(300, 1)
    a = automaton(counts)
    assert listed(a) == counts
    same = automaton({(x, "y", z): 7 for x in "abcdefgh" for z in "mnop"} | {(x, "y"): 3 for x in "abcdefgh"} | {(x,): 1 for x in "abcdefgh"})
    assert len(same.begin) - 1 == 4  # the end, the last words, what follows any first word, the start
    assert listed(automaton({("a",): 2})) == {("a",): 2}


def test_equal_hashes_do_not_merge_states(monkeypatch):
    counts = made_up(200, 2)
    monkeypatch.setattr(co.ta, "mix", lambda x: x & np.uint64(1))
    assert listed(automaton(counts)) == counts


def test_union_adds_and_drops():
    some = [made_up(100, s) for s in range(5)]
    total = sum((Counter(c) for c in some), Counter())
    assert listed(co.united([automaton(c) for c in some])) == dict(total)
    assert listed(co.united([automaton(c) for c in some], least=6)) == {p: n for p, n in total.items() if n >= 6}
    # arcs before the weighing depth stay where something follows them
    deep = co.united([automaton({("x",): 0, ("x", "y"): 0, ("x", "y", "z"): 9, ("x", "q"): 0, ("x", "q", "z"): 1})], least=5, weighs_from=2)
    assert listed(deep) == {("x",): 0, ("x", "y"): 0, ("x", "y", "z"): 9}
    assert listed(co.united([automaton({("x",): 1})], least=5)) == {}


def test_composition_looks_up_whole_paths():
    counts = made_up(300, 3)
    a = automaton(counts)
    names = a.words.to_pylist()
    asked = [*counts, ("a", "zz"), ("zz",), ("a", "a", "a", "a", "a", "a")]
    labels = [np.array([-1 if d >= len(p) else names.index(p[d]) if p[d] in names else -2 for p in asked]) for d in range(6)]
    assert a.composed(labels).tolist() == [counts.get(p, 0) for p in asked]


def test_packed_automata_come_back():
    for a in (automaton(made_up(300, 4)), automaton({("a",): 2**40, ("a", "日本"): 1}), co.united([automaton({("x",): 1})], least=5)):
        [(number, b)] = co._automata(co._batch(7, a))
        assert number == 7 and b.words.to_pylist() == a.words.to_pylist()
        assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("begin", "label", "weight", "target"))


def test_hashes_go_by_language_and_word():
    lang, word = pa.array(["en", "en", "de", "", "en"]), pa.array(["a", "b", "a", "日本", "a"])
    h = co.hashes(lang, word)
    assert len(set(h.tolist())) == 4 and h[0] == h[4] and (co.hashes(lang.slice(1), word.slice(1)) == h[1:]).all()
    assert (co.range_of(co.pair_hash(h, h[::-1]), 5) < 5).all()


def test_scores_are_exact(spark):
    rows = [(10**12 + 7, 10**14 + 3, 10**12 + 9, 10**13 + 1), (100, 1000, 100, 100), (100, 301, 100, 301), (10**14, 10**18, 10**14, 10**18)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, n long, l long, r long").select(F.expr(co.SCORE)).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def against_sql(spark, rows: list[tuple], least: int, most: int, **options) -> int:
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    sql = co.ORACLE.replace("f >= 100)", f"f >= {least})").replace("rank <= 2000", f"rank <= {most}")
    assert sql.count(f"f >= {least})") == 1
    want = con.execute(sql).fetchall()
    docs = spark.createDataFrame([(*r, "f", 1, "w") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in co.collocations(docs, least, most, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(got)


def corpus(n: int) -> list[tuple]:
    rng = random.Random(9)
    words = ["new", "York", "city", "of", "the", "in", "a", "hall", "É", "x-y", "(b)"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for i in range(n):
        said = rng.choices(words, weights, k=rng.randint(0, 30))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "\x0b", " "]) for w in said)
        rows.append((i, text + rng.choice(["", "new york city hall", "a a a a a a"]), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


def test_equal_to_sql(spark):
    rows = corpus(400) + [(1, None, "en"), (None, "", None), (None, "new york city hall", "fr")]
    assert against_sql(spark, rows, 8, 2000) > 100
    assert against_sql(spark, rows, 8, 20, most_words=500, range_words=300) > 60
    assert against_sql(spark, rows, 30, 2000, most_bits=7, most_words=2000) > 10  # a bitmap that says yes too often


def test_long_unions_are_done_in_steps(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(*r, "f", 1, "w") for r in rows], DOCS).repartition(2)
    whole = {tuple(r) for r in co.collocations(docs, 10).collect()}
    full = co.union_ranges
    try:
        co.union_ranges = lambda shards, ranges, least, weighs: full(shards, ranges, least, weighs, most_arcs=50)
        assert {tuple(r) for r in co.collocations(docs, 10, most_words=200).collect()} == whole
    finally:
        co.union_ranges = full


def test_empty_tables(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, "", 1, ""), (2, "only once", "en", "", 1, "")], DOCS)).count() == 0
