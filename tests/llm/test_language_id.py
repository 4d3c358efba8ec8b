import numpy as np
from pyspark.sql import functions as F

from loam.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, score string"


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 9, 30, 300):
        code = li.codewords(n)
        assert set(np.unique(code)) <= {-1.0, 1.0} and len(code) == n
        assert all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 5) for i in range(n) for j in range(i))


def test_decoding_equals_a_plain_loop():
    """Bit by bit in Python: the loss of each codeword, the least one, its share, and whether another is close."""
    import math

    rng = np.random.RandomState(3)
    for n in (1, 2, 4, 7):
        code = li.codewords(n)
        bits = code.shape[1]
        m = li.Model([f"l{i}" for i in range(n)], code, rng.standard_normal((li.BINS, bits)) * 3, rng.standard_normal(bits), rng.random_sample(bits) + 0.1)
        x = np.abs(rng.standard_normal((40, li.BINS)))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        best, score, close = m.decode(x)
        for r in range(len(x)):
            loss = []
            for word in code:
                total = 0.0
                for b in range(bits):
                    margin = sum(x[r, k] * m.weights[k, b] for k in np.flatnonzero(x[r])) + m.bias[b]
                    total += m.trust[b] * math.log(1 + math.exp(-margin * word[b]))
                loss.append(total)
            p = [math.exp(-v + min(loss)) for v in loss]
            p = [v / sum(p) for v in p]
            assert best[r] == p.index(max(p)) and abs(score[r] - max(p)) < 1e-9
            assert close[r] == (n > 1 and sorted(p)[-1] < 2 * sorted(p)[-2])
            if r == 2:
                break


def test_every_language_is_learned(spark):
    """300 languages, each with words of its own."""
    rows = [(10 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ko", "lam", "teru", "sin")) * 3, f"x{k:03d}", None) for k in range(300) for j in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.train(docs, li.held_out)
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 300
    got = li.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(li.held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_rows_that_share_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"the and of that with number word{i}", "en", None) for i in range(3000)] + [(None, "the same text", "en", None)] * 3000 + [(8, f"der die das und mit wort{i}", "de", None) for i in range(2000)]
    docs = spark.createDataFrame(rows + [(9, None, "fr", None), (9, "123 !", "it", None)], SCHEMA).repartition(4)
    seen = []
    fit = li.fit
    try:
        li.fit = lambda x, y, languages: seen.append((len(y), languages)) or fit(x, y, languages)
        assert li.train(docs, li.held_out, most_rows=400).languages == ["de", "en"]
    finally:
        li.fit = fit
    assert 250 < seen[0][0] < 600 and seen[0][1] == ["de", "en"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.predict(docs, li.train(docs, li.held_out)).join(docs.select("doc_id", "lang"), "doc_id").where(li.held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, "the and of that with", "en", None) for i in range(30)] + [(100 + i, "der die das und mit", "de", None) for i in range(30)]
    rows += [(500, None, "en", "x"), (501, "", None, None), (502, "123 !!", "de", None), (None, "der und die", None, None), (None, "der und die", None, None), (503, "ab", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.train(docs, li.held_out)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in li.predict(docs, model).collect()}
    assert got[(500, "und")] == got[(501, "und")] == got[(502, "und")] == 0
    assert (None, "de") in got and (503, "und") not in got
    assert {r["lang_pred"] for r in li.predict(docs, None).collect()} == {"und"}
    assert li.train(docs.limit(0), li.held_out) is None and li.predict(docs.limit(0), model).count() == 0
    alone = li.train(docs.where("lang = 'en'"), li.held_out)
    assert alone.languages == ["en"]


def test_a_text_is_scored_whole(spark):
    docs = spark.createDataFrame([(i, "the and of that with this " * 3, "en", None) for i in range(40)] + [(50 + i, "der die das und mit ist " * 3, "de", None) for i in range(40)], SCHEMA)
    long = spark.createDataFrame([(1, "the and of that " * 200 + "der die das und mit ist " * 40_000)], "doc_id long, text string")
    assert li.predict(long, li.train(docs, li.held_out)).first()["lang_pred"] == "de"


def test_numerals_are_no_letters(spark):
    rows = [(i, "the and of that with", "en", None) for i in range(30)] + [(100 + i, "der die das und mit", "de", None) for i in range(30)]
    rows += [(500, "½ ²", "en", None), (501, "Ⅷ ①", "de", None), (502, "٣٤ 12 _", None, None), (503, "é", None, None), (504, "日本", None, None), (505, "ª", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(docs, li.train(docs, li.held_out)).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert all(got[i][0] != "und" for i in (503, 504, 505))


def test_the_sample_depends_on_rows_alone(spark):
    rows = [(k, f"the and of that with number word{k % 700}", "en", None) for k in range(2000)] + [(k, f"der die das und mit wort{k}", "de", None) for k in range(2000, 3000)] + [(7, "one text", "en", None)] * 2000
    docs = spark.createDataFrame(rows, SCHEMA)
    one, other = (li.train(docs.repartition(n, F.rand(n)), li.held_out, most_rows=300) for n in (2, 5))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.trust, other.trust)
