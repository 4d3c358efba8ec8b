import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"


@pytest.fixture(scope="module")
def cost(spark, sf_dir):
    return tx.language_model(tx.trigram_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).tolist()


@pytest.mark.parametrize("word", ["1d10t", "i d i o t", "idiiiiot", "i.d.i.o.t", "id-iot", "!diot"])
def test_restores(word, cost):
    assert "idiot" in tx.restored(word, cost, {}).split()


def test_plain_words_are_left_alone(cost):
    plain = "plain words, with marks. And a line\nbreak"
    assert tx.restored(plain, cost, {}) == plain


def test_trigrams_count_everything(spark):
    df = spark.createDataFrame([("aab",), ("B é",), (None,), ("",)], "text string")
    got = tx.trigram_counts(df.repartition(3))
    at = lambda a, b, c: int(got[(a * tx.SIZE + b) * tx.SIZE + c])
    assert at(0, 1, 1) == 1 and at(1, 1, 2) == 1 and at(0, 0, 2) == 1 and at(2, 0, 27) == 1
    assert got.sum() >= 5


def model_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, tx.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), tx.held_out)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, model = model_on(spark, at)
    got = tx.score(docs, model).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where(tx.held_out(F.col("doc_id"))).select("score", "toxic").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.93
    assert got[got.score >= 0.5].toxic.mean() > 0.9
    assert got.score.between(0, 1).all()


def test_disguised_words_score_like_plain_ones(spark):
    docs, model = model_on(spark, "/root/testdata/sf0.01")
    table = model.cost.tolist()
    plain, hidden, clean = model.scores(pa.array(["the idiot and the moron", "the 1d10t and the m0r0n", "the and of that"]), table, {})
    assert clean < 0.5 <= min(plain, hidden) and abs(plain - hidden) < 0.2


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x " * 100_000, "c"), (4, "fine", "d"), (4, "fine", "d")]
    docs = spark.createDataFrame(rows, DOCS)
    none = tx.train(docs, spark.createDataFrame([], LABELS), tx.held_out)
    got = tx.score(docs, none, "s").collect()
    assert len(got) == 5 and all(0 <= r["s"] < 0.5 for r in got) and [r["score"] for r in got][0] == "a"
    assert tx.score(docs.limit(0), none, "s").count() == 0
    one = tx.train(docs, spark.createDataFrame([(1, 0), (None, 1), (4, None)], LABELS), tx.held_out)
    assert one.bias < 0 and not len(one.names)
    assert tx.train(docs.limit(0), spark.createDataFrame([], LABELS), tx.held_out).bias <= 0


def test_logistic_fits():
    row, col = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    w, b = tx.fit_logistic(row, col, np.array([1.0, 1.0, 0.0, 0.0]), 2)
    assert w[0] + b > 1 > -1 > w[1] + b


@pytest.mark.parametrize("word", ["i d i 0 t", "1 d 1 0 t", "1  d  1  0  t", "i - d - i - o - t", "a 1 d 1 0 t", "1 d 1 0 t   a b c d", "7 8 i d i o t"])
def test_restores_spaced_signs(word, cost):
    got = tx.restored(f"that {word}, so", cost, {}).split()
    assert "idiot" in got and got[0] == "that" and got[-1] == "so"


def test_numbers_set_apart_are_left_alone(cost):
    assert tx.restored("1 2 3 4 5 and 1.2.3.4", cost, {}) == "1 2 3 4 5 and 1.2.3.4"


def test_every_disguised_stretch_passes_the_prefilter(cost):
    words = ["hat3", "ki11", "a55", "a$$", "di3", "useles5", "éééé", "жжж", "𝒳𝒳𝒳", "aaa", "²0", "é€", "1d10t", "x-y", "i d i 0 t", "1  d  1  0  t", "é é é 1", "a * b * 1 * ½", "t|", "*a"]
    words += [a + s for a in "aéж" for s in tx.STANDS_FOR] + [s + a for a in "aéж" for s in tx.STANDS_FOR]
    found = [bool(tx.stretches(w) or tx.DISGUISED.search(w)) for w in words]
    assert all(found)
    col = pa.array(["skipped", *words, None, "plain", "éé é"])[1:]
    passes = tx.pc.match_substring_regex(tx.pc.fill_null(col, ""), tx.MAYBE).to_numpy(zero_copy_only=False) | tx.tripled(tx.pc.fill_null(col, ""))
    assert passes.tolist() == [True] * len(words) + [False] * 3
    for w in words:  # read alike alone and beside other text
        alone = {int(f) for *_, fs in tx.features(pa.array([w]), cost, {}) for f in fs}
        beside = {int(f) for *_, fs in tx.features(pa.array([f"1d10t , {w}"]), cost, {}) for f in fs}
        assert alone <= beside, w


def test_signs_at_the_end_score_like_letters(spark):
    docs, model = model_on(spark, "/root/testdata/sf0.01")
    table = model.cost.tolist()
    hidden, clean = model.scores(pa.array(["the idi0t and the 1 d 1 0 t", "1 2 3 4 and of that!"]), table, {})
    assert clean < 0.5 <= hidden


def cheapest(word, cost):
    """Every reading of a word by trying every choice for every character; the least total of channel and trigram costs."""
    import itertools

    spaced = any(p.fullmatch(word) for p in tx.SPACED)
    last = len(word.rstrip("!|+*(€$@")) - 1
    choices = []
    for k, c in enumerate(word):
        own = [(c, 0.0)] if c.isalpha() else []
        own += [(x, tx.SUBSTITUTE) for x in tx.STANDS_FOR.get(c, "")]
        if not c.isalpha() and not (c in "0123456789"):
            own.append(("", tx.DROP_SEPARATOR if c in " .-_*" else tx.DROP_SIGN if k < last else tx.DROP_LAST_SIGN))
            if c in "-._" and not spaced:
                own.append((c, 0.5))
        if c.isalpha() and k and word[k - 1] == c:
            own.append(("", tx.DROP_REPEAT))
        choices.append(own)
    best = (float("inf"), "")
    for path in itertools.product(*choices):
        text, total, a, b = "".join(x for x, _ in path), sum(v for _, v in path), 0, 0
        for x in text:
            n = ord(x) - 96 if "a" <= x <= "z" else 27 if x.isalpha() else 0
            total, a, b = total + cost[a][b][n], b, n
        best = min(best, (total + cost[a][b][0], text))
    return best[1]


def test_decoding_equals_trying_every_reading(cost):
    rng = np.random.RandomState(7)
    letters = list("abdeiost") + list("01345@$!*.-_ ") + ["é", "|", "("]
    words = ["1d10t", "i d i o t", "m0r0n", "idiiiiot", "st*pid!", "id-iot", "a$$", "h.a.t.e"] + ["".join(rng.choice(letters, rng.randint(2, 8))) for _ in range(250)]
    for word in words:
        assert tx.restore(word, cost) == cheapest(word, cost), word


def test_the_restored_text_alone_is_scored(cost):
    """The disguise of a word is no feature: only the readings are."""
    names = lambda t: {int(f) for *_, fs in tx.features(pa.array([t]), cost, {}) for f in fs}
    raw = {int(f) for w in tx.ta.blocks(pa.array(["1d10t m0r0n"])) for f in w.hashes()}
    hidden = names("the 1d10t and the m0r0n")
    assert not raw & hidden and hidden == names(tx.restored("the 1d10t and the m0r0n", cost, {}))


def test_very_long_words_are_decoded_in_linear_time(cost):
    import time

    began = time.perf_counter()
    assert len(tx.restored("a1" * 100_000, cost, {})) > 100_000
    assert time.perf_counter() - began < 30


def test_rows_that_repeat_an_id_are_bounded(spark):
    rows = [(1 + i % 8, f"mild idiot text {i}", None) for i in range(4000)] + [(20 + i % 8, f"fine text {i}", None) for i in range(4000)] + [(1, "alike idiot", None)] * 2000
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(i, 0) for i in range(20, 28)], LABELS)
    seen, fit = [], tx.fit_logistic
    try:
        tx.fit_logistic = lambda row, col, y, n: seen.append(y) or fit(row, col, y, n)
        model = tx.train(docs, labels, tx.held_out, most_positive=100, most_negative=150)
    finally:
        tx.fit_logistic = fit
    assert len(seen[0]) == 250 and seen[0].sum() == 100 and len(model.names)


def test_scores_equal_a_plain_sum(cost):
    """A weight for each distinct word, and beginning of one, that the model knows; as sets of strings and a sum."""
    import math

    from loam.llm import textarrays as ta

    known = {"stupid": 1.5, "idio": 0.75, "idiot": 2.0, "nice": -1.25, "trash": 0.5, "worthles": 1.0, "été": -0.5}
    hashed = {int(next(ta.blocks(pa.array([w]))).hashes()[0]): v for w, v in known.items()}
    names = np.array(sorted(hashed), np.uint64)
    model = tx.Model(np.zeros(1), names, np.array([hashed[int(h)] for h in names]), -0.3)
    texts = ["You stupid, stupid idiot!", "so nice", "idiotic trash; été ÉTÉ", "worthless worthless", "", None, "1 d 1 0 t", "plain words only", "idio"]
    memo: dict[str, str] = {}
    got = model.scores(pa.array(texts), cost, memo)
    for text, score in zip(texts, got, strict=True):
        said = (text or "").lower()
        said = tx.restored(said, cost, {}) if said else ""
        words = {w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in said).split()}
        found = words | {w.encode()[:k].decode(errors="ignore") for w in words for k in tx.PREFIXES if len(w.encode()) > k}
        z = model.bias + sum(v for w, v in known.items() if w in found)
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-12, text
