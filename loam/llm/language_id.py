"""Language identification by error-correcting output codes.

Each language has a codeword of bits, rows far apart. One logistic classifier per bit, over hashed byte trigrams of the
whole lower-cased text, predicts that bit. Decoding adds, over bits, the loss of the predicted margin against the
codeword's bit, weighted by how well that bit's classifier did on its training rows, and picks the least; the score is the
winner's share of exp(-loss), and a text whose two best codewords are close is flagged ``ambiguous``.

Learning uses text and language of rows that are not held out and have both, about ``most_rows`` of them, an equal share for each
language but ``least_rows`` each where they are many: the documented bound of the sample. Rows are drawn by a hash of id and text, and of n rows alike in both as many as their share
of the draw: the sample depends on the rows, not on how they lie in files. Every language that has such rows is learned.

Defined cases: null texts and texts without any letter are ``und`` with score 0; so is every text where no language could be learned;
rows with a null language, or without a letter, teach nothing; null ids and repeated rows are predicted each; other columns are passed over; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, stored

BINS = 4096
#: Rows of a draw that go to every task, of 30 bytes each.
MOST_DRAWN = 1_000_000
#: Fixed value: what a letter is, on both sides.
LETTER = r"\p{L}"
FOLD = np.arange(256, dtype=np.uint32)
FOLD[[ord(c) for c in "0123456789"]] = ord("0")
for _c in range(256):
    if _c < 128 and not chr(_c).isalnum():
        FOLD[_c] = ord(" ")  # marks and white space alike part words


def vectors(col: pa.Array):
    """Blocks of (first row, matrix of the rows' trigram shares, square roots taken, of length 1)."""
    for w in ta.blocks(col, 1 << 19):
        c = FOLD[w.data]
        h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) if len(c) > 2 else np.zeros(0, np.uint32)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        row = np.repeat(np.arange(w.rows), np.diff(w.offsets))[: len(h)]
        inside = row == np.repeat(np.arange(w.rows), np.diff(w.offsets))[2:] if len(h) else np.zeros(0, bool)
        blank = (c[:-2] == 32) & (c[1:-1] == 32) if len(h) else inside
        use = inside & ~blank
        for lo in range(0, w.rows, 256):
            hi = min(w.rows, lo + 256)
            a, b = np.searchsorted(row, [lo, hi])
            got = np.bincount((row[a:b][use[a:b]] - lo) * BINS + h[a:b][use[a:b]], minlength=(hi - lo) * BINS).reshape(hi - lo, BINS)
            x = np.sqrt(got.astype(np.float32))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield w.first + lo, x


def codewords(n: int, tries: int = 400, seed: int = 11) -> np.ndarray:
    """``n`` rows of +1/-1 with both values in every bit: every such split for up to five rows, beyond that the
    most distant of ``tries`` random codes of 10 log2(n) bits; of many rows one such code, whose rows are all apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best, far = np.random.RandomState(seed), None, -1.0
    for _ in range(tries if n <= 100 else 20 if n <= 1000 else 1):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if n > 1000:
            while len(np.unique(code, axis=0)) < n:
                code = np.concatenate([code, rng.choice([-1.0, 1.0], (n, 8))], axis=1)
            return code
        alike = code @ code.T
        np.fill_diagonal(alike, -np.inf)
        least = (code.shape[1] - alike.max()) / 2
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BINS x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the best language, score, ambiguous) of each row."""
        margin = x @ self.weights + self.bias
        # the loss of a bit is one of two values: two products instead of a row, language and bit each
        loss = (np.logaddexp(0, -margin) * self.trust) @ (self.code.T > 0) + (np.logaddexp(0, margin) * self.trust) @ (self.code.T < 0)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        ranked = np.sort(p, axis=1)
        close = ranked[:, -1] < 2 * ranked[:, -2] if p.shape[1] > 1 else np.zeros(len(p), bool)
        return p.argmax(axis=1), p.max(axis=1), close


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    code = codewords(len(languages))
    target = code[y]
    n, bits = target.shape
    target = target.astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / n
        vw, vb = 0.9 * vw - 4 * (x.T @ pull + np.float32(1e-5) * w), 0.9 * vb - 4 * pull.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).mean(axis=0)
    trust = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.05, None)
    return Model(languages, code, w.astype(np.float32), b.astype(np.float32), trust / trust.mean())


def train(docs: DataFrame, held_out: Callable[[Column], Column], most_rows: int = 4000, least_rows: int = 20) -> Model | None:
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    usable = usable.where(F.col("text").rlike(LETTER)).withColumn("mark", F.xxhash64("doc_id", "text"))
    # rows alike in id and text are drawn as copies of one, so neither files nor tasks decide, nor do many copies fill the sample
    copies = stored(usable.groupBy("lang", "mark").agg(F.count("*").alias("n")), "language-copies")
    counts = copies.groupBy("lang").agg(F.sum("n")).collect()  # a row a language, which the model holds too
    if not counts:
        return None
    each = max(least_rows, most_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts for v in (lang, min(1.0, each / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    taken = stored(copies.select("lang", "mark", F.floor(F.col("n") * share + draw).cast("long").alias("taken")).where("taken > 0"), "language-draw")
    few = F.broadcast if taken.count() <= MOST_DRAWN else lambda df: df  # about max(most_rows, least_rows a language) rows
    drawn = usable.join(few(taken), ["lang", "mark"]).groupBy("lang", "mark").agg(F.first("text").alias("text"), F.first("taken").alias("taken")).select("lang", "text", "taken", "mark")

    def of(batches):
        for batch in batches:
            got = [x for _, x in vectors(as_table(batch, "text"))]
            if got:
                x = pa.array([r.astype(np.float16).tobytes() for r in np.concatenate(got)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2), batch.column(3)], names=["lang", "x", "taken", "mark"])

    rows = drawn.mapInArrow(of, "lang string, x binary, taken long, mark long").toArrow()  # about max(most_rows, least_rows a language) rows of 8 KB
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("mark", "ascending")])
    rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows.column("taken").to_numpy())))
    languages = sorted(set(rows.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(v, np.float16) for v in rows.column("x").to_pylist()]).astype(np.float32)
    y = np.array([number[v] for v in rows.column("lang").to_pylist()])
    return fit(x, y, languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS times a few bits a language

    def of(batches):
        m = shared.value
        for batch in batches:
            texts = as_table(batch, "text")
            some = batch.column(2).to_numpy(zero_copy_only=False) & (m is not None)
            best, score, close = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for first, x in vectors(texts) if m is not None else ():
                best[first : first + len(x)], score[first : first + len(x)], close[first : first + len(x)] = m.decode(x)
            names = np.array(m.languages if m is not None else ["und"], dtype=object)[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(some, names, "und"), pa.string()), pa.array(np.where(some, np.clip(score, 0, 1), 0.0)), pa.array(close & some)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("some")).mapInArrow(of, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
