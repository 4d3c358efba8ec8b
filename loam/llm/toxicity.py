"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

Restoring. A word that is disguised (digits or signs among letters, one character repeated three
times or more, or letters set apart one by one) spans a lattice: each character is itself, a letter
it stands in for, a repeat to drop, or a separator or sign to drop (a digit always stands for a letter). Viterbi decoding picks the path that a
character trigram model, counted over all documents, and the channel's costs like best. A word
that is none of these has one path, itself, so only disguised words are decoded.

Scoring. The restored text, in which readings stand in place of disguised stretches, is what is scored: its features are its words and
their leading parts of 4 to 8 bytes, each counted once; how a word was disguised is none. The features that tell toxic from clean rows on a
bounded, labelled sample by a likelihood-ratio test are weighed by a logistic regression. Labels, language, source and id are never features.

Defined cases: null and empty texts have no features and get the score of the bias alone; other
columns pass through untouched; with no labels, or one class only, every score is the smoothed rate
of label 1, below 0.5 where there are none; repeated rows are scored each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, giving_back, stored

#: What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
SUBSTITUTE, DROP_REPEAT, DROP_SEPARATOR, DROP_SIGN, DROP_LAST_SIGN = 1.0, 0.5, 0.3, 8.0, 1.0
PREFIXES = (4, 5, 6, 7, 8)

_SIGN = "[0-9@$!|+€(*]"
_SINGLE = r"[^\W\d_]|[0-9@$!|+€(]"
_SPACED = r"(?<![^\W_])(?:(?:{0})[ .\-_*]{1}){{3,}}(?:{0})(?![^\W_])"
#: Letters one by one, set apart by one sign each; then letters or signs for them; then those, set apart by any number of signs.
SPACED = [re.compile(_SPACED.format(*x)) for x in ((r"[^\W\d_]", ""), (_SINGLE, ""), (_SINGLE, "+"))]
#: A sign beside a letter, a sign between letters, or a letter three times.
DISGUISED = re.compile(rf"[^\W\d_]{_SIGN}|{_SIGN}[^\W\d_]|[^\W\d_][._-][^\W\d_]|([^\W\d_])\1\1")
_LETTER = r"a-zA-Z\x{80}-\x{10FFFF}"  # and more: all that [^\W\d_] takes
#: For whole columns at once: every row with a disguised stretch passes this or ``tripled``, and only these are searched.
MAYBE = "|".join(
    [
        rf"[{_LETTER}]{_SIGN}", rf"{_SIGN}[{_LETTER}]", rf"[{_LETTER}][._-][{_LETTER}]",
        rf"[{_LETTER}0-9@$!|+€(][ .\-_*]+" * 3 + rf"[{_LETTER}0-9@$!|+€(]",
        *(f"{chr(c)}{{3}}" for c in range(97, 123)),
    ]
)
SIZE = 28  # boundary, a to z, any other letter


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams (boundary, a to z, other) over every text: SIZE cubed numbers."""
    classes = np.zeros(256, dtype=np.int32)
    classes[97:123] = np.arange(1, 27)
    classes[128:] = 27

    def of(batches):
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for w in ta.blocks(as_table(batch, "text")):
                c = np.concatenate([[0, 0], np.insert(classes[w.data], w.offsets[1:-1], 0), [0]])  # rows set apart
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(giving_back(of), "gram int, n long")
    counts = np.zeros(SIZE**3)
    for gram, n in rows.groupBy("gram").agg(F.sum("n")).collect():  # SIZE cubed rows at most
        counts[gram] = n
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -ln p(c | a, b), interpolated with bigrams and letters."""
    tri = counts.reshape(SIZE, SIZE, SIZE) + 0.0
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def restore(word: str, cost: list) -> str:
    """The cheapest reading of one disguised stretch; states are the classes of the last two letters read."""
    spaced = any(p.fullmatch(word) for p in SPACED)
    # what was read so far is a chain of (chain before, letter): paths share it, and a step costs the same however long the word
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before, last = "", len(word.rstrip("!|+*(€$@")) - 1  # signs after it are marks more likely than letters
    for k, c in enumerate(word):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        for x in STANDS_FOR.get(c, ""):
            options.append((x, SUBSTITUTE))
        if not c.isalpha() and not (c.isdigit() and c in STANDS_FOR):
            options.append(("", DROP_SEPARATOR if c in " .-_*" else DROP_SIGN if k < last else DROP_LAST_SIGN))
            if not spaced and c in "-._":
                options.append((c, 0.5))
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, out) in states.items():
            for x, channel in options + ([("", DROP_REPEAT)] if c.isalpha() and c == before else []):
                if not x:
                    key, total, read = (a, b), so_far + channel, out
                else:
                    n = letter(x)
                    key, total, read = (b, n), so_far + channel + cost[a][b][n], (out, x)
                if key not in nxt or total < nxt[key][0]:
                    nxt[key] = (total, read)
        states, before = nxt, c
    chain = min(((t + cost[a][b][0], k, out) for k, ((a, b), (t, out)) in enumerate(states.items())), key=lambda s: s[:2])[2]
    letters = []
    while chain:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


def stretches(text: str) -> list[tuple[int, int, list[str]]]:
    """(first character, end, readings to make) of what is set apart letter by letter, in order and apart.

    A stretch is read also without its first letter, which may be a word: "a 1 d 1 0 t". Digits alone are numbers.
    """
    found = []
    for pattern in SPACED:
        for m in pattern.finditer(text):
            own = [x for x in (m.group(0), re.sub(r"^.[ .\-_*]+", "", m.group(0))) if any(c.isalpha() for c in x) and any(p.fullmatch(x) for p in SPACED)]
            if own:
                found.append((m.start(), m.end(), own))
    out: list[tuple[int, int, list[str]]] = []
    for begin, end, own in sorted(found):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), list(dict.fromkeys([*out[-1][2], *own])))
        else:
            out.append((begin, end, list(dict.fromkeys(own))))
    return out


def tripled(low: pa.Array) -> np.ndarray:
    """Which rows hold a character beyond ASCII three times in a row?"""
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset : low.offset + len(low) + 1]
    out = np.zeros(len(low), dtype=bool)
    if low.buffers()[2] is None:
        return out
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[: offsets[-1]]
    beyond = np.flatnonzero(data >= 0xC0)
    for size, least, most in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = beyond[(data[beyond] >= least) & (data[beyond] < most) & (beyond >= offsets[0]) & (beyond + 3 * size <= len(data))]
        for k in range(2 * size):
            at = at[data[at + k] == data[at + k + size]]
        row = np.searchsorted(offsets, at, side="right") - 1
        out[row[at + 3 * size <= offsets[row + 1]]] = True
    return out


def restored(text: str, cost: list, memo: dict[str, str]) -> str:
    """The text with its disguised stretches replaced by their readings, each also with its double letters made single."""

    def read(got: str) -> str:
        if got not in memo:
            if len(memo) > 50_000:  # a memo only: what is forgotten is decoded again
                memo.clear()
            plain = restore(got, cost)
            memo[got] = plain + " " + re.sub(r"(.)\1+", r"\1", plain)
        return memo[got]

    def words(part: str) -> str:
        out, at = [], 0
        for m in DISGUISED.finditer(part):
            if m.start() < at:
                continue
            begin, end = m.start(), m.end()
            while begin > at and not part[begin - 1].isspace():
                begin -= 1
            while end < len(part) and not part[end].isspace():
                end += 1
            word = part[begin:end].strip(".,;:?\"'()[]{}<>")
            out += [part[at:begin], " ", read(word) if DISGUISED.search(word) else word, " "]
            at = end
        return "".join([*out, part[at:]])

    out, at = [], 0
    for begin, end, own in stretches(text):
        out += [words(text[at:begin]), " ", " ".join(map(read, own)), " "]
        at = end
    return "".join([*out, words(text[at:])])


def features(col: pa.Array, cost: list, memo: dict[str, str]):
    """Blocks of (first row, rows, row of each feature, 64-bit feature) of the restored texts, repeats kept."""
    for first in range(0, len(col), 1000):  # a slice at a time: what is restored is a copy
        low = pc.utf8_lower(pc.fill_null(col.slice(first, 1000), ""))
        maybe = pc.match_substring_regex(low, MAYBE).to_numpy(zero_copy_only=False) | tripled(low)
        if maybe.any():
            low = pc.replace_with_mask(low, pa.array(maybe), pa.array([restored(low[int(i)].as_py(), cost, memo) for i in np.flatnonzero(maybe)], low.type))
        for w in ta.blocks(low, 1 << 18):
            rows, found = [w.row], [w.hashes()]
            for k in PREFIXES:
                long = np.flatnonzero(w.end - w.start > k)
                rows.append(w.row[long])
                found.append(w.hash_range(w.start[long], w.start[long] + k))
            yield first + w.first, w.rows, np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    cost: np.ndarray
    names: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    bias: float

    def scores(self, col: pa.Array, cost: list, memo: dict[str, str]) -> np.ndarray:
        z = np.full(len(col), self.bias)
        for row, name in present(col, cost, memo, self.names):
            np.add.at(z, row, self.weights[name])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def present(col: pa.Array, cost: list, memo: dict[str, str], names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(rows, indexes into names)]: which of the sorted ``names`` each row has, each once."""
    if not len(names):
        return []
    table = np.zeros(1 << 18, dtype=bool)
    table[(names & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    found = []
    for first, _, row, feature in features(col, cost, memo):
        got = table[(feature & np.uint64((1 << 18) - 1)).astype(np.int64)]
        row, feature = row[got] + first, feature[got]
        at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        same = names[at] == feature
        found.append(row[same].astype(np.int64) * len(names) + at[same])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return [(both // len(names), both % len(names))]


def fit_logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.05, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum on sparse 0/1 features; 0 lies in the middle between the classes."""
    w, b, vw, vb = np.zeros(n_features), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(n_features), 0.0
    n = len(y)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(col, weights=e[row], minlength=n_features) / n * 20 + l2 * w / n
        vw, vb = 0.9 * vw - 0.5 * gw, 0.9 * vb - 0.5 * e.mean()
        w, b = w + vw, b + vb
    return w, b - cut(np.bincount(row, weights=w[col], minlength=n) + b, y)


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value between the classes: the middle of the widest gap among those that part them with fewest errors."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.cumsum(y)[:-1] + np.cumsum((1 - y)[::-1])[::-1][1:]  # positives below, negatives above
    gap = np.where(missed == missed.min(initial=np.inf), np.diff(z), -1)
    at = int(gap.argmax()) if len(gap) else 0
    return float((z[at] + z[at + 1]) / 2) if len(gap) and gap[at] > 0 else 0.0



def train(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], most_positive: int = 6000, most_negative: int = 18000, most_features: int = 4096) -> Model:
    """Fit on rows of ``labels(doc_id, toxic)`` for which ``held_out`` is false.

    The bounds, documented: ``most_positive`` and ``most_negative`` labelled rows, first by a hash of their
    id and text, and the ``most_features`` features that the test likes best. Rows that repeat both teach once. The trigram model
    counts all documents.
    """
    cost = language_model(trigram_counts(docs))
    table = cost.tolist()
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    known = texts.select("id", "h").join(usable, "id").distinct()
    order = F.xxhash64("id", "h", F.lit(3))
    sample = known.where("y = 1").orderBy(order, "id", "h").limit(most_positive).union(known.where("y = 0").orderBy(order, "id", "h").limit(most_negative))
    # at most most_positive + most_negative rows of three numbers: small enough to broadcast
    rows = texts.join(F.broadcast(stored(sample, "toxicity-rows")), ["id", "h"]).groupBy("id", "h").agg(F.any_value("y").alias("y"), F.any_value("text").alias("text")).select("y", "text")
    rows = stored(rows, "toxicity-sample")  # three passes below, one over the documents

    def grams(batches):
        memo: dict[str, str] = {}

        def counted(names, hits):
            u, inv = np.unique(np.concatenate(names), return_inverse=True)
            pos = np.bincount(inv, weights=np.concatenate(hits)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos), pa.array(np.bincount(inv) - pos)], names=["name", "pos", "neg"])

        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            names, hits, held = [], [], 0
            for first, _, row, feature in features(as_table(batch, "text"), table, memo):
                r, f = ta.distinct_per_row(row + first, feature)
                names.append(f)
                hits.append(y[r])
                held += len(f)
                if held > 1_000_000:
                    yield counted(names, hits)
                    names, hits, held = [], [], 0
            if names:
                yield counted(names, hits)

    sizes = dict(rows.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 0.1) / (n1 + n0 + 1)
        return Model(cost, np.zeros(0, np.uint64), np.zeros(0), math.log(p / (1 - p)))
    tested = rows.mapInArrow(giving_back(grams), "name long, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2")
    share = n1 / (n1 + n0)
    n = F.col("pos") + F.col("neg")
    g = 2 * (
        F.col("pos") * F.log(F.col("pos") / (n * share))
        + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0)
    )
    liked = tested.withColumn("g", g).where(F.col("pos") > n * min(0.9, 2.5 * share)).where(F.col("g") > 12.0)
    top = liked.orderBy(F.desc("g"), "name").limit(most_features).select("name").collect()
    names = np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))

    def sparse(batches):
        memo: dict[str, str] = {}
        for batch in batches:
            got = present(as_table(batch, "text"), table, memo, names)
            row, col = got[0] if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cuts = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(col.astype(np.int32)))], names=["y", "on"])

    seen = rows.mapInArrow(giving_back(sparse), "y int, on array<int>").toArrow()
    y = seen.column("y").to_numpy().astype(np.float64)
    on = seen.column("on").combine_chunks()
    on = pa.concat_arrays(on.chunks) if isinstance(on, pa.ChunkedArray) else on
    lens = pc.list_value_length(on).to_numpy(zero_copy_only=False)
    w, b = fit_logistic(np.repeat(np.arange(len(y)), lens), on.flatten().to_numpy().astype(np.int64), y, max(1, len(names)))
    return Model(cost, names, w[: len(names)], b)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with every column it has and a score of its ``text`` in ``column``; no shuffle."""
    schema = docs.withColumn(column, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_features and SIZE cubed

    def of(batches):
        m = shared.value
        cost, memo = m.cost.tolist(), {}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            s = m.scores(batch.column(at).cast(pa.string()), cost, memo)
            keep = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != column]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in keep], pa.array(s)], names=[*[n for _, n in keep], column])

    return docs.mapInArrow(giving_back(of), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
