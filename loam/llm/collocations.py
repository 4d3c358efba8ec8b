"""Phrases mined with weighted acyclic automata.

An automaton maps phrases to counts: its arcs carry a word and the count of the phrase that ends with it, the first arc carries the language. A task sorts the n-grams of a
shard of its texts and makes one automaton for each range of prefixes (hashes of language and first two words, cut in even intervals, so that no frequent first word makes a large
range). The automata of a range, a few megabytes from every shard, meet in one task, which unites them a few at a time: counts of equal paths add up, and states of one depth with equal arcs are one
state. Arcs below the least count go, and with them all that could follow.

A phrase is as frequent as its words and its pairs are, at least. So words are counted first; pairs only of frequent words; longer phrases only where all their pairs are
frequent. What is frequent reaches the tasks as a bitmap of hashes of bounded size: a false hit costs a count that the union drops, and nothing frequent is ever missed.

The counts of a phrase's parts are found by composing the automaton of their range with the parts, so every part, a frequent phrase too, is asked for once.

Words and pieces: A-Z is lower-cased, pieces end at ``.,;:!?`` and line ends (U+000A to U+000D), words are what spaces and tabs part. All counts are exact integers; scores are
computed in decimals of 38 digits.

Defined cases: a null text is empty, a null language is ``und``; empty texts and pieces give nothing; repeated rows count each; null ids and other columns are passed over; a
language without phrases has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, stored

LONGEST = 5
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_STOP
_WORD[[32, 9]] = False
U = np.uint64


@dataclass
class Words:
    """Words of a shard: number of each in ``dictionary``, number of its language, and whether it goes on with the piece of the word before."""

    code: np.ndarray
    lang: np.ndarray
    follows: np.ndarray
    dictionary: pa.Array
    langs: list[str]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, word) pairs, and the number of each word's pair."""
        n, pair = len(self.dictionary), self.lang * len(self.dictionary) + self.code
        if len(self.langs) * n <= 16 * len(pair):
            some = np.flatnonzero(np.bincount(pair, minlength=len(self.langs) * n))
            number = np.empty(len(self.langs) * n, np.int64)
            number[some] = np.arange(len(some))
            return some // n, some % n, number[pair]
        some, number = np.unique(pair, return_inverse=True)
        return some // n, some % n, number

    def sorted(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words and languages in order, place of each word there, place of each language)."""
        whole = pa.concat_arrays([self.dictionary, pa.array(self.langs, pa.string())]).dictionary_encode()
        order = pc.array_sort_indices(whole.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[whole.indices.to_numpy()]
        return whole.dictionary.take(pa.array(order)), place[: len(self.dictionary)], place[len(self.dictionary) :]


def hashes(lang: pa.Array, word: pa.Array) -> np.ndarray:
    """A hash of each (language, word)."""
    with np.errstate(over="ignore"):
        return ta.mix(_each(word) + _each(lang) * U(0x9E3779B97F4A7C15))


def _each(strings: pa.Array) -> np.ndarray:
    d = strings.dictionary_encode()
    body, at = d.dictionary.buffers()[2], np.frombuffer(d.dictionary.buffers()[1], np.int32)[d.dictionary.offset : d.dictionary.offset + len(d.dictionary) + 1].tolist()
    data = memoryview(body if body is not None else b"")
    own = np.array([xxhash.xxh3_64_intdigest(data[lo:hi]) for lo, hi in zip(at, at[1:])], U)  # noqa: B905
    return own[d.indices.to_numpy()] if len(own) else own


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first << U(1)) | (first >> U(63))) ^ second


def range_of(pair: np.ndarray, ranges: int) -> np.ndarray:
    return ((pair >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _shards(batches, most_words: int) -> Iterator[Words]:
    """Shards of whole texts of about ``most_words`` words, or a single one of more."""
    parts, size = [], 0

    def joined() -> Words:
        whole = pa.concat_arrays([p.dictionary for p in parts]).dictionary_encode()
        of, langs, at = whole.indices.to_numpy().astype(np.int64), {}, 0
        code, lang = [], []
        for p in parts:
            code.append(of[at + p.code])
            at += len(p.dictionary)
            lang.append(np.array([langs.setdefault(v, len(langs)) for v in p.langs], np.int64)[p.lang])
        return Words(np.concatenate(code), np.concatenate(lang), np.concatenate([p.follows for p in parts]), whole.dictionary, list(langs))

    for batch in batches:
        langs = as_table(batch, "lang").dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
        for first, data, offsets in ta.plain_blocks(as_table(batch, "text"), 1 << 21):
            inside = _WORD[data]
            row, start, end = ta.runs(inside, offsets)
            if not len(row):
                continue
            code, dictionary = ta.coded(data, inside, start, end)
            stops = np.concatenate([[0], np.cumsum(_STOP[data])])
            follows = np.zeros(len(row), bool)
            follows[1:] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
            parts.append(Words(code.astype(np.int64), of_row[row + first], follows, dictionary, names))
            size += len(row)
            if size >= most_words:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()
    parts.clear()
    pa.default_memory_pool().release_unused()  # the worker lives on


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(rows: DataFrame, most_words: int) -> DataFrame:
    """(lang, word, f) of all words of ``rows(lang, text)``."""

    def of(batches):
        for s in _shards(batches, most_words):
            lang, code, number = s.distinct()
            yield pa.RecordBatch.from_arrays([pa.array(s.langs, pa.string()).take(pa.array(lang)), s.dictionary.take(pa.array(code)), pa.array(np.bincount(number))], names=["lang", "word", "f"])

    return rows.mapInArrow(of, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


# Automata

Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # of each node of one depth: its parent (a node of the depth before), label, weight; in order of parent and label


@dataclass
class Automaton:
    """State ``s`` has the arcs ``begin[s]`` to ``begin[s + 1]`` in order of their labels, which number ``words`` (sorted); state 0 is the end, the last one the start."""

    words: pa.Array
    begin: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, levels: list[Level]) -> Automaton:
        """States from the last depth to the first; equal lists of arcs become one state. Hashes propose equals, the arcs themselves decide."""
        begin, arcs, states = [np.zeros(2, np.int64)], [], 1
        below = np.zeros(len(levels[-1][0]) if levels else 0, np.int64)  # states of the nodes of the depth below
        for d in range(len(levels) - 1, -1, -1):
            parent, label, weight = levels[d]
            nodes = len(levels[d - 1][0]) if d else 1
            counts = np.bincount(parent, minlength=nodes)
            start = np.cumsum(counts) - counts
            at = np.arange(len(parent)) - start[parent]
            with np.errstate(over="ignore"):
                each = ta.mix(label.astype(U) * U(0x9E3779B97F4A7C15) + weight.astype(U) * U(0xC2B2AE3D27D4EB4F) + below.astype(U) * U(0x165667B19E3779F9) + at.astype(U))
                sums = np.concatenate([[U(0)], np.cumsum(each)])
                key = ta.mix(sums[start + counts] - sums[start] + counts.astype(U))
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            like = first[inverse]
            other = counts[like] != counts
            twin = np.minimum(start[like[parent]] + at, max(0, len(parent) - 1))
            unequal = (label != label[twin]) | (weight != weight[twin]) | (below != below[twin])
            other[parent[unequal]] = True
            like = np.where(other, np.arange(nodes), like)
            keep = np.flatnonzero((like == np.arange(nodes)) & (counts > 0))
            number = np.zeros(nodes, np.int64)
            number[keep] = states + np.arange(len(keep))
            use = _spans(start[keep], counts[keep])
            arcs.append((label[use], weight[use], below[use]))
            begin.append(begin[-1][-1] + np.cumsum(counts[keep]))
            states += len(keep)
            below = np.where(counts > 0, number[like], 0)
        label, weight, target = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
        return cls(words, np.concatenate(begin), label, weight, target)

    def unfolded(self) -> list[Level]:
        """The tree of its paths."""
        out, nodes = [], np.array([len(self.begin) - 2])
        while True:
            counts = self.begin[nodes + 1] - self.begin[nodes]
            use = _spans(self.begin[nodes], counts)
            if not len(use):
                return out
            out.append((np.repeat(np.arange(len(nodes)), counts), self.label[use], self.weight[use]))
            nodes = self.target[use]

    def paths(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(labels of each depth, weight) of the paths of each length."""
        path: list[np.ndarray] = []
        for parent, label, weight in self.unfolded():
            path = [*[p[parent] for p in path], label]
            yield path, weight

    def composed(self, labels: list[np.ndarray]) -> np.ndarray:
        """The weights of paths, given by their labels at each depth (-1: the path has ended before; -2: no such word); 0 where there is none."""
        size = len(self.words) + 1
        key = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin)) * size + self.label
        state = np.full(len(labels[0]), len(self.begin) - 2)
        weight = np.zeros(len(state), np.int64)
        for col in labels:
            on = np.flatnonzero(col != -1)
            want = state[on] * size + col[on]
            at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            there = (key[at] == want) & (col[on] >= 0) if len(key) else np.zeros(len(on), bool)
            weight[on] = np.where(there, self.weight[at], 0) if len(key) else 0
            state[on] = np.where(there, self.target[at], 0) if len(key) else 0
        return weight


def _spans(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all the spans in a row."""
    total = int(counts.sum())
    return np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(total)


def counted(columns: list[np.ndarray], size: int, weighs_from: int) -> list[Level]:
    """The tree of n-grams that are given by their labels at each depth, -1 after the last; arcs before depth ``weighs_from`` have weight 0."""
    out, node, alive = [], np.zeros(len(columns[0]), np.int64), np.arange(len(columns[0]))
    for d, col in enumerate(columns):
        on = col[alive] >= 0
        alive, node = alive[on], node[on]
        if not len(alive):
            break
        keys, node, times = np.unique(node * size + col[alive], return_inverse=True, return_counts=True)
        out.append((keys // size, keys % size, times if d >= weighs_from else np.zeros(len(keys), np.int64)))
    return out


def united(automata: list[Automaton], least: int = 0, weighs_from: int = 0) -> Automaton:
    """One automaton with the sums of all; of arcs from depth ``weighs_from`` on only those that weigh ``least``, of earlier ones those that lead to such."""
    whole = pa.concat_arrays([a.words for a in automata]).dictionary_encode()
    order = pc.array_sort_indices(whole.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    renamed, words, at = rank[whole.indices.to_numpy()], whole.dictionary.take(pa.array(order)), 0
    trees, nodes, shift = [], [], []
    for a in automata:
        trees.append(a.unfolded())
        shift.append(at)
        nodes.append(np.zeros(1, np.int64))
        at += len(a.words)
    levels: list[Level] = []
    for d in range(max(map(len, trees), default=0)):
        some = [k for k, t in enumerate(trees) if len(t) > d]
        keys = [nodes[k][trees[k][d][0]] * len(order) + renamed[shift[k] + trees[k][d][1]] for k in some]
        merged, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.zeros(len(merged), np.int64)
        np.add.at(weight, inverse, np.concatenate([trees[k][d][2] for k in some]))
        at = 0
        for k, own in zip(some, keys, strict=True):
            nodes[k] = inverse[at : at + len(own)]
            at += len(own)
        levels.append((merged // len(order), merged % len(order), weight))
    if not least:
        return Automaton.of(words, levels)
    keep = [np.zeros(len(x[0]), bool) for x in levels]
    for d in range(len(levels) - 1, -1, -1):
        if d >= weighs_from:
            keep[d] |= levels[d][2] >= least
        if d:
            keep[d - 1][levels[d][0][keep[d]]] = True
    number, out = np.zeros(1, np.int64), []
    for (parent, label, weight), k in zip(levels, keep, strict=True):
        out.append((number[parent[k]], label[k], weight[k]))
        number = np.cumsum(k) - 1
    while out and not len(out[-1][0]):
        out.pop()
    used = np.unique(np.concatenate([x[1] for x in out])) if out else np.zeros(0, np.int64)
    return Automaton.of(words.take(pa.array(used)), [(p, np.searchsorted(used, x), w) for p, x, w in out])


AUTOMATON = "range int, size int, automaton binary"
_CODEC = "zstd"


def _planes(v: np.ndarray, kind: str) -> bytes:
    """Numbers as their lowest bytes, then their next ones: small numbers are mostly zeros, which pack well."""
    return np.ascontiguousarray(v.astype(kind).view(np.uint8).reshape(len(v), np.dtype(kind).itemsize).T).tobytes()


def _batch(number: int, a: Automaton) -> pa.RecordBatch:
    """An automaton as one packed row: words, then arcs a state, labels by their steps within a state, weights and targets."""
    counts = np.diff(a.begin)
    step = np.diff(a.label, prepend=0)
    opens = a.begin[:-1][counts > 0]
    step[opens] = a.label[opens]
    at = np.frombuffer(a.words.buffers()[1], np.int32)[a.words.offset : a.words.offset + len(a.words) + 1]
    body = a.words.buffers()[2]
    text = memoryview(body)[int(at[0]) : int(at[-1])].tobytes() if body is not None and len(at) else b""
    head = np.array([len(a.words), len(text), len(counts), len(step)], "<i8").tobytes()
    raw = b"".join([head, _planes(np.diff(at), "<u4"), text, _planes(counts, "<u4"), _planes(step, "<i4"), _planes(a.weight, "<i8"), _planes(a.target, "<u4")])
    packed = pa.Codec(_CODEC, compression_level=3).compress(raw, asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(raw)], pa.int32()), pa.array([packed], pa.binary())], names=["range", "size", "automaton"])


def _automata(batch) -> Iterator[tuple[int, Automaton]]:
    codec = pa.Codec(_CODEC)
    for number, size, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw = codec.decompress(packed.as_buffer(), size, asbytes=True)
        n_words, n_text, n_states, n_arcs = np.frombuffer(raw, "<i8", 4).tolist()
        at = 32

        def numbers(n: int, kind: str, raw=raw) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize
            v = np.frombuffer(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.tobytes(), kind)
            at += n * width
            return v.astype(np.int64)

        ends = np.append(0, np.cumsum(numbers(n_words, "<u4"))).astype(np.int32)
        words = pa.StringArray.from_buffers(n_words, pa.py_buffer(ends), pa.py_buffer(raw[at : at + n_text]))
        at += n_text
        begin = np.append(0, np.cumsum(numbers(n_states, "<u4")))
        step, weight, target = numbers(n_arcs, "<i4"), numbers(n_arcs, "<i8"), numbers(n_arcs, "<u4")
        sums = np.append(0, np.cumsum(step))
        label = sums[1:] - np.repeat(sums[begin[:-1]], np.diff(begin))
        yield number, Automaton(words, begin, label, weight, target)


def _by_range(s: Words, columns: list[np.ndarray], prefix: np.ndarray, ranges: int, weighs_from: int) -> Iterator[pa.RecordBatch]:
    """The automata of a shard's n-grams: words in ``columns`` after the language, ``prefix`` hashes of the first two."""
    own = range_of(prefix, ranges)
    order = np.argsort(own.astype(np.uint16) if ranges < 1 << 16 else own, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(own, minlength=ranges)))
    names, word, lang = s.sorted()
    columns = [lang[columns[0]], *[np.where(c >= 0, word[np.maximum(c, 0)], -1) for c in columns[1:]]]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[k] : cuts[k + 1]]
        cols = [c[at] for c in columns]
        used = np.unique(np.concatenate(cols))
        used = used[used >= 0]  # in order, so a smaller number is an earlier word
        cols = [np.where(c >= 0, np.searchsorted(used, c), -1) for c in cols]
        yield _batch(k, Automaton.of(names.take(pa.array(used)), counted(cols, len(used), weighs_from)))


def union_ranges(shards: DataFrame, ranges: int, least: int, weighs_from: int, most_arcs: int = 500_000) -> DataFrame:
    """One automaton a range; rows of a range come one after the other, and are united when they have ``most_arcs`` arcs together."""

    def of(batches):
        number, held, arcs, bound = None, [], 0, most_arcs
        for batch in batches:
            for n, a in _automata(batch):
                if n != number and held:
                    yield _batch(number, united(held, least, weighs_from))
                    held, arcs, bound = [], 0, most_arcs
                number = n
                held.append(a)
                arcs += len(a.label)
                if arcs > bound and len(held) > 1:
                    held = [united(held)]
                    arcs = len(held[0].label)
                    bound = max(most_arcs, 2 * arcs)
        if held:
            yield _batch(number, united(held, least, weighs_from))
        held.clear()
        pa.default_memory_pool().release_unused()

    return shards.repartition(min(ranges, 100_000), "range").sortWithinPartitions("range").mapInArrow(of, AUTOMATON)


# What is frequent, as bits

def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """``positions(h)``: a map of 2^``bits`` bits with those of the hashes' low bits set."""
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = positions.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63L as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2^bits / 64 rows at most
    out = np.zeros(1 << bits - 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(U)


def hit(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U(len(found) * 64 - 1)
    return (found[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def bits_for(n: int, most_bits: int) -> int:
    return min(most_bits, max(10, (16 * n).bit_length()))


def phrase_automata(docs: DataFrame, least: int = 100, most_words: int = 1_000_000, range_words: int = 2_000_000, most_bits: int = 28) -> tuple[DataFrame, DataFrame, int]:
    """(words (lang, word, f), automata of the phrases of 2 to ``LONGEST`` words that occur ``least`` times, number of ranges).

    ``most_bits`` bounds the bitmaps (2^28 bits are 32 MB); beyond that more n-grams are counted than need be.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    words = stored(word_counts(rows, most_words), "phrase-words")
    frequent = words.where(F.col("f") >= least)
    n, total = frequent.agg(F.count("*")).first()[0], words.agg(F.sum("f")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_words))

    def word_hashes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(as_table(batch, "lang"), as_table(batch, "word")).view(np.int64))], names=["h"])

    known = spark.sparkContext.broadcast(bitmap(frequent.mapInArrow(word_hashes, "h long"), bits_for(n, most_bits)))  # at most 2^most_bits bits

    def marked(s: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, where a pair of frequent words begins)."""
        lang, code, number = s.distinct()
        own = hashes(pa.array(s.langs, pa.string()).take(pa.array(lang)), s.dictionary.take(pa.array(code)))
        some = hit(found, own)[number]
        return own[number], np.flatnonzero(some[:-1] & some[1:] & s.follows[1:])

    def pairs(batches):
        for s in _shards(batches, most_words):
            h, at = marked(s, known.value)
            yield from _by_range(s, [s.lang[at], s.code[at], s.code[at + 1]], pair_hash(h[at], h[at + 1]), ranges, 2)

    two = stored(union_ranges(rows.mapInArrow(pairs, AUTOMATON), ranges, least, 2), "phrase-pairs")

    def pair_hashes(batches):
        for batch in batches:
            for _, a in _automata(batch):
                for path, _ in a.paths():
                    if len(path) == 3:
                        lang, one, other = (a.words.take(pa.array(p)) for p in path)
                        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(hashes(lang, one), hashes(lang, other)).view(np.int64))], names=["h"])

    found = stored(two.mapInArrow(pair_hashes, "h long"), "phrase-pair-hashes")
    linked = spark.sparkContext.broadcast(bitmap(found, bits_for(found.count(), most_bits)))  # at most 2^most_bits bits

    def longer(batches):
        for s in _shards(batches, most_words):
            h, at = marked(s, known.value)
            pair = np.zeros(len(h) + LONGEST, bool)
            pair[at[hit(linked.value, pair_hash(h[at], h[at + 1]))]] = True
            at = np.flatnonzero(pair[:-1] & pair[1:])
            code = np.concatenate([s.code, np.zeros(LONGEST, np.int64)])
            columns, on = [s.lang[at], s.code[at], code[at + 1], code[at + 2]], np.ones(len(at), bool)
            for d in range(3, LONGEST):
                on = on & pair[at + d - 1]
                columns.append(np.where(on, code[at + d], -1))
            yield from _by_range(s, columns, pair_hash(h[at], h[np.minimum(at + 1, len(h) - 1)]), ranges, 3)

    all_lengths = rows.mapInArrow(longer, AUTOMATON).unionByName(two)
    return words, stored(union_ranges(all_lengths, ranges, least, 2), "phrase-automata"), ranges


def phrases(automata: DataFrame) -> DataFrame:
    """(lang, words, f) of every phrase in the automata."""

    def of(batches):
        for batch in batches:
            for _, a in _automata(batch):
                for path, weight in a.paths():
                    if len(path) > 2:
                        flat = np.stack(path[1:], axis=1).ravel()
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(path) - 1), pa.int32()), a.words.take(pa.array(flat)))
                        yield pa.RecordBatch.from_arrays([a.words.take(pa.array(path[0])), lists, pa.array(weight)], names=["lang", "words", "f"])

    return automata.mapInArrow(of, "lang string, words array<string>, f long")


def weights(requests: DataFrame, automata: DataFrame, ranges: int) -> DataFrame:
    """(lang, words, f) of ``requests(lang, words)``, each once and of two words or more, from the automaton of their range."""

    def with_range(batches):
        for batch in batches:
            lang, lists = as_table(batch, "lang"), batch.column(1)
            first, second = (hashes(lang, pc.list_element(lists, k).cast(pa.string())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of(pair_hash(first, second), ranges), pa.int32())], names=["lang", "words", "range"])

    asked = requests.select("lang", "words").mapInArrow(with_range, "lang string, words array<string>, range int")

    def of(asked: pa.Table, automata: pa.Table) -> pa.Table:
        weight = np.zeros(asked.num_rows, np.int64)
        lang, lists = (asked.column(c).combine_chunks() for c in ("lang", "words"))
        for batch in automata.to_batches():
            for _, a in _automata(batch):
                words = pc.index_in(lists.flatten().cast(pa.string()), a.words).fill_null(-2).to_numpy()
                size = np.asarray(pc.list_value_length(lists))
                start = np.cumsum(size) - size
                labels = [pc.index_in(lang.cast(pa.string()), a.words).fill_null(-2).to_numpy()]
                for d in range(int(size.max(initial=0))):
                    labels.append(np.where(size > d, words[np.minimum(start + d, max(0, len(words) - 1))], -1))
                weight += a.composed(labels)
        return pa.table({"lang": lang, "words": lists, "f": pa.array(weight)})

    return asked.groupBy("range").cogroup(automata.groupBy("range")).applyInArrow(of, "lang string, words array<string>, f long")


#: floor(1000 a n / (l r)), exact: the products have up to 38 digits.
SCORE = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(15, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` phrases of each language whose parts attract each other most."""
    words, automata, ranges = phrase_automata(docs, least, **options)
    said = lambda c: F.array_join(c, " ")
    found = phrases(automata).select("lang", said("words").alias("phrase"), "words", F.col("f").alias("a"))
    cut = found.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    halves = stored(cut.select("lang", "phrase", "a", "k", F.size("words").alias("m"), F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right")), "phrase-cuts")
    parts = halves.select("lang", F.explode(F.array("left", "right")).alias("words")).distinct()
    single = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f")
    known = stored(weights(parts.where("size(words) > 1"), automata, ranges).select("lang", said("words").alias("part"), "f").unionByName(single), "phrase-parts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    side = lambda name, f: known.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    cuts = halves.select("lang", "phrase", "a", "k", "m", said("left").alias("left"), said("right").alias("right")).join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = stored(cuts.withColumn("score", F.expr(SCORE)), "phrase-scores")
    ends = cuts.where("m > 2").select("lang", F.explode(F.expr("filter(array(if(k = m - 1 and l <= a, left, null), if(k = 1 and r <= a, right, null)), x -> x is not null)")).alias("phrase")).distinct()
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"))
    left = lowest.join(ends, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS f FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k AS m, g AS phrase, string_split(g, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM found),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.k AND x.g = array_to_string(w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.m - c.k AND y.g = array_to_string(w[c.k + 1 :], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM found q WHERE q.lang = p.lang AND q.a * 100 >= p.a * 100 AND len(q.phrase) > len(p.phrase) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
