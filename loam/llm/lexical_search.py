"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

A shard holds some documents: their ids and lengths, the terms in order, and of each term the postings in blocks of ``BLOCK`` documents, each with gaps and counts in as few bytes
as its largest needs, its last document and the most that one of its documents can score for a term of weight 1; a term has the greatest of these as its bound. Nothing but a shard is
ever in a task, whatever the documents' number, and no posting is shuffled. Shards are written as a few binary values each, one a row group, so that a reader has one shard at a time
and no list becomes objects of the JVM.

A query takes its terms by their bounds, greatest first. Terms are essential as long as a document that has only them and later ones could still reach the
``k`` best found so far: their lists are read whole. For the rest, a document that already scores is looked up in the blocks' maxima, and a block is decompressed only if one of
its documents can still get there. What the shards find, ``k`` documents an item, is merged by rank.

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z lower-cased.

Defined cases: null and empty texts have no terms, are not counted as documents and are not found; items without terms find nothing; every row is a document or an item of its own, also
where ids repeat or are null (null ids last among equal scores); other columns are passed over; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, give_back, giving_back, numbered, shared_dir, stored

BLOCK = 128


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def of(batches):
        some = total = 0
        for batch in batches:
            for _, data, offsets in ta.plain_blocks(as_table(batch, "text")):
                row, _, _ = ta.runs(ta.IS_WORD[data], offsets)
                some, total = some + len(np.unique(row)), total + len(row)
        yield pa.RecordBatch.from_pydict({"documents": [some], "terms": [total]})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(of, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term of weight 1 scores in a document of ``n`` terms that holds it ``tf`` times."""
    m = 100 - 75 + 75 * n.astype(np.int64) * documents // max(terms, 1)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _widths(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes for each value of the blocks that begin at ``first``."""
    most = np.maximum.reduceat(values, first)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _packed(values: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(little-endian bytes, where each block begins)."""
    sizes = np.diff(np.append(first, len(values)))
    each = np.repeat(width, sizes)
    end = np.cumsum(each)
    out = np.zeros(int(end[-1]), np.uint8)
    for b in range(4):
        has = each > b
        out[end[has] - each[has] + b] = values[has] >> 8 * b & 255
    return out.tobytes(), np.append(0, np.cumsum(width * sizes))


#: Numbers are little-endian, of these kinds; terms are joined by spaces, which no term holds.
NUMBERS = {"lengths": "<i4", "frequencies": "<i4", "bounds": "<i4", "blocks": "<i4", "last": "<i4", "most": "<i4", "gap_at": "<i4", "gap_bytes": "<i1", "count_at": "<i4", "count_bytes": "<i1"}
SHARD = f"terms string, gaps binary, counts binary, {', '.join(f'{name} binary' for name in NUMBERS)}"


def make_shard(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, dictionary: pa.Array, lengths: np.ndarray, documents: int, total: int) -> dict:
    """Postings (document, term, times) in any order as a shard."""
    order = pc.array_sort_indices(dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[term] * len(lengths) + doc, kind="stable")
    doc, term, tf = doc[by].astype(np.int64), rank[term[by]], tf[by].astype(np.int64)
    starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    frequencies = np.diff(starts)
    per_term = -(-frequencies // BLOCK)
    blocks = np.append(0, np.cumsum(per_term))
    within = np.arange(blocks[-1]) - np.repeat(blocks[:-1], per_term)
    first = np.repeat(starts[:-1], per_term) + BLOCK * within
    last = np.append(first[1:], len(doc)) - 1
    gaps = np.diff(doc, prepend=-1)
    opens = starts[:-1]
    gaps[opens] = doc[opens] + 1  # a term's first document counts from before the first
    u = impact(tf, lengths[doc], documents, total)
    most = np.maximum.reduceat(u, first)
    gap_bytes, count_bytes = _widths(gaps, first), _widths(tf, first)
    gap_data, gap_at = _packed(gaps, first, gap_bytes)
    count_data, count_at = _packed(tf, first, count_bytes)
    return {
        "lengths": lengths, "terms": dictionary.take(pa.array(order)), "frequencies": frequencies, "bounds": np.maximum.reduceat(most, blocks[:-1]), "blocks": blocks, "last": doc[last], "most": most,
        "gap_at": gap_at, "gap_bytes": gap_bytes, "gaps": gap_data, "count_at": count_at, "count_bytes": count_bytes, "counts": count_data,
    }


def _row(shard: dict, ids: pa.Array) -> pa.RecordBatch:
    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = {"ids": one(ids), "terms": pc.binary_join(one(shard["terms"]), " "), "gaps": pa.array([shard["gaps"]], pa.binary()), "counts": pa.array([shard["counts"]], pa.binary())}
    columns |= {name: pa.array([np.asarray(shard[name]).astype(kind).tobytes()], pa.binary()) for name, kind in NUMBERS.items()}
    return pa.RecordBatch.from_pydict(columns)


def _terms(batch: pa.RecordBatch, r: int) -> pa.Array:
    return pc.split_pattern(batch.column(batch.schema.get_field_index("terms")).slice(r, 1).cast(pa.string()), " ").flatten()


def _numbers(batch: pa.RecordBatch, r: int, name: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[r].as_buffer(), NUMBERS[name])


#: A row group a shard: readers take up to a row group at once, writers keep one in memory.
ONE_A_GROUP = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False}


def index(docs: DataFrame, documents: int, total: int, most_terms: int = 2_000_000, most_documents: int = 65_536) -> DataFrame:
    """Shards of ``docs(doc_id, text)``: rows (ids, *SHARD). A shard holds whole documents, of about ``most_terms`` terms or one that has more."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        parts, ids, lengths, size, held = [], [], [], 0, 0

        def flush():
            offset = np.cumsum([0] + [len(d) for _, _, _, d in parts])
            whole = pa.concat_arrays([d for _, _, _, d in parts]).dictionary_encode()
            codes = whole.indices.to_numpy()
            term = np.concatenate([codes[t + o] for (_, t, _, _), o in zip(parts, offset[:-1], strict=True)])
            shard = make_shard(np.concatenate([p[0] for p in parts]), term, np.concatenate([p[2] for p in parts]), whole.dictionary, np.concatenate(lengths), documents, total)
            return _row(shard, pa.concat_arrays(ids))

        for batch in batches:
            for at, data, offsets in ta.plain_blocks(as_table(batch, "text")):
                inside = ta.IS_WORD[data]
                row, start, end = ta.runs(inside, offsets)
                if not len(row):
                    continue
                code, words = ta.coded(data, inside, start, end)
                n = np.bincount(row)
                some = np.flatnonzero(n)
                number = np.zeros(len(n), np.int64)
                number[some] = np.arange(len(some))
                pairs, tf = np.unique(number[row] * len(words) + code, return_counts=True)
                parts.append((pairs // len(words) + held, pairs % len(words), tf, words))
                ids.append(batch.column(0).take(pa.array(some + at)))
                lengths.append(n[some])
                size, held = size + len(row), held + len(some)
                if size >= most_terms or held >= most_documents:
                    yield flush()
                    parts, ids, lengths, size, held = [], [], [], 0, 0
                    give_back()
        if parts:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(giving_back(of), f"ids array<{kind}>, {SHARD}")


@dataclass
class Queries:
    """A block of items: its distinct terms and their weights, and the terms and their times of each item."""

    terms: pa.Array
    weights: np.ndarray
    items: list[tuple[int, list[tuple[int, int]]]]


class Postings:
    """The lists of a shard; what is decompressed is kept for the items that come after."""

    def __init__(self, shard: dict, lengths: np.ndarray, documents: int, total: int):
        self.s, self.lengths, self.of, self.total = shard, lengths, documents, total
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, b: int, opens: bool) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.block:
            s = self.s
            gaps = np.frombuffer(s["gaps"], f"<u{s['gap_bytes'][b]}", offset=s["gap_at"][b], count=(s["gap_at"][b + 1] - s["gap_at"][b]) // s["gap_bytes"][b])
            tf = np.frombuffer(s["counts"], f"<u{s['count_bytes'][b]}", offset=s["count_at"][b], count=len(gaps))
            doc = np.cumsum(gaps, dtype=np.int64) + (-1 if opens else int(s["last"][b - 1]))
            self.block[b] = doc, impact(tf, self.lengths[doc], self.of, self.total)
        return self.block[b]

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.whole:
            lo, hi = int(self.s["blocks"][t]), int(self.s["blocks"][t + 1])
            parts = [self.read(b, b == lo) for b in range(lo, hi)]
            self.whole[t] = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        return self.whole[t]


def best(postings: Postings, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that can be among the ``k`` best, for the asked (term of the shard, weight)."""
    s = postings.s
    ranked = sorted(((int(s["bounds"][t]) * w, t, w) for t, w in asked), reverse=True)
    rest = np.append(np.cumsum([b for b, _, _ in ranked][::-1])[::-1], 0)  # the most that the lists from here on can add
    score = np.zeros(len(postings.lengths), np.int64)
    least, i = 0, 0

    def reached(values: np.ndarray) -> int:
        return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0

    while i < len(ranked) and rest[i] >= max(least, 1):
        doc, u = postings.list(ranked[i][1])
        score[doc] += ranked[i][2] * u
        least = reached(score[score > 0])
        i += 1
    found = np.flatnonzero(score)
    for j in range(i, len(ranked)):
        _, t, w = ranked[j]
        found = found[score[found] + rest[j] >= least]
        lo, hi = int(s["blocks"][t]), int(s["blocks"][t + 1])
        at = lo + np.searchsorted(s["last"][lo:hi], found)
        there = at < hi
        hope = found[there][score[found[there]] + w * s["most"][at[there]].astype(np.int64) + rest[j + 1] >= least]
        for b in np.unique(lo + np.searchsorted(s["last"][lo:hi], hope)).tolist():
            doc, u = postings.read(b, b == lo)
            score[doc] += w * u * (score[doc] > 0)  # exact for what still counts; the others stay below
        least = max(least, reached(score[found]))
    return found[score[found] >= least], score[found[score[found] >= least]]


def _terms_of(texts: pa.Array) -> tuple[pa.Array, list[dict[int, int]]]:
    """(distinct terms, how often each text has each) of the texts of a block of items."""
    rows, codes, words = [], [], []
    for first, data, offsets in ta.plain_blocks(texts):
        inside = ta.IS_WORD[data]
        row, start, end = ta.runs(inside, offsets)
        code, own = ta.coded(data, inside, start, end)
        rows.append(row + first), codes.append(code + sum(map(len, words))), words.append(own)
    whole = pa.concat_arrays(words).dictionary_encode() if words else pa.array([], pa.string()).dictionary_encode()
    code = whole.indices.to_numpy()[np.concatenate(codes)] if words else np.zeros(0, np.int64)
    counts: list[dict[int, int]] = [{} for _ in range(len(texts))]
    for r, c in zip(np.concatenate(rows).tolist() if rows else [], code.tolist(), strict=True):
        counts[r][c] = counts[r].get(c, 0) + 1
    return whole.dictionary, counts


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = 512, block_bytes: int = 1 << 24, most_terms: int = 2_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    Items are asked in blocks of about ``block_items`` rows and ``block_bytes`` of text, each against every shard.
    """
    spark = docs.sparkSession
    documents, total = statistics(docs)
    shards = stored(index(docs, documents, total, most_terms), "lexical-shards", **ONE_A_GROUP)
    asked, file, row = numbered(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    held = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-held[0] // block_items), -(-(held[1] or 0) // block_bytes))
    asked = stored(asked.select("item_id", "text", F.xxhash64(file, row).alias("item"), F.pmod(F.xxhash64(file, row, F.lit(1)), F.lit(blocks)).alias("block")), "lexical-items")
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    path = f"{shared_dir(spark).rstrip('/')}/lexical-found-{uuid.uuid4().hex}"
    for b in range(blocks):
        own = asked.where(F.col("block") == b).select("item", "text").toArrow()  # bounded by the block
        terms, counts = _terms_of(own.column("text").combine_chunks().cast(pa.string()))
        counted = shards.select("terms", "frequencies").mapInArrow(_counter(spark.sparkContext.broadcast(terms)), "term int, n long")
        df = dict(counted.groupBy("term").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False, name=None))  # the terms of one block
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(terms))], np.int64)
        queries = spark.sparkContext.broadcast(Queries(terms, weights, [(i, sorted(c.items())) for i, c in zip(own.column("item").to_pylist(), counts, strict=True) if c]))
        found = shards.mapInArrow(_searcher(queries, k, documents, total), f"item long, doc_id {kind}, score long")
        found.write.mode("append").parquet(path)
    found = spark.read.schema(f"item long, doc_id {kind}, score long").parquet(path)
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(F.col("item_id").cast(item_kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _counter(wanted):
    """(number of the term, documents that hold it) of the terms of a block, summed over a task's shards."""

    def of(batches):
        terms = wanted.value
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                at = pc.index_in(_terms(batch, r), terms).fill_null(-1).to_numpy()
                n[at[at >= 0]] += _numbers(batch, r, "frequencies")[at >= 0]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "n": n[some]})

    return giving_back(of)


def _searcher(queries, k: int, documents: int, total: int):
    def of(batches):
        q = queries.value
        for batch in batches:
            for r in range(batch.num_rows):
                shard = {name: _numbers(batch, r, name) for name in NUMBERS}
                shard |= {name: batch.column(batch.schema.get_field_index(name))[r].as_buffer() for name in ("gaps", "counts")}
                ids = batch.column(batch.schema.get_field_index("ids"))[r].values
                at = pc.index_in(q.terms, _terms(batch, r)).fill_null(-1).to_numpy()
                postings, out = Postings(shard, shard["lengths"], documents, total), []
                for item, terms in q.items:
                    asked = [(int(at[t]), int(q.weights[t]) * n) for t, n in terms if at[t] >= 0]
                    if not asked:
                        continue
                    doc, score = best(postings, asked, k)
                    doc, score = doc[score > 0], score[score > 0]
                    if len(doc) > k:
                        tied = pa.table({"s": -score, "i": ids.take(pa.array(doc))})
                        keep = pc.sort_indices(tied, [("s", "ascending"), ("i", "ascending")]).to_numpy()[:k]
                        doc, score = doc[keep], score[keep]
                    out.append((np.full(len(doc), item), doc, score))
                if out:
                    item, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids.take(pa.array(doc)), pa.array(score)], names=["item", "doc_id", "score"])

    return giving_back(of)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), whole AS (SELECT count(*) FILTER (len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS total FROM docs),
held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole
), asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scores AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), whole GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
