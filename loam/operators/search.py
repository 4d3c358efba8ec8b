"""Stages of a retrieval, each a DataFrame in, a DataFrame out.

``scored`` and ``retrieve`` answer one query; the stages after scoring take columns to group by, so they also work on the hits of many,
and ``batch_topk`` scores many at once. Ranking is total: score down, then path, chunk number and chunk id up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions import vectors as vx

def order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("rel_path"), F.asc("chunk_index"), F.asc("chunk_id")]


@dataclass(frozen=True)
class Options:
    """Settings of a retrieval. 0 means the default; below 0 turns a threshold off and gives lambda 1."""

    limit: int = 10
    window: int = 0
    alpha: float = 0.0
    delta: float = 0.0
    mmr_lambda: float = 0.0
    tag_weight: float = 0.3
    unique_files: bool = True
    rerank: str = "off"
    mmr: bool = False

    def normalized(self) -> Options:
        if self.rerank not in ("off", "bm25"):
            raise ValueError("rerank must be off or bm25")
        if not 0 <= self.tag_weight <= 1:
            raise ValueError("tag_weight must lie in 0 .. 1")
        limit = self.limit if self.limit > 0 else 10
        window = max(self.window, limit) if self.window > 0 else max(5 * limit, 20)
        lam = 0.5 if self.mmr_lambda == 0 else self.mmr_lambda if 0 < self.mmr_lambda <= 1 else 1.0
        default = lambda v, d: d if v == 0 else max(v, 0.0)
        return Options(limit, window, default(self.alpha, 0.85), default(self.delta, 0.1), lam, self.tag_weight, self.unique_files, self.rerank, self.mmr)


def filtered(chunks: DataFrame, tags: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Rows that have all ``tags`` and lie under ``prefix``; the prefix reaches the scan."""
    out = chunks
    if tags:
        wanted = tx.normalize_tags(F.array(*[F.lit(t) for t in tags]))
        out = out.where(tx.has_all(F.transform("tags", lambda t: F.lower(tx.strip(t))), wanted))
    return out.where(tx.under(F.col("rel_path"), prefix)) if prefix else out


def scored(chunks: DataFrame, query: Sequence[float], query_tags: Sequence[float] | None = None, tag_weight: float = 0.3) -> DataFrame:
    """``chunks`` with content_score, tag_score (null without both tag vectors) and the fused score."""
    content = vx.cosine(F.col("vector"), vx.literal(query))
    out = chunks.withColumn("content_score", content)
    if query_tags is None or "tag_vector" not in chunks.columns or tag_weight <= 0:
        return out.withColumn("tag_score", F.lit(None).cast("double")).withColumn("score", F.col("content_score"))
    there = F.size("tag_vector") == len(query_tags)
    out = out.withColumn("tag_score", F.when(there, vx.cosine(F.col("tag_vector"), vx.literal(query_tags))))
    return out.withColumn("score", vx.fused(F.col("content_score"), F.col("tag_score"), tag_weight))


def ranked(df: DataFrame, *by: str, score: str = "score") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order(score))).cast("int"))


def top(df: DataFrame, k: int, *by: str, score: str = "score") -> DataFrame:
    """The first ``k`` of each group, ranked; without groups a bounded heap per task instead of a window."""
    if by:
        return ranked(df, *by, score=score).where(F.col("rank") <= k)
    return ranked(df.orderBy(*order(score)).limit(k), score=score)


def threshold(df: DataFrame, alpha: float, delta: float, *by: str) -> DataFrame:
    """Rank 1 stays; others need ``alpha`` of its score and a gap to it of ``delta`` at most; 0 turns a rule off.

    The best row of each group is an aggregate, combined before it is shuffled, and joined back: no group is sorted in one task.
    """
    keys = list(by) or ["__g"]
    rows = df if by else df.withColumn("__g", F.lit(1))
    place = F.struct((-F.col("score")).alias("down"), "rel_path", "chunk_index", "chunk_id")
    best = rows.groupBy(*keys).agg(F.min(place).alias("__best"))
    top_score = -F.col("__best.down")
    keep = F.lit(True)
    if alpha > 0:
        keep = keep & (F.col("score") >= alpha * top_score)
    if delta > 0:
        keep = keep & (top_score - F.col("score") <= delta)
    return rows.join(best, keys).where((place == F.col("__best")) | keep).select(*df.columns)


def unique(df: DataFrame, *by: str) -> DataFrame:
    """The best row of each file."""
    w = W.partitionBy(*by, "rel_path").orderBy(*order())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def seeded(df: DataFrame) -> DataFrame:
    """Hits whose content and first scores are told: both are the score where nothing else set them."""
    for c in ("content_score", "pre_rerank_score"):
        df = df.withColumn(c, F.coalesce(c, "score") if c in df.columns else F.col("score"))
    return df


def fusion_gate(text: Column, n_tags: Column, tag_weight: Column, no_tag: Column, file_type: Column, shortest: int = 4) -> Column:
    """Do the tags of a query count? Not if that is off, for images, for texts of under ``shortest`` characters, or without any tag."""
    return ~no_tag & (tag_weight > 0) & (F.lower(tx.strip(file_type)) != "image") & (F.length(tx.strip(text)) >= shortest) & (n_tags > 0)


def batch_topk(chunks: DataFrame, queries: DataFrame, k: int, most_queries: int = 20_000, block_bytes: int = 1 << 26, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query, exactly.

    The queries are a stated set, of vectors of one length. Up to ``most_queries`` they go to every task as one matrix; more are taken in as many
    rounds. Each task keeps its own best ``k`` per query, in products of ``block_bytes`` at most; a window over those rows ends it.
    A null or zero vector, one with a null component or one of another length than the queries scores 0, as in ``vectors.cosine``. Ids are
    whole numbers or strings.
    """
    n = queries.count()
    rounds = max(1, -(-n // most_queries))
    out = None
    for r in range(rounds):
        part = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        got = part.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        lists = got.column("vector").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = set(pc.list_value_length(lists).drop_null().to_pylist()) - {0}
        if len(lengths) > 1:
            raise ValueError(f"queries of different lengths: {sorted(lengths)[:5]}")
        shared = chunks.sparkSession.sparkContext.broadcast((_plain(got.column("query_id").combine_chunks()), _matrix(lists, max(lengths, default=1))))
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        found = chunks.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
            _nearest(shared, k, block_bytes, exclude_self), f"query_id {kind(queries, 'query_id')}, vec_id {kind(chunks, 'vec_id')}, score double"
        )
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    return out.select("query_id", "rank", "vec_id", "score")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The lists as unit rows; one that is not ``dim`` numbers is a row of zeros."""
    out = _numbers(lists, dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _numbers(lists: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows; one that is not ``dim`` numbers is a row of zeros."""
    out = np.zeros((len(lists), dim))
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    fine = np.flatnonzero((np.diff(offsets) == dim) & np.asarray(lists.is_valid()))
    out[fine] = values[offsets[fine][:, None] + np.arange(dim)]
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def _plain(ids: pa.Array) -> np.ndarray:
    """Ids as numpy: whole numbers, or the bytes of strings, which have the strings' order."""
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.array([i.encode() for i in ids.to_pylist()], dtype=np.bytes_)
    return ids.to_numpy(zero_copy_only=False)


def _told(ids: np.ndarray) -> pa.Array:
    return pa.array([i.decode() for i in ids.tolist()], pa.string()) if ids.dtype.kind == "S" else pa.array(ids)


def _nearest(shared, k: int, block_bytes: int, exclude_self: bool):
    def of(batches):
        qid, q = shared.value
        rows, ids, scores = np.zeros(0, np.int64), None, np.zeros(0)
        floor = np.full(len(q), -np.inf)  # the k-th best score of each query so far
        block = max(k, block_bytes // (8 * max(1, len(q))), 1)
        for batch in batches:
            own_ids, x = _plain(batch.column(0)), _matrix(batch.column(1), q.shape[1])
            ids = own_ids[:0] if ids is None else ids
            for lo in range(0, len(x) if len(q) else 0, block):
                own = own_ids[lo : lo + block]
                s = q @ x[lo : lo + block].T
                if exclude_self and qid.dtype.kind == own.dtype.kind:
                    s[qid[:, None] == own[None, :]] = -np.inf
                least = floor if s.shape[1] <= k else np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))  # ties stay in until the ids decide
                rows, ids, scores = np.concatenate([rows, i]), np.concatenate([ids, own[j]]), np.concatenate([scores, s[i, j]])
                order = np.lexsort((ids, -scores, rows))
                rows, ids, scores = rows[order], ids[order], scores[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                floor[rows[nth == k - 1]] = scores[nth == k - 1]
                rows, ids, scores = (a[nth < k] for a in (rows, ids, scores))
        if ids is not None:
            yield pa.RecordBatch.from_arrays([_told(qid[rows]), _told(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return of


@dataclass
class Asked:
    """A block of queries of one kind of collection: what a task needs to answer them."""

    vectors: np.ndarray  # rows, zeros for one that is no vector of the collection's length
    tag_vectors: np.ndarray  # rows, zeros for a query without tags
    fused: np.ndarray  # has the query a tag vector?
    scopes: np.ndarray  # queries x collections
    collections: list[str]
    paths: list[str]  # distinct prefixes
    path: np.ndarray  # the prefix of each query, len(paths) or -1 for none
    tags: list[str]  # distinct tags that are asked for
    wanted: np.ndarray  # queries x tags


HIT = "query int, collection_id string, rel_path string, chunk_index int, chunk_id string, content_score double, tag_score double, score double, level double"


def level(score: np.ndarray) -> np.ndarray:
    """Scores to nine decimals, by which the hits of a batch rank: vectors of one direction score alike but for the last bits, so they tie here and their places decide."""
    return np.copysign(np.floor(np.abs(score) * 1e9 + 0.5), score) / 1e9


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows have equal products wherever they stand."""
    return (a * b).sum(axis=1)


def _over(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.divide(x, by, out=np.zeros(x.shape), where=by > 0)


def masked_topk(chunks: DataFrame, asked: Asked, k: int, tag_weight: float, carry: Sequence[str] = (), block_bytes: int = 1 << 28) -> DataFrame:
    """``HIT`` and the columns ``carry``: the ``k`` best chunks of every query in each of its collections, among those under its path that have all its tags.

    The queries go to every task. Of a block of chunks, whose scores with all queries would fill ``block_bytes``, each distinct vector is scored once, for the queries of one path and one set of
    tags over the chunks that these allow. Products in single precision only pass over what lies below a query's floor, the k-th best that the task has found for it so far, by more than their
    error; all else is scored in double precision. A task keeps ``k`` rows a query and collection, by level, path, number and id. The caller ends it with a window.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(asked)
    place = [("rel_path", "ascending"), ("chunk_index", "ascending"), ("chunk_id", "ascending")]
    names = ["collection_id", "rel_path", "chunk_index", "chunk_id", "tags", "vector", "tag_vector", *carry]
    shown = list(dict.fromkeys(["collection_id", "rel_path", "chunk_index", "chunk_id", *carry]))

    def of(batches):
        a, best = shared.value, _Best(k, place)
        dims = a.vectors.shape[1], a.tag_vectors.shape[1]
        lengths, tag_lengths = (np.sqrt(_dots(x, x)) for x in (a.vectors, a.tag_vectors))
        content, tag = _over(a.vectors, lengths[:, None]), _over(a.tag_vectors, tag_lengths[:, None])
        some = bool(a.fused.any())
        w = np.where(a.fused, tag_weight, 0.0)[:, None]
        plain = np.hstack([content, np.zeros(tag.shape)] if some else [content]).astype(np.float32)
        mixed = np.hstack([(1 - w) * content, w * tag]).astype(np.float32) if some else plain
        slack = 1.2e-7 * (sum(dims) + 8) + 2e-9  # twice the error of a product of unit rows, and of a level
        floor = np.full((len(a.vectors), len(a.collections)), -np.inf)
        groups: dict[tuple, list[int]] = {}
        for i, (p, x) in enumerate(zip(a.path.tolist(), a.wanted, strict=True)):
            groups.setdefault((p % (len(a.paths) + 1), x.tobytes()), []).append(i)
        alike = [(p, np.flatnonzero(a.wanted[own[0]]), np.array(own)) for (p, _), own in groups.items()]
        block = max(1, block_bytes // (8 * max(1, len(a.vectors))))

        def exact(q: np.ndarray, x: np.ndarray, v, t, there) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(content score, tag score or NaN, score) of pairs of queries and rows."""
            both = a.fused[q] & there[x]
            told = np.full(len(q), np.nan)
            said = np.empty(len(q))
            step = max(1, (1 << 22) // max(1, sum(dims)))
            for lo in range(0, len(q), step):
                i, j = q[lo : lo + step], x[lo : lo + step]
                said[lo : lo + step] = _over(_dots(a.vectors[i], v[0][j]), lengths[i] * v[1][j])
                i, j, at = i[both[lo : lo + step]], j[both[lo : lo + step]], lo + np.flatnonzero(both[lo : lo + step])
                told[at] = _over(_dots(a.tag_vectors[i], t[0][j]), tag_lengths[i] * t[1][j])
            return said, told, np.where(both, (1 - tag_weight) * said + tag_weight * np.where(both, told, 0.0), said)

        for batch in batches:
            for lo in range(0, batch.num_rows if len(a.vectors) else 0, block):
                table = pa.Table.from_batches([batch.slice(lo, block)])
                table = table.take(pc.sort_indices(table, place)).combine_chunks()
                col = lambda c, table=table: table.column(c).combine_chunks()
                where = pc.index_in(col("collection_id"), pa.array(a.collections, pa.string())).fill_null(-1).to_numpy()
                paths, lists, under = col("rel_path"), col("tags"), {len(a.paths): np.ones(table.num_rows, bool)}
                v = _lengthed(col("vector"), dims[0])
                t = _lengthed(col("tag_vector"), dims[1]) if some else (np.zeros((table.num_rows, dims[1])), np.zeros(table.num_rows))
                there = np.asarray(pc.equal(pc.list_value_length(col("tag_vector")), dims[1]).fill_null(False)) & some
                whole = np.ascontiguousarray(np.hstack([v[0], t[0], there[:, None]]))
                first, same = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)[1:]
                same = same.ravel()
                in_turn = np.argsort(same, kind="stable")  # equal vectors together, each in the order of places
                units = np.hstack([_over(v[0][first], v[1][first][:, None]), *([_over(t[0][first], t[1][first][:, None])] if some else [])]).astype(np.float32)
                has = np.zeros((len(a.tags), table.num_rows), bool)
                if a.tags:
                    each = pc.index_in(lists.flatten(), pa.array(a.tags, pa.string())).fill_null(-1).to_numpy()
                    owner = pc.list_parent_indices(lists).to_numpy()
                    has[each[each >= 0], owner[each >= 0]] = True
                found = []
                for c in np.unique(where[where >= 0]).tolist():
                    for p, tags, own in alike:
                        queries = own[a.scopes[own, c]]
                        if not len(queries):
                            continue
                        if p not in under:
                            under[p] = pc.or_(pc.equal(paths, a.paths[p]), pc.starts_with(paths, a.paths[p] + "/")).to_numpy(zero_copy_only=False)
                        ok = (where == c) & under[p]
                        if len(tags):
                            ok &= has[tags].all(axis=0)
                        rows = in_turn[ok[in_turn]]
                        if not len(rows):
                            continue
                        start = np.flatnonzero(np.append(True, np.diff(same[rows]) != 0))
                        count = np.minimum(np.diff(np.append(start, len(rows))), k)
                        vector = same[rows[start]]
                        for matrix, those in ((mixed, there[first[vector]]), (plain, ~there[first[vector]])):
                            at = np.flatnonzero(those)
                            if not len(at):
                                continue
                            x = units[vector[at]].T
                            step = max(1, (1 << 20) // len(at))
                            for n in range(0, len(queries), step):
                                q = queries[n : n + step]
                                near = matrix[q] @ x
                                least = floor[q, c] - slack
                                if len(at) > k and np.isneginf(least).any():
                                    least = np.maximum(least, np.partition(near, len(at) - k, axis=1)[:, len(at) - k] - 2 * slack)
                                i, j = np.divmod(np.flatnonzero(near >= least[:, None].astype(np.float32)), len(at))
                                said, told, score = exact(q[i], first[vector[at[j]]], v, t, there)
                                high = level(score)
                                fine = np.flatnonzero(high >= floor[q[i], c])
                                i, j = i[fine], at[j[fine]]
                                times = count[j]
                                again = np.repeat(np.arange(len(fine)), times)
                                nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                                found.append((q[i][again], np.full(len(again), c), rows[start[j][again] + nth], *(z[fine][again] for z in (said, told, score, high))))
                if found:
                    best.add(table.select(shown), [np.concatenate(z) for z in zip(*found, strict=True)], floor)
        yield from best.told(floor, a.collections, carry)

    more = "".join(f", `{c}` {chunks.schema[c].dataType.simpleString()}" for c in carry)
    return chunks.select(*dict.fromkeys(names)).mapInArrow(of, HIT + more)


def _lengthed(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows, zeros for one that is not ``dim`` numbers, and the rows' lengths."""
    rows = _numbers(lists, dim)
    return rows, np.sqrt(_dots(rows, rows))


class _Best:
    """The best rows of a task by query and collection: pairs as numbers, and the chunks they name once each."""

    def __init__(self, k: int, place: list[tuple[str, str]]):
        self.k, self.place, self.chunks, self.held, self.new, self.size = k, place, None, None, [], 0

    def add(self, chunks: pa.Table, found: list[np.ndarray], floor: np.ndarray) -> None:
        """``found``: query, collection, row of ``chunks``, content score, tag score, score and level."""
        named, found[2] = np.unique(found[2], return_inverse=True)
        if not len(named):
            return
        found[2] = found[2].ravel() + (self.chunks.num_rows if self.chunks else 0)
        own = chunks.take(pa.array(named))
        self.chunks = pa.concat_tables([self.chunks, own]) if self.chunks else own
        self.new.append(found)
        self.size += len(found[0])
        if self.size > max(20_000, len(self.held[0]) if self.held else 0):
            self.cut(floor)

    def cut(self, floor: np.ndarray) -> None:
        held = [np.concatenate(z) for z in zip(*([self.held] if self.held else []), *self.new, strict=True)]
        rank = np.empty(self.chunks.num_rows, np.int64)
        rank[pc.sort_indices(self.chunks, self.place).to_numpy()] = np.arange(len(rank))
        order = np.lexsort((rank[held[2]], -held[6], held[1], held[0]))
        query, where = held[0][order], held[1][order]
        new = np.flatnonzero(np.append(True, (np.diff(query) != 0) | (np.diff(where) != 0)))
        nth = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
        last = order[nth == self.k - 1]
        floor[held[0][last], held[1][last]] = held[6][last]
        self.held = [z[order[nth < self.k]] for z in held]
        named, self.held[2] = np.unique(self.held[2], return_inverse=True)
        self.held[2] = self.held[2].ravel()
        self.chunks = self.chunks.take(pa.array(named)).combine_chunks()
        self.new, self.size = [], 0

    def told(self, floor: np.ndarray, collections: list[str], carry: Sequence[str], most: int = 10_000):
        if self.new:
            self.cut(floor)
        columns = [c.split()[0] for c in HIT.split(", ")] + list(carry)
        for lo in range(0, len(self.held[0]) if self.held else 0, most):
            query, _, row, said, told, score, high = (z[lo : lo + most] for z in self.held)
            rows = self.chunks.take(pa.array(row))
            for name, values in (("content_score", said), ("tag_score", told), ("score", score), ("level", high)):
                rows = rows.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
            yield from rows.append_column("query", pa.array(query, pa.int32())).select(columns).combine_chunks().to_batches()


def flagged(kept: DataFrame, o: Options, *by: str, score: str = "score") -> DataFrame:
    """``kept``, which a query's window bounds, with ``passed`` (the threshold) and ``single`` (passed, and the best of its file): one pass over it, in the order of the column ``score``."""
    place = W.partitionBy(*by).orderBy(*order(score))
    top_score = F.first("score").over(place)
    keep = F.lit(True)
    if o.alpha > 0:
        keep = keep & (F.col("score") >= o.alpha * top_score)
    if o.delta > 0:
        keep = keep & (top_score - F.col("score") <= o.delta)
    out = kept.withColumn("passed", (F.row_number().over(place) == 1) | keep)
    if not o.unique_files:
        return out.withColumn("single", F.col("passed"))
    return out.withColumn("single", F.col("passed") & (F.row_number().over(W.partitionBy(*by, "rel_path", "passed").orderBy(*order(score))) == 1))


def windowed(hits: DataFrame, o: Options) -> DataFrame:
    """Scored hits cut to the candidate window of each collection, with their flags."""
    return flagged(top(hits, o.window, "collection_id").drop("rank"), o)


def finished(hits: DataFrame, o: Options, query: Sequence[float] | None, query_text: str = "") -> tuple[DataFrame, str]:
    """The final result from flagged hits, and the strategy that made it; without one query vector there is no MMR."""
    from loam.operators import diversify, lexical

    single = hits.where("single").drop("passed", "single")
    if o.rerank == "bm25":
        return top(lexical.rerank(single, query_text), o.limit), "bm25" if lexical.wanted(single.sparkSession, query_text) else "truncate"
    if o.mmr and query is not None and o.mmr_lambda < 1:
        return diversify.mmr(single, query, o.limit, o.mmr_lambda), "mmr"
    return top(single, o.limit), "truncate"


def retrieve(chunks: DataFrame, query: Sequence[float], options: Options, query_tags: Sequence[float] | None = None, query_text: str = "") -> DataFrame:
    """The result of one query over the collections of ``chunks``."""
    o = options.normalized()
    return finished(windowed(scored(chunks, query, query_tags, o.tag_weight), o), o, query, query_text)[0]


def explain(hits: DataFrame, o: Options) -> DataFrame:
    """One row from flagged hits: the rows after each stage and the best score."""
    single = F.count_if("single")
    return hits.agg(
        F.count_distinct("collection_id").alias("scopes"), F.max("score").alias("top_score"), F.count("*").alias("retrieved"),
        F.count_if("passed").alias("after_threshold"), single.alias("after_unique"), F.least(single, F.lit(o.limit)).alias("final"),
    )
