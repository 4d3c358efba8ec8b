"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables, reranked with the vectors.

Codes. A bounded sample is centred and turned onto its principal axes; alternating between codes and the rotation that fits them
best (orthogonal Procrustes) balances it over the bits. Several rotations from different starts give as many bits as the tables
need. Tables. The bits are cut into substrings that put about ``bucket`` vectors under one value; two vectors are candidates if they agree
on any substring. How many tables that takes is measured, not assumed: pairs at exactly ``threshold``, in all directions and in those that
the data have, and the near pairs of the sample itself must meet in some table as often as ``recall`` asks; where no number of tables up
to ``most_tables`` reaches it, substrings get shorter, down to none, which is one bucket and exact. Vectors of lengths that the
sample holds too rarely to learn from get random directions and the number of tables that angle alone asks for.

Rerank. Within a bucket all pairs are compared by cosine in double precision; a pair counts at the first table
where it meets, so no pair is counted twice and none is ever a row. A bucket of many vectors is cut into blocks, one task for
each two blocks: its vectors return counts and the smallest vector reached. Equal vectors fold into one before all this.

The sample (``sample_rows``, first by a hash of the vector) only sets codes and tables; every vector is indexed, none of a bucket is left out.

Defined cases: every row is a vector of its own, also where ids repeat or are null. Null vectors, empty ones, zero ones, and those with
null or non-finite components link with nothing; vectors of different lengths have no cosine and do not link. A component's id is its
smallest id that is not null, null if it has none. Other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, stored

#: No more principal axes than this are turned; no more sampled rows than this fit a rotation.
MOST_AXES, MOST_FIT = 256, 8192
#: A length is learned from with so many sampled rows at least.
LEAST_ROWS = 256
#: The lengths that most vectors have; no more than so many are learned.
MOST_LENGTHS = 64


def rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal matrix whose signs of ``x @ r`` lose least: iterative quantisation from a random start."""
    r = np.linalg.qr(np.random.RandomState(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return r


def learn(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions as columns, cut of each): a bit is whether a vector's product with a direction exceeds its cut, that of the mean."""
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, -MOST_AXES:]
    turned = (sample[:MOST_FIT] - mean) @ axes
    parts = [axes @ rotation(turned, seed) for seed in range(-(-bits // axes.shape[1]))]
    directions = np.concatenate(parts, axis=1)[:, :bits]
    return directions, mean @ directions


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps very large and very small vectors in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(sample: np.ndarray, threshold: float, most: int = 4000, seed: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs that must meet: at ``threshold`` in any direction, at it towards other vectors, and the near ones of the sample."""
    rng = np.random.RandomState(seed)
    x = sample[rng.permutation(len(sample))[:most]]
    kinds = []
    for other in (rng.standard_normal(x.shape), sample[rng.permutation(len(sample))[: len(x)]]):
        away = other - (other * x).sum(axis=1, keepdims=True) * x
        far = np.linalg.norm(away, axis=1)
        some = far > 1e-6
        kinds.append((x[some], threshold * x[some] + math.sqrt(1 - threshold**2) * away[some] / far[some, None]))
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    pick = rng.permutation(len(i))[:20_000]
    kinds.append((x[i[pick]], x[j[pick]]))
    return [k for k in kinds if len(k[0])]


def shortest(n: int, bucket: int) -> int:
    """Bits of a substring that put about ``bucket`` of ``n`` vectors under one value."""
    return min(24, max(4, round(math.log2(max(n, 1) / bucket))))


def fit(sample: np.ndarray, n: int, threshold: float, recall: float, bucket: int, most_tables: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(directions, cuts, tables, bits of each) for ``n`` vectors like those of ``sample``."""
    kinds = near_pairs(sample, threshold)
    width = shortest(n, bucket)
    while width:
        tables = 8
        while tables <= most_tables:
            directions, cuts = learn(sample, tables * width)
            reached = np.ones(tables)
            for x, y in kinds:
                same = ((x @ directions > cuts) == (y @ directions > cuts)).reshape(len(x), tables, width).all(axis=2)
                reached = np.minimum(reached, np.logical_or.accumulate(same, axis=1).mean(axis=0))
            enough = np.flatnonzero(reached >= recall)
            if len(enough):
                t = int(enough[0]) + 1
                return directions[:, : t * width], cuts[: t * width], t, width
            tables *= 2
        width -= 1
    return np.zeros((sample.shape[1], 0)), np.zeros(0), 1, 0


def by_angle(dim: int, n: int, threshold: float, recall: float, bucket: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The same from random directions, for lengths without a sample: a bit agrees as often as the angle says."""
    width = 0 if n <= bucket else shortest(n, bucket)
    agree = (1 - math.acos(threshold) / math.pi) ** width
    tables = 1 if agree == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))
    return np.random.RandomState(dim % (1 << 31)).standard_normal((dim, tables * width)), np.zeros(tables * width), tables, width


def usable(v: Column) -> Column:
    """Can this vector link?"""
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def rows_of(lists: pa.Array, at: np.ndarray) -> np.ndarray:
    """The lists at ``at``, all of one length, as a matrix."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    n = int(offsets[at[0] + 1] - offsets[at[0]]) if len(at) else 0
    return values[offsets[at][:, None] + np.arange(n)]


def compare(ids, copies, x, keys, table, side, threshold):
    """Links of each vector (copies counted) and the smallest vector it reaches, over pairs that first meet in ``table``."""
    close = np.triu(x @ x.T >= threshold, 1)
    if side is not None:
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    if len(i) and table:
        fresh = np.ones(len(i), dtype=bool)
        for t in range(table):
            fresh &= keys[i, t] != keys[j, t]
        met_i, met_j = i[fresh], j[fresh]
    else:
        met_i, met_j = i, j
    links = np.bincount(met_i, weights=copies[met_j], minlength=len(ids)) + np.bincount(met_j, weights=copies[met_i], minlength=len(ids))
    root = ids.copy()
    while len(met_i):
        low = root.copy()
        np.minimum.at(low, met_i, root[met_j])
        np.minimum.at(low, met_j, low[met_i])
        if (low == root).all():
            break
        root = low
    return links.astype(np.int64), root


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, sample_rows: int = 20_000, bucket: int = 256, most_tables: int = 128,
    block: int = 512, cell_rows: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors(vec_id, embedding)``.

    ``bucket`` vectors share a value of a table on average; ``block`` and ``cell_rows`` bound what a task compares at once and change no result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id"), F.col("embedding").alias("v"))
    good = given.where(usable(F.col("v"))).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    # numbered where they are written, so the numbers stay
    classes = stored(
        good.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("v").alias("v")).withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_LENGTHS).collect()
    n = classes.count()
    room = max(LEAST_ROWS, (1 << 26) // (8 * max([d for d, _ in lengths], default=1)))  # 64 MB on the driver at most
    drawn = classes.orderBy("h1", "h2").limit(min(sample_rows, room)).select("v").toArrow().column(0).combine_chunks()
    drawn = pa.concat_arrays(drawn.chunks) if isinstance(drawn, pa.ChunkedArray) else drawn
    size = np.diff(drawn.offsets.to_numpy()) if len(drawn) else np.zeros(0, int)
    models = {}
    for d, m in lengths:
        own = np.flatnonzero(size == d)
        if len(own) >= LEAST_ROWS:
            models[d] = fit(unit(rows_of(drawn, own).astype(np.float64)), m, threshold, recall, bucket, most_tables)
    counts = dict((d, m) for d, m in lengths)
    rest = min(counts.values(), default=0)  # no other length has more
    shared = spark.sparkContext.broadcast((models, counts))  # MOST_LENGTHS lengths of a few hundred directions at most

    def encode(batches):
        known, counts = shared.value
        made = dict(known)
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            dims = np.diff(v.offsets.to_numpy())
            keys: list = [None] * len(batch)
            for d in np.unique(dims).tolist():
                if d not in made:
                    made[d] = by_angle(d, counts.get(d, rest), threshold, recall, bucket)
                directions, cuts, tables, width = made[d]
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, max(1, len(at) * d >> 21)):
                    bits = unit(rows_of(v, part).astype(np.float64)) @ directions > cuts
                    for i, k in zip(part, bits.reshape(len(part), tables, width) @ (1 << np.arange(width)), strict=True):
                        keys[i] = k
                if d not in known:
                    del made[d]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys).astype(np.int32) if keys else np.zeros(0, np.int32)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("node", "copies", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dims.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "copies", "v", "dim", "keys"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    coded = checkpointed(classes.select("node", "copies", "v").mapInArrow(encode, f"node long, copies long, v {kind}, dim int, keys array<int>"))
    slots = coded.select("dim", F.posexplode("keys").alias("t", "key"))
    # a written table: its size is known, so the planner broadcasts it or shuffles as that size allows
    sizes = slots.groupBy("dim", "t", "key").agg(F.count("*").alias("m"))
    crowds = stored(sizes.where(f"m > {block}"), "crowded-buckets")
    total = coded.agg(F.sum(F.size("keys"))).first()[0] or 0
    cells = max(1, math.ceil(total / cell_rows))
    met = coded.select("*", F.posexplode("keys").alias("t", "key")).join(crowds, ["dim", "t", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("m") / block), F.lit(1))
    placed = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select(
        "node", "copies", "v", "keys", "dim", "t", "key", "block", (F.col("block") != F.col("other")).alias("cross"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("dim", "t", "key"), F.lit(cells)).cast("string"))
        .otherwise(F.concat_ws(":", "dim", "t", "key", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
    )

    def rerank(cell: pa.Table) -> pa.Table:
        whole = lambda c: (lambda x: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x)(cell.column(c).combine_chunks())
        node, copies, dim, t, key, blk, cross = (whole(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "dim", "t", "key", "block", "cross"))
        v, keys = whole("v"), whole("keys")
        order = np.lexsort((key, t, dim))
        cut = np.flatnonzero((np.diff(dim[order]) != 0) | (np.diff(t[order]) != 0) | (np.diff(key[order]) != 0)) + 1
        found = []
        for own in np.split(order, cut):
            if len(own) < 2:
                continue
            side = blk[own] == blk[own].max() if cross[own[0]] else None
            links, root = compare(node[own], copies[own], unit(rows_of(v, own).astype(np.float64)), rows_of(keys, own), int(t[own[0]]), side, threshold)
            got = links > 0
            if got.any():
                found.append((node[own][got], links[got], root[got]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in cols], names=["node", "links", "root"])

    found = checkpointed(placed.groupBy("cell").applyInArrow(rerank, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("node", "h1", "h2", "first", "copies").join(links, "node", "left").join(linked, "node", "left").select(
        "h1", "h2", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    smallest = by_class.groupBy("root").agg(F.min("first").alias("component_id"))
    able = good.select("vec_id", "h1", "h2").join(by_class.join(smallest, "root"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    unable = given.where(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.union(unable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
