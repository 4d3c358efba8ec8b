"""Maximal marginal relevance: greedy, one pick after the other, over the candidates of a query."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loam.functions import vectors as vx
from loam.operators.search import order


def select(relevance: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Indexes picked: the most relevant first, then by lam * relevance - (1 - lam) * the nearest of those picked, floored at 0.

    Lazy: what a candidate is worth only falls as more are picked, so an old value bounds it from above, and only the candidate with the greatest
    bound is compared with the picks it has not met. Ties go to the lower index.
    """
    length = np.array([np.linalg.norm(v) for v in vectors]).reshape(-1, 1)  # as dot products sum: along an axis the last bit depends on the machine, and ties on it
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    near, met, picked = np.zeros(len(relevance)), np.zeros(len(relevance), int), []
    heap = [(-float(r), i) for i, r in enumerate(relevance)]
    heapq.heapify(heap)
    first = True
    while heap and len(picked) < k:
        value, i = heapq.heappop(heap)
        if met[i] < len(picked):
            near[i] = max(near[i], max(float(unit[j] @ unit[i]) for j in picked[met[i] :]))
            met[i] = len(picked)
            heapq.heappush(heap, (-(lam * relevance[i] - (1 - lam) * near[i]), i))
            continue
        picked.append(i)
        if first:  # from the second pick on, values have another scale; lam * relevance bounds them
            heap = [(-lam * float(relevance[j]), j) for _, j in heap]
            heapq.heapify(heap)
            first = False
    return picked


def mmr(candidates: DataFrame, query: Sequence[float], k: int, lam: float, most: int = 100_000) -> DataFrame:
    """``candidates`` of one query, picked and ranked anew; scores stay.

    Up to ``most`` candidates, which a query's window usually bounds, are one group in one task. More are picked in ``k`` rounds, each an
    expression over all of them and a bounded heap per task. Both pick the same.
    """
    rows = candidates.drop("rank")
    if rows.limit(most + 1).count() > most:
        return _in_rounds(rows, query, k, lam)
    asked = rows.withColumns({"__q": F.lit(1), "query_vector": vx.literal(query)})
    return mmr_batch(asked, "__q", k, lam).drop("__q")


def mmr_batch(candidates: DataFrame, key: str, k: int, lam: float) -> DataFrame:
    """The same for the candidates of many queries, which have their query's vector as ``query_vector``: a group a query, bounded by its window."""
    rows = candidates.drop("rank")
    kept = [f for f in rows.schema.fields if f.name != "query_vector"]

    def pick(group: pa.Table) -> pa.Table:
        place = [("score", "descending"), ("rel_path", "ascending"), ("chunk_index", "ascending"), ("chunk_id", "ascending")]
        group = group.take(pc.sort_indices(group, place))
        x = matrix(group.column("vector"))
        q = matrix(group.column("query_vector").slice(0, 1))[0]
        length = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        relevance = np.divide(x @ q, length, out=np.zeros(len(x)), where=length > 0)
        chosen = select(relevance, x, k, lam)
        out = group.drop_columns(["query_vector"]).take(pa.array(chosen, pa.int64()))
        return out.append_column("mmr_relevance", pa.array(relevance[chosen])).append_column("rank", pa.array(np.arange(1, len(chosen) + 1), pa.int32()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    ordered = rows.select(*[f.name for f in kept], "query_vector")
    return ordered.groupBy(key).applyInArrow(pick, ", ".join([*fields, "mmr_relevance double", "rank int"]))


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    got = pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else pa.array([], pa.float64())
    return got.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _in_rounds(rows: DataFrame, query: Sequence[float], k: int, lam: float) -> DataFrame:
    """The same pick by pick; ``chunk_id`` names a candidate."""
    left = rows.withColumn("mmr_relevance", vx.cosine(F.col("vector"), vx.literal(query)))
    picked: list = []
    while len(picked) < k:
        near = [vx.cosine(F.col("vector"), vx.literal(p["vector"])) for p in picked]
        value = F.col("mmr_relevance") if not near else lam * F.col("mmr_relevance") - (1 - lam) * F.greatest(F.lit(0.0), *near)
        best = left.where(~F.col("chunk_id").isin([p["chunk_id"] for p in picked])).orderBy(value.desc(), *order()).first()
        if best is None:
            break
        picked.append(best)
    schema = StructType([*left.schema.fields, StructField("rank", IntegerType())])
    return rows.sparkSession.createDataFrame([(*p, n) for n, p in enumerate(picked, 1)], schema)
