"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for an empty, zero or null vector and for vectors of different length."""
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_normalize(v: Column, dims: int = 0) -> Column:
    """``v`` (its first ``dims`` components, if given) divided by its norm; a zero vector stays as it is."""
    kept = F.slice(v, 1, dims) if dims else v
    length = norm(kept)
    return F.transform(kept, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def fused(content: Column, tag: Column | None, weight: float, enabled: Column | bool = True) -> Column:
    """(1 - w) * content + w * tag where a tag score is there and fusion is on, else the content score."""
    if tag is None:
        return content
    return F.when(F.lit(enabled) & tag.isNotNull(), (1 - weight) * content + weight * tag).otherwise(content)
