"""Embedders and tag extractors by name. The offline ones are deterministic; others may be registered by whoever has a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as tx

Embed = Callable[[list[str]], np.ndarray]
Extract = Callable[[list[str]], list[list[str]]]


class Registry:
    """Factories by name: a name is trimmed, not blank, and taken once; an unknown one is an error that lists the known."""

    def __init__(self, what: str):
        self.what, self._known = what, {}

    def register(self, name: str, make: Callable) -> None:
        name = name.strip()
        if not name or name in self._known:
            raise ValueError(f"{self.what} {name!r} is blank or known already")
        self._known[name] = make

    def names(self) -> list[str]:
        return sorted(self._known)

    def make(self, name: str, **options):
        if name.strip() not in self._known:
            raise KeyError(f"unknown {self.what} {name!r}; known: {self.names()}")
        return self._known[name.strip()](**options)


#: Embedders turn texts into vectors; extractors turn texts into tags.
embedders, extractors = Registry("embedder"), Registry("tag extractor")
register, names, make = embedders.register, embedders.names, embedders.make


def keyword(words: tuple[str, ...] = ("go", "vector", "yaml")) -> Embed:
    """Counts of words within the lower-cased text."""
    return lambda texts: np.array([[t.lower().count(w) for w in words] for t in texts], dtype=np.float32).reshape(len(texts), len(words))


def hashing(dims: int = 64) -> Embed:
    """Signed word counts folded into ``dims`` components and set to length 1."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def vocabulary(words: tuple[str, ...] = ("go", "vector", "yaml")) -> Extract:
    """Of ``words`` those that the lower-cased text holds, in their order."""
    return lambda texts: [[w for w in words if w in t.lower()] for t in texts]


def frequent(most: int = 8, shortest: int = 4) -> Extract:
    """The words that a text has most often, the earlier first where they tie."""
    import re
    from collections import Counter

    return lambda texts: [[w for w, _ in Counter(x for x in re.findall(r"\w+", t.lower()) if len(x) >= shortest).most_common(most)] for t in texts]


extractors.register("vocabulary", vocabulary)
extractors.register("frequent", frequent)
register("keyword", keyword)
register("hashing", hashing)


def with_vectors(chunks: DataFrame, name: str = "keyword", column: str = "content", batch: int = 128, **options) -> DataFrame:
    """``chunks`` with a vector of ``column``; the embedder is made once per task and called with batches across files."""

    @F.pandas_udf("array<float>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make(name, **options)
        for s in texts:
            got = [embed(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([r for g in got for r in g], dtype=object)

    return chunks.withColumn("vector", vector(F.col(column)))


def with_tag_vectors(chunks: DataFrame, keys: Sequence[str], name: str, extractor: str, most: int = 8, extractor_options: dict | None = None, prompt_chars: int | None = None, **options) -> DataFrame:
    """``chunks`` with ``semantic_tags`` and ``tag_vector`` of their file, the pooled vectors of its tags; null for a file without tags.

    A file's own ``tags`` are taken as they are; others are what ``extractor`` finds in its contents, or in their first ``prompt_chars`` characters
    where what answers it takes no more. Each distinct tag is embedded once.
    """

    @F.pandas_udf("array<string>")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = extractors.make(extractor, **(extractor_options or {}))
        for s in texts:
            yield pd.Series(found(s.fillna("").tolist()), dtype=object)

    own = chunks.where("error is null").groupBy(*keys).agg(
        F.first("tags").alias("tags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("content")
    )
    lacking = F.coalesce(F.size("tags"), F.lit(0)) == 0
    given = own.where(~lacking).select(*keys, F.col("tags").alias("semantic_tags"))
    found = own.where(lacking).select(*keys, tx.normalize_semantic_tags(extract(tx.truncated(F.col("content"), prompt_chars) if prompt_chars else F.col("content")), most).alias("semantic_tags"))
    tagged = given.union(found).where(F.size("semantic_tags") > 0)
    vectors = tag_vectors(tagged.select(*keys, F.col("semantic_tags").alias("tags")), keys, name, **options)
    return chunks.join(tagged.join(vectors, list(keys)), list(keys), "left")


def tag_vectors(tagged: DataFrame, keys: Sequence[str], name: str, **options) -> DataFrame:
    """(*keys, tag_vector): the pooled vectors of ``tagged(*keys, tags)``; each distinct tag is embedded once, rows without tags have none."""
    each = tagged.select(*keys, F.explode("tags").alias("tag"))
    vectors = with_vectors(each.select("tag").distinct(), name, "tag", **options)
    pooled = mean_pooled(each.join(vectors, "tag").select(F.struct(*keys).alias("file"), "vector"), "file")
    return pooled.select("file.*", F.col("vector").cast("array<float>").alias("tag_vector"))


def with_query_tags(queries: DataFrame, extractor: str, most: int = 8, extractor_options: dict | None = None) -> DataFrame:
    """``queries(text, ...)`` with ``query_tags``, normalised as those of files are. A text whose extraction fails has none: it is answered by its content."""

    @F.pandas_udf("array<string>")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = extractors.make(extractor, **(extractor_options or {}))

        def tags(text: str) -> list[str]:
            try:
                return found([text])[0]
            except Exception:
                return []

        for s in texts:
            yield pd.Series([tags(t or "") for t in s], dtype=object)

    return queries.withColumn("query_tags", F.coalesce(tx.normalize_semantic_tags(extract("text"), most), F.array().cast("array<string>")))


def pooled(vectors: np.ndarray) -> list[float]:
    """The mean of the rows, set to length 1; zero stays zero."""
    mean = np.asarray(vectors, dtype=np.float64).mean(axis=0)
    length = float(np.linalg.norm(mean))
    return (mean / length if length > 0 else mean).tolist()


def mean_pooled(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """(by, vector): the mean of each group's vectors, set to length 1; sums are combined before they are shuffled."""
    parts = rows.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    from loam.functions.vectors import l2_normalize

    return lists.select(by, l2_normalize(F.transform("v", lambda s: s["x"])).alias(vector))
