"""The query job: a text against stored collections, and the file that shows what is stored of a path.

Scopes are the collections that the path means (the deepest one that holds it, else those below it) or, without a path, all of a file type. The
query is embedded once for each kind of collection among them (provider, model, dimension), its tags too; hits of all kinds are ranked together.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.jobs import embedder as em
from loam.jobs.index import Collection, Store, normalized_type
from loam.operators import search


class NotIndexed(LookupError):
    """No collection holds the path, or is below it."""


def under(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def scopes(collections: Sequence[Collection], path: str = "", file_type: str = "markdown", root_exists: Callable[[str], bool] = os.path.isdir) -> list[Collection]:
    """The collections of ``file_type`` that a query of ``path`` is asked of."""
    of_type = [c for c in collections if normalized_type(c.file_type) == normalized_type(file_type)]
    if not path.strip():
        found = [c for c in of_type if root_exists(c.root)]
    else:
        holding = [c for c in of_type if under(path, c.root)]
        found = [max(holding, key=lambda c: len(c.root))] if holding else [c for c in of_type if under(c.root, path) and c.root != path]
    if not found:
        raise NotIndexed(f"path is not indexed: {path}" if path.strip() else "no usable collections")
    return found


def combined(found: Sequence[Collection]) -> dict:
    """The settings that all share; ``multiple`` (0 for the dimension) where they differ."""
    one = lambda f, other: getattr(found[0], f) if len({getattr(c, f) for c in found}) == 1 else other
    return {
        "root_path": found[0].root if len(found) == 1 else "", "provider": one("provider", "multiple"), "model": one("model", "multiple"),
        "file_type": one("file_type", "multiple"), "vector_dim": one("vector_dim", 0),
    }


@dataclass
class Answer:
    text: str
    tags: list[str]
    query_tags: list[str]
    about: dict
    options: search.Options
    fused: bool
    scope_count: int
    hits: DataFrame  # with the flags of search.flagged
    results: DataFrame
    strategy: str

    def explain(self) -> DataFrame:
        """One row: settings, and rows after each stage."""
        o, counts = self.options, search.explain(self.hits, self.options)
        return counts.select(
            F.lit(o.window).alias("search_window"), F.lit(o.alpha).alias("threshold_alpha"), F.lit(o.delta).alias("threshold_delta"), F.lit(o.unique_files).alias("unique"),
            F.lit(o.rerank).alias("rerank"), F.lit(o.mmr_lambda).alias("mmr_lambda"), F.lit(o.tag_weight).alias("tag_weight"), F.lit(self.fused).alias("use_tag_fusion"),
            F.lit(self.scope_count).alias("scope_count"), F.col("retrieved").alias("retrieved_count"), F.col("after_threshold").alias("after_threshold_count"),
            F.col("after_unique").alias("after_unique_count"), F.col("final").alias("final_count"), F.coalesce("top_score", F.lit(0.0)).alias("threshold_top_score"),
            F.lit(self.strategy).alias("final_strategy"),
        )

    def json(self, explain: bool = False) -> DataFrame:
        """One row, ``json``: the versioned envelope with its results in order, which the limit bounds."""
        columns = self.results.columns
        row = [F.col("rank"), F.col("score"), F.col("rel_path"), F.coalesce("title_path", F.array().cast("array<string>")).alias("title_path"), F.col("tags"), F.col("chunk_id"), tx.preview(F.col("content")).alias("preview")]
        if explain:
            seeded = search.seeded(self.results)
            told = ["content_score", *(["tag_score"] if "tag_score" in columns else []), "pre_rerank_score"]
            more = {"bm25": ["bm25_score", "bm25_norm", "semantic_norm"], "mmr": ["mmr_relevance"]}.get(self.strategy, [])
            row.append(F.struct(*told, F.col("score").alias("final_score"), *[c for c in more if c in columns]).alias("explain"))
        rows = (seeded if explain else self.results).agg(F.sort_array(F.collect_list(F.struct(*row))).alias("results"))
        if explain:
            told = self.explain().first().asDict()  # one row of settings and counts
            rows = rows.withColumn("explain", F.struct(*[F.lit(v).alias(k) for k, v in told.items()]))
        a, words = self.about, lambda x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
        envelope = [F.lit("v1").alias("version"), F.lit(self.text).alias("query"), *[F.lit(a[k]).alias(k) for k in ("root_path", "provider", "model", "file_type", "vector_dim")], words(self.tags).alias("tags")]
        envelope += [words(self.query_tags).alias("query_tags")] if self.query_tags else []
        return rows.select(F.to_json(F.struct(*envelope, *(["explain"] if explain else []), "results")).alias("json"))


def ask(
    store: Store, text: str, path: str = "", tags: Sequence[str] = (), options: search.Options = search.Options(), file_type: str = "markdown", tag_extractor: str | None = None,
    extractor_options: dict | None = None, no_tag: bool = False, root_exists: Callable[[str], bool] = os.path.isdir, **embedder_options,
) -> Answer:
    """Results of one query text over the collections of its scopes. Where the extraction of its tags fails, its content alone counts."""
    if not text.strip():
        raise ValueError("a query needs a text")
    o = options.normalized()
    found = [c.valid() for c in scopes(store.collections(), path, file_type, root_exists)]
    one = store.spark.createDataFrame([(text,)], "text string")
    asked_tags = list(_tagged_queries(one, o, file_type, tag_extractor, extractor_options, no_tag).first()["query_tags"])
    kinds: dict[tuple, list[Collection]] = {}
    for c in found:
        kinds.setdefault((c.provider, c.model, c.vector_dim), []).append(c)
    every, vectors = None, []
    for (_, model, dim), own in kinds.items():
        embed = em.make(model, **embedder_options)
        vector = embed([text])[0].tolist()
        if len(vector) != dim:
            raise ValueError(f"the query has {len(vector)} dimensions, the collections of {model} have {dim}")
        tag_vector = em.pooled(embed(asked_tags)) if asked_tags else None
        hits = search.scored(store.chunks(tags=tags, prefix=path.strip(), only=[c.collection_id for c in own]), vector, tag_vector, o.tag_weight)
        every = hits if every is None else every.unionByName(hits)
        vectors.append(vector)
    marked = search.windowed(every, o)
    results, strategy = search.finished(marked, o, vectors[0] if len(vectors) == 1 else None, text)
    return Answer(text, list(tags), asked_tags, combined(found), o, bool(asked_tags), len(found), marked, results, strategy)


def _tagged_queries(queries: DataFrame, o: search.Options, file_type: str, extractor: str | None, extractor_options: dict | None, no_tag: bool) -> DataFrame:
    """``queries(text, ...)`` with ``query_tags``: those that count, or none."""
    none = F.array().cast("array<string>")
    if not extractor or no_tag:
        return queries.withColumn("query_tags", none)
    tagged = em.with_query_tags(queries, extractor, extractor_options=extractor_options)
    gate = search.fusion_gate(F.col("text"), F.size("query_tags"), F.lit(o.tag_weight), F.lit(False), F.lit(normalized_type(file_type)))
    return tagged.withColumn("query_tags", F.when(gate, F.col("query_tags")).otherwise(none))


def ask_many(
    store: Store, queries: DataFrame, options: search.Options = search.Options(), file_type: str = "markdown", tag_extractor: str | None = None, extractor_options: dict | None = None,
    no_tag: bool = False, root_exists: Callable[[str], bool] = os.path.isdir, most_queries: int | None = None, **embedder_options,
) -> DataFrame:
    """(query_id, rank, collection_id, rel_path, chunk_index, chunk_id, score, content_score, tag_score): what ``ask`` says to each of ``queries(query_id, text, path, tags)``.

    The columns path and tags may be missing. All queries are embedded in tasks; blocks of ``most_queries`` of them (unless given, as many as have two million rows in all their windows, but 2000 to 20,000) go
    against all chunks at once, as ``search.masked_topk`` does, and the stages after that are grouped by query. Hits rank by ``search.level``, their scores to nine decimals, then by path, number and id. A null or blank text, and a path that is not indexed, have no results; ids must be unique.
    With MMR or re-ranking the results have their columns too.
    """
    from loam.operators import diversify, lexical
    from loam.operators.scopes import descendants, longest_prefix

    spark, o = store.spark, options.normalized()
    known = [c.valid() for c in store.collections() if normalized_type(c.file_type) == normalized_type(file_type)]
    given = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), other) if c in queries.columns else other
    asked = queries.select("query_id", "text", tx.strip(given("path", "string", F.lit(""))).alias("path"), tx.normalize_tags(given("tags", "array<string>", F.array().cast("array<string>"))).alias("tags"))
    asked = _tagged_queries(asked.where(tx.strip(F.coalesce("text", F.lit(""))) != ""), o, file_type, tag_extractor, extractor_options, no_tag)
    roots = F.broadcast(spark.createDataFrame([(c.root, c.collection_id) for c in known], "root string, collection_id string"))  # the registry: a row a collection
    kinds: dict[tuple, list[Collection]] = {}
    for c in known:
        kinds.setdefault((c.provider, c.model, c.vector_dim), []).append(c)
    everywhere = {c.collection_id for c in known if root_exists(c.root)}
    carry = [*(["vector"] if o.mmr and o.mmr_lambda < 1 else []), *(["content", "title_path", "tags"] if o.rerank == "bm25" else [])]
    folder = f"{store.root}/staging/queries-{uuid.uuid4().hex}"
    asked.write.parquet(f"{folder}/asked")  # tags are extracted once
    asked = spark.read.parquet(f"{folder}/asked")
    rounds = max(1, -(-asked.count() // (most_queries or min(max(2_000_000 // (o.window * max(1, len(known))), 2000), 20_000))))
    paths = asked.select("path").distinct().where("path <> ''")
    found = longest_prefix(paths, roots).select("path", "root").union(descendants(paths, roots)).join(roots, "root").select("path", "collection_id")
    found.write.parquet(f"{folder}/scopes")
    found = spark.read.parquet(f"{folder}/scopes")
    for n, (_, model, _) in enumerate(kinds):  # embedded once, in the rounds in which they are asked
        made = em.with_vectors(asked, model, "text", **embedder_options).join(em.tag_vectors(asked.select("query_id", F.col("query_tags").alias("tags")), ["query_id"], model, **embedder_options), "query_id", "left")
        block = made.select("query_id", "path", "tags", F.col("vector").cast("array<double>").alias("vector"), F.col("tag_vector").cast("array<double>").alias("tag_vector"), F.pmod(F.xxhash64("query_id"), F.lit(rounds)).alias("round"))
        block.repartition(min(rounds, spark.sparkContext.defaultParallelism), "round").write.partitionBy("round").parquet(f"{folder}/vectors-{n}")
    for r in range(rounds):
        for n, ((_, model, dim), own) in enumerate(kinds.items()):
            # by the folder's name: the whole is one listing for each round otherwise
            fs, p = store._at(f"{folder}/vectors-{n}/round={r}")
            block = spark.read.parquet(f"{folder}/vectors-{n}/round={r}").toArrow() if fs.exists(p) else pa.table({})
            if not block.num_rows:
                continue
            scopes_of: dict[str, set[str]] = {"": everywhere}
            named = F.broadcast(spark.createDataFrame(pa.table({"path": pc.unique(block.column("path"))})))  # the paths of a block, with a few collections each
            for path, c in found.join(named, "path", "left_semi").toArrow().to_pandas().itertuples(index=False, name=None):
                scopes_of.setdefault(path, set()).add(c)
            hits = _block_hits(store, block, dim, model, own, scopes_of, o, carry)
            names = spark.createDataFrame(pa.table({"query": pa.array(range(block.num_rows), pa.int32()), "query_id": block.column("query_id").combine_chunks()}))
            vectors = pa.table({"query": pa.array(range(block.num_rows), pa.int32()), "query_vector": block.column("vector").combine_chunks()})
            hits = hits.join(F.broadcast(names), "query")  # a row a query of the block
            if "vector" in carry:
                hits = hits.join(F.broadcast(spark.createDataFrame(vectors)), "query")
            hits.drop("query").write.mode("append").parquet(f"{folder}/hits")
    more = "".join(f", {c} {t}" for c, t in (("vector", "array<float>"), ("content", "string"), ("title_path", "array<string>"), ("tags", "array<string>")) if c in carry)
    schema = search.HIT.replace("query int", f"query_id {queries.schema['query_id'].dataType.simpleString()}") + more + (", query_vector array<double>" if "vector" in carry else "")
    fs, p = store._at(f"{folder}/hits")
    hits = spark.read.schema(schema).parquet(f"{folder}/hits") if fs.exists(p) else spark.createDataFrame([], schema)
    # dealt once, by the query: all windows below are within one
    marked = search.flagged(search.top(hits.repartition("query_id"), o.window, "query_id", "collection_id", score="level").drop("rank"), o, "query_id", score="level")
    single = marked.where("single").drop("passed", "single")
    shown = ["query_id", "rank", "collection_id", "rel_path", "chunk_index", "chunk_id", "score", "content_score", "tag_score"]
    if o.rerank == "bm25":
        texts = asked.select("query_id", F.col("text").alias("query_text"))
        scored = lexical.rerank(single.join(texts, "query_id"), F.col("query_text"), "query_id")
        return search.top(scored, o.limit, "query_id").select(*shown, "bm25_score", "bm25_norm", "semantic_norm", "pre_rerank_score")
    if "vector" in carry and len(kinds) == 1:
        return diversify.mmr_batch(single, "query_id", o.limit, o.mmr_lambda).select(*shown, "mmr_relevance")
    return search.top(single, o.limit, "query_id", score="level").select(*shown)


def _block_hits(store: Store, block: pa.Table, dim: int, model: str, own: list[Collection], scopes_of: dict[str, set[str]], o: search.Options, carry: Sequence[str]) -> DataFrame:
    """The window of each query of a block in the collections of one kind."""
    lengths = set(pc.list_value_length(block.column("vector")).to_pylist()) - {dim}
    if lengths:
        raise ValueError(f"the queries have {sorted(lengths)[0]} dimensions, the collections of {model} have {dim}")
    one = lambda c: block.column(c).combine_chunks()
    paths = sorted(set(block.column("path").to_pylist()) - {""})
    tags = sorted({t for x in block.column("tags").to_pylist() for t in x})
    at = {p: i for i, p in enumerate(paths)} | {"": len(paths)}
    place = {t: i for i, t in enumerate(tags)}
    wanted = np.zeros((block.num_rows, len(tags)), bool)
    for i, x in enumerate(block.column("tags").to_pylist()):
        wanted[i, [place[t] for t in x]] = True
    ids = [c.collection_id for c in own]
    scope = np.array([[c in scopes_of.get(p, ()) for c in ids] for p in block.column("path").to_pylist()], bool)
    fused = block.column("tag_vector").is_valid().to_numpy() & (o.tag_weight > 0)
    asked = search.Asked(
        search._numbers(one("vector"), dim), search._numbers(one("tag_vector"), dim), fused, scope, ids, paths, np.array([at[p] for p in block.column("path").to_pylist()]), tags, wanted
    )
    return search.masked_topk(store.chunks(only=[c for c, used in zip(ids, scope.any(axis=0), strict=True) if used]), asked, o.window, o.tag_weight, carry)


def shown_files(store: Store, paths: DataFrame) -> DataFrame:
    """(path, found, collection_id, root_dir, rel_path, file_hash, chunk_count, chunks) of each of ``paths(path)``.

    A path belongs to the deepest collection that holds it and has chunks of it, under its path below the root or else its whole path;
    ``chunks`` are in order of their numbers. A path that none has is not found.
    """
    from loam.operators.scopes import leading_parts

    roots = store.spark.createDataFrame([(c.collection_id, c.root) for c in store.collections()], "collection_id string, root string")
    asked = paths.select("path").distinct()
    held = asked.select("path", F.explode(leading_parts(F.col("path"))).alias("root")).join(F.broadcast(roots), "root")  # the registry: a row a collection
    below = F.expr("substring(path, length(root) + 2)")
    names = held.select("path", "root", "collection_id", F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), name.alias("rel_path")) for k, name in enumerate((below, F.col("path")))])).alias("n")).select("path", "root", "collection_id", "n.*")
    rows = names.join(store.chunks(), ["collection_id", "rel_path"]).groupBy("path", "root", "collection_id", "nth", "rel_path").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "tags", "semantic_tags", F.size("vector").alias("vector_len"), "title", "content"))).alias("chunks")
    )
    best = rows.groupBy("path").agg(F.min_by(F.struct("root", "collection_id", "rel_path", "chunks"), F.struct(-F.length("root"), "nth")).alias("b")).select("path", "b.*")
    known = best.join(store.states().select("collection_id", "rel_path", "file_hash", "chunk_count"), ["collection_id", "rel_path"], "left")
    return asked.join(known, "path", "left").select(
        "path", F.col("chunks").isNotNull().alias("found"), "collection_id", F.col("root").alias("root_dir"), "rel_path", "file_hash", F.coalesce("chunk_count", F.size("chunks")).alias("chunk_count"), "chunks"
    )


def show_json(shown: DataFrame) -> DataFrame:
    """(path, json) of ``shown_files``; what is not found says so and nothing else."""
    file = F.struct("rel_path", "file_hash", "chunk_count").alias("file")
    whole = F.to_json(F.struct("found", file, F.struct("collection_id", "root_dir").alias("collection"), "chunks"))
    return shown.select("path", F.when(F.col("found"), whole).otherwise('{"found":false}').alias("json"))
