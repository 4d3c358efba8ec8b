"""The registered queries of the retrieval operators, each with its SQL.

Derived rows: a document is a file ``<source>/<doc_id>`` of the collection ``<source>`` with the tags (lang, source); its chunk is the
document, its vector that of the same number in ``embeddings``. Query vectors are rows of that table and never candidates themselves.
Scores are rounded after ranking.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import hashing as hx
from loam.functions import text as tx
from loam.functions import vectors as vx
from loam.jobs import embedder, index
from loam.jobs import query as ask
from loam.operators import contracts, diversify, incremental, lexical, replies, scopes, search
from loam.sources import listing, markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY_ROW = 17
SPLITTER = markdown.Splitter()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"rel_path": F.concat_ws("/", "source", "doc_id"), "tags": tx.normalize_tags(F.array("lang", "source"))})


def chunks_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = files_of(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("collection_id"), "doc_id", "rel_path", "tags", F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("chunk_index"), *more
    )
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return docs.join(e, "doc_id")


def vector_of(spark: SparkSession, sf_dir: str, row: int = QUERY_ROW) -> list[float]:
    """The vector a query is asked with: one row."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == row).select(F.col("embedding").cast("array<double>")).first()[0])


def hits_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir, *more).where(F.col("doc_id") != QUERY_ROW)
    return search.scored(chunks, vector_of(spark, sf_dir))


def shown(df: DataFrame, *columns: str) -> DataFrame:
    rounded = {"score", "content_score", "tag_score", "bm25_score", "bm25_norm", "semantic_norm", "pre_rerank_score", "mmr_relevance", "top_score"}
    return df.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in columns])


HITS = f"""
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {QUERY_ROW}),
c AS (SELECT d.source AS collection_id, d.doc_id, d.source || '/' || d.doc_id AS rel_path, list_sort(list_distinct([lower(d.lang), lower(d.source)])) AS tags,
        d.doc_id::VARCHAR AS chunk_id, 0 AS chunk_index, d.text, e.embedding::DOUBLE[] AS vector, e.label
      FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
hits AS (SELECT c.*, list_cosine_similarity(vector, qv) AS score FROM c, q WHERE doc_id <> {QUERY_ROW})
"""
BY = "score DESC, rel_path, chunk_index, chunk_id"


# Scoring and ranking


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_ROW})), 6) AS score FROM embeddings")
def cosine_similarity(spark, sf_dir):
    q = vx.literal(vector_of(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.cosine(F.col("embedding"), q), 6).alias("score"))


@query(f"WITH {HITS} SELECT rank, rel_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY {BY})::INT AS rank FROM hits) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return shown(search.top(hits_of(spark, sf_dir), 10), "rank", "rel_path", "score")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM q, embeddings WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def vector_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return search.batch_topk(e, asked, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {HITS} SELECT collection_id, rank, rel_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY {BY})::INT AS rank FROM hits) WHERE rank <= 5")
def topk_per_collection(spark, sf_dir):
    return shown(search.top(hits_of(spark, sf_dir), 5, "collection_id"), "collection_id", "rank", "rel_path", "score")


@query(f"""WITH {HITS}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY {BY}) AS n FROM hits WHERE collection_id IN ('src1', 'src2', 'src3')) WHERE n <= 20)
SELECT rank, collection_id, rel_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY {BY})::INT AS rank FROM kept) WHERE rank <= 30""")
def multi_scope_merge(spark, sf_dir):
    hits = hits_of(spark, sf_dir).where(F.col("collection_id").isin("src1", "src2", "src3"))
    return shown(search.top(search.top(hits, 20, "collection_id").drop("rank"), 30), "rank", "collection_id", "rel_path", "score")


KEPT = f"{HITS}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY {BY}) AS n FROM hits) WHERE n <= 50)"


@query(f"WITH {KEPT} SELECT row_number() OVER (ORDER BY {BY})::INT AS rank, rel_path, round(score, 6) AS score FROM kept")
def rank_results(spark, sf_dir):
    return shown(search.ranked(search.top(hits_of(spark, sf_dir), 50, "collection_id").drop("rank")), "rank", "rel_path", "score")


@query(f"WITH {HITS} SELECT rel_path, round(score, 6) AS score FROM hits WHERE score >= 0.25")
def filter_min_score(spark, sf_dir):
    return shown(hits_of(spark, sf_dir).where("score >= 0.25"), "rel_path", "score")


@query(f"""WITH {HITS}, t AS (SELECT *, row_number() OVER (ORDER BY {BY}) AS n, first_value(score) OVER (ORDER BY {BY}) AS best FROM hits)
SELECT rel_path, round(score, 6) AS score FROM t WHERE n = 1 OR (score >= 0.85 * best AND best - score <= 0.1)""")
def dynamic_threshold(spark, sf_dir):
    return shown(search.threshold(hits_of(spark, sf_dir), 0.85, 0.1), "rel_path", "score")


@query(f"""WITH {HITS}, f AS (SELECT * REPLACE ('file-' || label AS rel_path) FROM hits)
SELECT rel_path, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY {BY}) AS n FROM f) WHERE n = 1""")
def dedup_by_file(spark, sf_dir):
    hits = hits_of(spark, sf_dir).withColumn("rel_path", F.concat(F.lit("file-"), F.col("label")))
    return shown(search.unique(hits), "rel_path", "chunk_id", "score")


@query(f"WITH {HITS} SELECT rel_path, CASE WHEN 2 * score >= 0.5 THEN 'high' WHEN 2 * score >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM hits")
def score_band(spark, sf_dir):
    return hits_of(spark, sf_dir).select("rel_path", tx.score_band(2 * F.col("score")).alias("band"))


CENTROIDS = """
parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
pooled AS (SELECT label, list(x ORDER BY i) AS v FROM parts GROUP BY label),
centroids AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS tag_vector FROM pooled)
"""


def centroids_of(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    return embedder.mean_pooled(e, "label").withColumnRenamed("vector", "tag_vector")


@query(f"""WITH {HITS}, {CENTROIDS},
s AS (SELECT hits.* EXCLUDE (score), score AS content_score, list_cosine_similarity(tag_vector, (SELECT tag_vector FROM centroids WHERE label = (SELECT label FROM embeddings WHERE vec_id = {QUERY_ROW}))) AS tag_score
      FROM hits JOIN centroids USING (label)),
f AS (SELECT *, (1 - 0.3::DOUBLE) * content_score + 0.3::DOUBLE * tag_score AS score FROM s)
SELECT rank, rel_path, round(score, 6) AS score, round(content_score, 6) AS content_score, round(tag_score, 6) AS tag_score FROM (SELECT *, row_number() OVER (ORDER BY {BY})::INT AS rank FROM f) WHERE rank <= 20""")
def tag_fusion_search(spark, sf_dir):
    centroids = centroids_of(spark, sf_dir)
    own = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ROW).select("label").join(centroids, "label").first()
    chunks = chunks_of(spark, sf_dir).where(F.col("doc_id") != QUERY_ROW).join(centroids, "label")
    return shown(search.top(search.scored(chunks, vector_of(spark, sf_dir), own["tag_vector"], 0.3), 20), "rank", "rel_path", "score", "content_score", "tag_score")


@query(f"""WITH {HITS}, {CENTROIDS},
own AS (SELECT tag_vector AS tv FROM centroids WHERE label = (SELECT label FROM embeddings WHERE vec_id = {QUERY_ROW})),
f AS (SELECT rel_path, score AS content_score, CASE WHEN label % 2 = 0 THEN list_cosine_similarity(tag_vector, tv) END AS tag_score FROM hits JOIN centroids USING (label), own),
g AS (SELECT *, CASE WHEN tag_score IS NULL THEN content_score ELSE (1 - 0.3::DOUBLE) * content_score + 0.3::DOUBLE * tag_score END AS pre FROM f)
SELECT rel_path, round(greatest(pre, 0) / max(greatest(pre, 0)) OVER (), 6) AS score, round(content_score, 6) AS content_score, round(tag_score, 6) AS tag_score, round(pre, 6) AS pre_rerank_score FROM g""")
def explain_scores(spark, sf_dir):
    """Content, tag and fused scores of every hit beside a last score that a re-ranking made; labels of odd number have no tag vector."""
    centroids = centroids_of(spark, sf_dir)
    own = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ROW).select("label").join(centroids, "label").first()
    chunks = chunks_of(spark, sf_dir).where(F.col("doc_id") != QUERY_ROW).join(centroids, "label").withColumn("tag_vector", F.when(F.col("label") % 2 == 0, F.col("tag_vector")))
    hits = search.seeded(search.scored(chunks, vector_of(spark, sf_dir), own["tag_vector"], 0.3))
    hits = hits.withColumn("floored", F.greatest("score", F.lit(0.0)))
    return shown(hits.withColumn("score", lexical.max_normalized("floored")), "rel_path", "score", "content_score", "tag_score", "pre_rerank_score")


@query("""SELECT conv_id, turn, role <> 'system' AND turn % 5 <> 4 AND conv_id % 7 <> 0 AND length(trim(text)) >= 4 AND len(string_split(trim(text), ' ')) > 1 AS fuse FROM conversations""")
def tag_fusion_gate(spark, sf_dir):
    """Turns as queries: some with tags turned off, some of weight 0, some of images; every word but the first is a tag."""
    c = table(spark, sf_dir, "conversations")
    tags = F.size(F.split(F.trim("text"), " ")) - 1
    weight = F.when(F.col("turn") % 5 == 4, 0.0).otherwise(0.3)
    kind = F.when(F.col("conv_id") % 7 == 0, " Image").otherwise("markdown")
    return c.select("conv_id", "turn", search.fusion_gate(F.col("text"), tags, weight, F.col("role") == "system", kind).alias("fuse"))


@query(f"WITH {CENTROIDS} SELECT label, generate_subscripts(tag_vector, 1)::INT - 1 AS pos, round(unnest(tag_vector), 6) AS x FROM centroids")
def mean_pool_normalized(spark, sf_dir):
    return centroids_of(spark, sf_dir).select("label", F.posexplode("tag_vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, (embedding::DOUBLE[])[1:8] AS h FROM embeddings)
SELECT vec_id, generate_subscripts(v, 1)::INT - 1 AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS x,
round(unnest(list_transform(v, lambda x, i: CASE WHEN i <= 8 THEN x / sqrt(list_inner_product(h, h)) END)), 6) AS short FROM v""")
def l2_normalize(spark, sf_dir):
    """Every component of every vector, of the whole and of its first eight alone."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vx.l2_normalize(F.col("embedding")).alias("v"), vx.l2_normalize(F.col("embedding"), 8).alias("h"))
    return e.select("vec_id", "h", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"), F.round(F.get("h", F.col("pos")), 6).alias("short"))


# Whole retrievals

PIPE = f"""{HITS},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY {BY}) AS n FROM hits) WHERE n <= 50),
t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {BY}) AS m, first_value(score) OVER (ORDER BY {BY}) AS best FROM w) WHERE m = 1 OR (score >= 0.6::DOUBLE * best AND best - score <= 0.2::DOUBLE)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY {BY}) AS k FROM t) WHERE k = 1)
"""
PIPE_OPTIONS = search.Options(limit=10, alpha=0.6, delta=0.2)


@query(f"WITH {PIPE} SELECT rank, rel_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY {BY})::INT AS rank FROM u) WHERE rank <= 10")
def query_pipeline(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir).where(F.col("doc_id") != QUERY_ROW)
    return shown(search.retrieve(chunks, vector_of(spark, sf_dir), PIPE_OPTIONS), "rank", "rel_path", "score")


@query(f"""WITH {PIPE} SELECT (SELECT count(DISTINCT collection_id) FROM w) AS scopes, (SELECT round(max(score), 6) FROM w) AS top_score, (SELECT count(*) FROM w) AS retrieved,
(SELECT count(*) FROM t) AS after_threshold, (SELECT count(*) FROM u) AS after_unique, (SELECT least(count(*), 10) FROM u) AS final""")
def explain_counts(spark, sf_dir):
    o = PIPE_OPTIONS.normalized()
    return shown(search.explain(search.windowed(hits_of(spark, sf_dir), o), o), "scopes", "top_score", "retrieved", "after_threshold", "after_unique", "final")


TOKENS = "regexp_extract_all(lower({}), '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}]|[\\p{{L}}\\p{{Nd}}_]+')"
BENCH = 0


@query(f"""WITH {HITS}, k AS (SELECT * FROM hits ORDER BY {BY} LIMIT 50),
qt AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS token FROM benchmark WHERE item_id = {BENCH}),
dt AS (SELECT doc_id, {TOKENS.format("rel_path || ' ' || '' || ' ' || array_to_string(tags, ' ') || ' ' || text")} AS toks FROM k),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM dt),
tf AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) JOIN qt USING (token) GROUP BY ALL),
df AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token),
b AS (SELECT dt.doc_id, coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 0) AS bm25_score FROM dt CROSS JOIN st LEFT JOIN tf USING (doc_id) LEFT JOIN df USING (token) GROUP BY dt.doc_id),
z AS (SELECT k.* EXCLUDE (score), k.score AS pre_rerank_score, bm25_score, bm25_score / max(bm25_score) OVER () AS bm25_norm, greatest(k.score, 0) / max(greatest(k.score, 0)) OVER () AS semantic_norm FROM k JOIN b USING (doc_id)),
y AS (SELECT *, 0.7 * semantic_norm + 0.3 * bm25_norm AS score FROM z)
SELECT row_number() OVER (ORDER BY {BY})::INT AS rank, rel_path, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score, round(bm25_norm, 6) AS bm25_norm, round(semantic_norm, 6) AS semantic_norm, round(pre_rerank_score, 6) AS pre_rerank_score FROM y""")
def bm25_rerank(spark, sf_dir):
    text = table(spark, sf_dir, "benchmark").where(F.col("item_id") == BENCH).select("text").first()[0]
    kept = search.top(hits_of(spark, sf_dir), 50).drop("rank").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return shown(search.ranked(lexical.rerank(kept, text)), "rank", "rel_path", "score", "bm25_score", "bm25_norm", "semantic_norm", "pre_rerank_score")


@query(f"WITH {KEPT} SELECT rel_path, round(greatest(score, 0) / max(greatest(score, 0)) OVER (PARTITION BY collection_id), 6) AS score FROM kept")
def score_max_normalize(spark, sf_dir):
    hits = search.top(hits_of(spark, sf_dir), 50, "collection_id").withColumn("score", F.greatest("score", F.lit(0.0)))
    return hits.select("rel_path", F.round(lexical.max_normalized("score", "collection_id"), 6).alias("score"))


@query(f"""WITH RECURSIVE {HITS}, k AS (SELECT *, row_number() OVER (ORDER BY {BY}) AS n FROM (SELECT * FROM hits ORDER BY {BY} LIMIT 50)),
m AS (
  SELECT 1 AS step, [(SELECT n FROM k ORDER BY score DESC, n LIMIT 1)] AS sel
  UNION ALL
  SELECT step + 1, list_append(sel, (SELECT k.n FROM k WHERE NOT list_contains(m.sel, k.n) ORDER BY 0.5::DOUBLE * k.score - 0.5::DOUBLE * greatest(0, (SELECT max(list_cosine_similarity(k.vector, s.vector)) FROM k s WHERE list_contains(m.sel, s.n))) DESC, k.n LIMIT 1))
  FROM m WHERE step < 10
), picked AS (SELECT unnest(sel) AS n, generate_subscripts(sel, 1) AS rank FROM m WHERE step = 10)
SELECT rank::INT AS rank, rel_path, round(score, 6) AS score, round(score, 6) AS mmr_relevance FROM picked JOIN k USING (n)""")
def mmr_select(spark, sf_dir):
    kept = search.top(hits_of(spark, sf_dir), 50).drop("rank", "tag_score")
    return shown(diversify.mmr(kept, vector_of(spark, sf_dir), 10, 0.5), "rank", "rel_path", "score", "mmr_relevance")


MMR_K = 6


@query(f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, e.v, list_cosine_similarity(e.v, q.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT query_id, vec_id, v, score, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS n FROM s) WHERE n <= 20),
sim AS (SELECT a.query_id, a.n, b.n AS m, list_cosine_similarity(a.v, b.v) AS c FROM k a JOIN k b USING (query_id) WHERE a.n <> b.n),
sims AS (SELECT query_id, n, score, list(c ORDER BY m) AS c, list(m ORDER BY m) AS m FROM sim JOIN k USING (query_id, n) GROUP BY query_id, n, score),
best AS (
  SELECT query_id, 1 AS step, [1::BIGINT] AS picked FROM k GROUP BY query_id
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, arg_min(n, (-value, n))) FROM (
    SELECT b.query_id, b.step, b.picked, s.n, 0.5::DOUBLE * s.score - 0.5::DOUBLE * greatest(0, list_max(list_transform(b.picked, lambda p: s.c[list_position(s.m, p)]))) AS value
    FROM best b JOIN sims s ON s.query_id = b.query_id AND NOT list_contains(b.picked, s.n) WHERE b.step < {MMR_K}) GROUP BY query_id, step, picked
), p AS (SELECT query_id, unnest(picked) AS n, generate_subscripts(picked, 1)::INT AS rank FROM best WHERE step = {MMR_K})
SELECT query_id, rank, vec_id::VARCHAR AS chunk_id, round(score, 6) AS score, round(score, 6) AS mmr_relevance FROM p JOIN k USING (query_id, n)""")
def mmr_batch(spark, sf_dir):
    """Twenty candidates of each twentieth vector, picked anew: all queries at once."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    chunks = e.select(F.col("vec_id").cast("string").alias("vec_id"), "vector")
    near = search.batch_topk(chunks, asked.select(F.col("query_id").cast("string").alias("query_id"), F.col("query_vector").alias("vector")), 20).drop("rank").withColumn("query_id", F.col("query_id").cast("long"))
    near = near.join(chunks, "vec_id").join(asked, "query_id").withColumnRenamed("vec_id", "chunk_id").withColumns({"rel_path": F.lit(""), "chunk_index": F.lit(0)})
    return shown(diversify.mmr_batch(near, "query_id", MMR_K, 0.5), "query_id", "rank", "chunk_id", "score", "mmr_relevance")


# Filters, tags and text


@query("SELECT doc_id, source || '/' || doc_id AS rel_path FROM documents WHERE list_has_all([lower(lang), lower(source)], ['en', 'src3'])")
def filter_tags_and(spark, sf_dir):
    return search.filtered(files_of(table(spark, sf_dir, "documents")), [" SRC3", "en"]).select("doc_id", "rel_path")


@query("SELECT doc_id, source || '/' || doc_id AS rel_path FROM documents WHERE source || '/' || doc_id = 'src1' OR starts_with(source || '/' || doc_id, 'src1/')")
def filter_path_prefix(spark, sf_dir):
    return search.filtered(files_of(table(spark, sf_dir, "documents")), prefix="src1").select("doc_id", "rel_path")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lower(trim('  ' || lang || ' ')), lower(source), lower(upper(source)), ''], lambda t: t <> ''))), ',') AS tags FROM documents")
def normalize_tags(spark, sf_dir):
    raw = F.array(F.concat(F.lit("  "), F.col("lang"), F.lit(" ")), F.col("source"), F.upper("source"), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.normalize_tags(raw), ",").alias("tags"))


@query("""SELECT event_id, array_to_string(list_filter([lower(event_type), CASE WHEN length(user_id::VARCHAR || 'u') BETWEEN 2 AND 32 THEN user_id || 'u' END], lambda t: t IS NOT NULL), ',') AS tags FROM events""")
def normalize_semantic_tags(spark, sf_dir):
    raw = F.array(F.upper("event_type"), F.concat(F.lit(" "), "event_type"), F.col("user_id").cast("string"), F.concat("user_id", F.lit("U")), F.lit("!!!"), F.lit("x"), F.lit("see http://a"), F.lit("a\tb"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tx.normalize_semantic_tags(raw), ",").alias("tags"))


@query(f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize_bm25(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def bm25_document_frequency(spark, sf_dir):
    return lexical.document_frequency(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, CASE WHEN length(t) > 120 THEN left(t, 119) || '…' ELSE t END AS preview, CASE WHEN length(t) > 72 THEN left(t, 71) || '…' ELSE t END AS short_preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def preview_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"), tx.preview(F.col("text"), 72).alias("short_preview"))


@query("""SELECT page_id, CASE WHEN x <> '' THEN '/' || x ELSE '/' END AS path FROM (SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+:/*', ''), '/'), lambda p: p <> '' AND p <> '.'), '/') AS x FROM pages)""")
def normalize_path(spark, sf_dir):
    dirty = F.concat(F.lit(" /./tmp/.."), F.lit("//"), F.regexp_replace("url", "^[a-z]+:/*", ""), F.lit("/./ "))
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_path(dirty).alias("path"))


# Identities and chunks

RECIPE = hx.Recipe("markdown", "v1", "offline", "keyword", 3, splitter_options={"short_file_max_chars": 4000})


@query(f"""WITH c AS (SELECT doc_id, source || '/' || doc_id AS rel_path, source AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM documents),
f AS (SELECT *, sha256(title || chr(31) || 'part' || chr(30) || content) AS section_fingerprint FROM c)
SELECT doc_id, section_fingerprint, sha256(rel_path || '|{SPLITTER.recipe_hash()}|0|' || section_fingerprint) AS chunk_id, substr(sha256(rel_path), 1, 32) AS collection_id FROM f""")
def chunk_ids(spark, sf_dir):
    f = files_of(table(spark, sf_dir, "documents")).withColumn("section_fingerprint", hx.fingerprint(F.array(F.col("source"), F.lit("part")), F.col("text")))
    return f.select(
        "doc_id", "section_fingerprint", hx.chunk_id(F.col("rel_path"), F.lit(SPLITTER.recipe_hash()), F.lit(0), F.col("section_fingerprint")).alias("chunk_id"),
        hx.collection_id(F.col("rel_path")).alias("collection_id"),
    )


@query("SELECT doc_id, sha256('type=markdown|options={lang=' || lang || ',source=' || source || '}') AS recipe FROM documents")
def recipe_hash(spark, sf_dir):
    options = tx.canonical_map(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("type=markdown|options="), options), 256).alias("recipe"))


@query("""SELECT doc_id, source || '/' || doc_id AS rel_path, sha256(text) AS file_hash, doc_id || '.md' AS file_name, coalesce(nullif(trim(lang), ''), source) AS title,
array_to_string(list_sort(list_distinct([lower(lang), lower(source)])), ',') AS tags FROM documents""")
def document_metadata(spark, sf_dir):
    return files_of(table(spark, sf_dir, "documents")).select(
        "doc_id", "rel_path", hx.file_hash(F.col("text")).alias("file_hash"), F.concat("doc_id", F.lit(".md")).alias("file_name"),
        F.coalesce(F.nullif(tx.strip(F.col("lang")), F.lit("")), "source").alias("title"), F.array_join("tags", ",").alias("tags"),
    )


BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256(source || ' > ' || lang || chr(10) || chr(10) || {BODY}) AS content FROM documents")
def chunk_assemble(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.titled(F.array(F.col("source"), F.lit(" "), F.col("lang")), F.col("text")), 256).alias("content"))


@query(f"SELECT doc_id, length(source || chr(10) || chr(10) || {BODY}) <= 4000 AS short FROM documents")
def short_file_chunk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(tx.titled(F.array("source"), F.col("text"))) <= SPLITTER.short_file).alias("short"))


def windows_sql(texts: str = r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, 1200 AS most FROM documents", overlap: int = 120) -> str:
    """Common tables ``parts(doc_id, part, begin, t, most, stop)`` of texts(doc_id, t, most): a recursion that finds one window of each text a round."""
    tail = "substr(t, begin + most // 2 + 2, most - most // 2 - 1)"
    stop = rf"""CASE WHEN begin + most >= length(t) THEN length(t) WHEN regexp_matches({tail}, '\s') THEN begin + most // 2 + 1 + length(regexp_extract({tail}, '(?s)^(.*)\s', 1)) ELSE begin + most END"""
    return rf"""
texts AS ({texts}),
parts AS (
  SELECT doc_id, 0 AS part, begin, t, most, {stop} AS stop FROM (SELECT *, 0::BIGINT AS begin FROM texts WHERE t <> '')
  UNION ALL
  SELECT doc_id, part + 1, begin, t, most, {stop} FROM (
    SELECT doc_id, part, t, most, stop - {overlap} + length(regexp_extract(substr(t, stop - {overlap} + 1), '^\s*')) AS begin FROM parts WHERE stop < length(t))
)"""


@query(rf"""WITH RECURSIVE {windows_sql()}, p AS (SELECT doc_id, part, regexp_replace(substr(t, begin + 1, stop - begin), '^\s+|\s+$', '', 'g') AS content FROM parts)
SELECT doc_id, part, length(content)::INT AS size, sha256(content) AS content FROM p""")
def split_long_text(spark, sf_dir):
    """Overlapping windows of every text."""
    return markdown.text_windows(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "part", F.length("content").alias("size"), F.sha2("content", 256).alias("content"))


def fenced() -> Column:
    """A document under front matter."""
    return F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\ntags: ["), F.col("lang"), F.lit(", Any]\n---\n\n"), F.col("text"))


@query("SELECT doc_id, 'title: ' || source || chr(10) || 'tags: [' || lang || ', Any]' AS front, sha256(regexp_replace(text, '^[\\r\\n]+', '')) AS body FROM documents")
def front_matter_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", fenced().alias("t"))
    body = F.regexp_replace(F.regexp_replace("t", tx.FRONT_MATTER, ""), r"^[\r\n]+", "")
    return d.select("doc_id", F.regexp_extract("t", tx.FRONT_MATTER, 1).alias("front"), F.sha2(body, 256).alias("body"))


LINES = "list_filter(list_transform(string_split(translate(text, '*_~`[]|<>#', ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, array_to_string({LINES}, chr(10)) AS t FROM documents),
whole AS (SELECT *, source || chr(10) || chr(10) || CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END || '## Part' || chr(10) || chr(10) || t || chr(10) || chr(10) || '### Note' || chr(10) || chr(10) || '- one' || chr(10) || '- two' AS content FROM d),
long AS (SELECT * FROM whole WHERE length(content) > {SPLITTER.short_file}),
parts_of AS (SELECT doc_id, s AS section, t, source || CASE WHEN s = 1 THEN ' > Part' ELSE '' END AS titles FROM long, range(2) r(s)),{windows_sql(f"SELECT {{'at': doc_id, 's': section}} AS doc_id, t, {SPLITTER.most} - length(titles) - 2 AS most FROM parts_of WHERE length(titles) + 2 + length(t) > {SPLITTER.most}")},
pieces AS (
  SELECT doc_id, section, 0 AS part, titles, t AS body FROM parts_of WHERE length(titles) + 2 + length(t) <= {SPLITTER.most}
  UNION ALL SELECT w.doc_id, section, part, titles, regexp_replace(substr(p.t, begin + 1, stop - begin), '^\s+|\s+$', '', 'g') FROM parts p JOIN parts_of w ON p.doc_id.at = w.doc_id AND p.doc_id.s = section
  UNION ALL SELECT doc_id, 2, 0, source || ' > Part > Note', '- one' || chr(10) || '- two' FROM long),
numbered AS (
  SELECT doc_id, titles, titles || chr(10) || chr(10) || body AS content, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_index FROM pieces
  UNION ALL SELECT doc_id, source, content, 0 FROM whole WHERE length(content) <= {SPLITTER.short_file})
SELECT source || '/' || doc_id AS rel_path, chunk_index::INT AS chunk_index, titles, array_to_string(list_sort([lower(lang), 'any']), ',') AS tags, length(content)::INT AS size,
sha256(source || '/' || doc_id || '|{SPLITTER.recipe_hash()}|' || chunk_index || '|' || sha256(replace(titles, ' > ', chr(31)) || chr(30) || content)) AS chunk_id FROM numbered JOIN d USING (doc_id)""")
def markdown_chunks(spark, sf_dir):
    """Chunks of every document, freed of marks, under front matter and again under headings, with a list at the end."""
    d = files_of(table(spark, sf_dir, "documents"))
    lines = F.filter(F.transform(F.split(F.translate("text", "*_~`[]|<>#", ""), "\n"), tx.strip), lambda x: x != "")
    clean = d.withColumn("text", F.array_join(lines, "\n"))
    headed = F.concat(fenced(), F.lit("\n\n## Part\n\n"), F.col("text"), F.lit("\n\n### Note\n\n- one\n- two\n"))
    return markdown.chunks(clean.select("rel_path", headed.alias("content"))).select(
        "rel_path", "chunk_index", F.array_join("title_path", " > ").alias("titles"), F.array_join("tags", ",").alias("tags"), F.length("content").alias("size"), "chunk_id"
    )


SMALL = markdown.Splitter(most=300, overlap=30, short_file=400)
FILE = "array_to_string(list_transform(lines, lambda x, i: CASE WHEN i % 3 = 1 THEN repeat('#', 1 + ((i - 1) // 3) % 3) || ' Part ' || (i - 1) || chr(10) || chr(10) ELSE '' END || 'Line ' || x), chr(10) || chr(10))"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, source, {LINES} AS lines FROM documents),
whole AS (SELECT doc_id, source, source || CASE WHEN len(lines) > 0 THEN chr(10) || chr(10) || {FILE} ELSE '' END AS content FROM d),
l AS (SELECT doc_id, source, 'Line ' || unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS n FROM d JOIN whole USING (doc_id, source) WHERE length(content) > {SMALL.short_file}),
h AS (SELECT *, n // 3 AS sec, n // 9 * 9 AS first, (n // 3) % 3 AS depth FROM l),
titled AS (SELECT *, source || ' > Part ' || first || CASE WHEN depth > 0 THEN ' > Part ' || (first + 3) ELSE '' END || CASE WHEN depth > 1 THEN ' > Part ' || (first + 6) ELSE '' END AS titles FROM h),
sized AS (SELECT *, length(titles) + 2 AS lead, {SMALL.most} - length(titles) - 2 AS room, n % 3 AS k, lag(length(t)) OVER s AS one, lag(length(t), 2) OVER s AS two FROM titled WINDOW s AS (PARTITION BY doc_id, sec ORDER BY n)),
big AS (SELECT doc_id, n, t, room FROM sized WHERE length(t) > room),{windows_sql("SELECT {'at': doc_id, 'n': n} AS doc_id, t, room AS most FROM big", SMALL.overlap)},
joined AS (SELECT *, coalesce(length(t) <= room AND one <= room AND one + 2 + length(t) <= room, false) AS pair, coalesce(length(t) <= room AND one <= room AND two <= room AND two + 2 + one <= room, false) AS before FROM sized),
runs AS (SELECT *, CASE WHEN before THEN two + 2 + one + 2 + length(t) <= room ELSE pair END AS glued FROM joined),
numbered AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sec ORDER BY n) AS run FROM runs),
small AS (SELECT doc_id, titles, min(n) AS n, 0 AS part, string_agg(t, chr(10) || chr(10) ORDER BY n) AS body FROM numbered WHERE length(t) <= room GROUP BY doc_id, sec, titles, run),
cut AS (SELECT b.doc_id, titles, b.n, part, regexp_replace(substr(p.t, begin + 1, stop - begin), '^\s+|\s+$', '', 'g') AS body FROM parts p JOIN sized b ON p.doc_id.at = b.doc_id AND p.doc_id.n = b.n),
pieces AS (SELECT doc_id, titles, titles || chr(10) || chr(10) || body AS content, row_number() OVER (PARTITION BY doc_id ORDER BY n, part) - 1 AS chunk_index FROM (FROM small UNION ALL BY NAME FROM cut)
  UNION ALL SELECT doc_id, source, content, 0 FROM whole WHERE length(content) <= {SMALL.short_file})
SELECT source || '/' || doc_id AS rel_path, chunk_index::INT AS chunk_index, titles, sha256(content) AS content,
sha256(source || '/' || doc_id || '|{SMALL.recipe_hash()}|' || chunk_index || '|' || sha256(replace(titles, ' > ', chr(31)) || chr(30) || content)) AS chunk_id FROM pieces JOIN documents USING (doc_id)""")
def markdown_sections(spark, sf_dir):
    """Chunks of a file a document under front matter: each line a paragraph, each third under a heading one level deeper, in small chunks."""
    d = files_of(table(spark, sf_dir, "documents"))
    lines = F.filter(F.transform(F.split(F.translate("text", "*_~`[]|<>#", ""), "\n"), tx.strip), lambda x: x != "")
    heading = lambda i: F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 3).cast("int") % 3), F.lit(" Part "), i.cast("string"), F.lit("\n\n"))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 3 == 0, heading(i)).otherwise(""), F.lit("Line "), x)), "\n\n")
    content = F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n\n"), body)
    return markdown.chunks(d.select("rel_path", content.alias("content")), SMALL).select(
        "rel_path", "chunk_index", F.array_join("title_path", " > ").alias("titles"), F.sha2("content", 256).alias("content"), "chunk_id"
    )


# Incremental scans


def prior_states(docs: DataFrame) -> DataFrame:
    """An earlier scan: every seventh file unknown, every fifth changed since, every third made with another recipe, and files since gone."""
    d = files_of(docs)
    known = d.where("doc_id % 7 <> 0").select(
        "rel_path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("file_hash"),
        F.when(F.col("doc_id") % 3 == 0, "old").otherwise(RECIPE.hash()).alias("recipe_hash"),
    )
    gone = d.where("doc_id % 11 = 0").select(F.concat("rel_path", F.lit(".gone")).alias("rel_path"), F.lit("").alias("file_hash"), F.lit("old").alias("recipe_hash"))
    return known.union(gone)


@query("""SELECT source || '/' || doc_id AS rel_path, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action,
array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'missing_state' END, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'file_hash_changed' END, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'recipe_changed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def incremental_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = files_of(docs).select("rel_path", F.sha2("text", 256).alias("file_hash"))
    return incremental.plan(files, prior_states(docs), RECIPE.hash()).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT source || '/' || doc_id || '.gone' AS rel_path FROM documents WHERE doc_id % 11 = 0")
def reconcile_deleted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return incremental.deleted(prior_states(docs), files_of(docs)).select("rel_path")


@query("""SELECT source AS collection_id, array_to_string(list_filter([CASE WHEN max(doc_id) % 2 = 0 THEN 'model_changed' END, CASE WHEN count(*) % 2 = 0 THEN 'vector_dim_changed' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents GROUP BY source HAVING max(doc_id) % 2 = 0 OR count(*) % 2 = 0""")
def config_rebuild(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("collection_id")).agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    same = {"provider": F.lit("p"), "splitter": F.lit("s"), "db_version": F.lit("v2")}
    stored = per.select("collection_id", F.lit("m").alias("model"), F.lit(3).alias("vector_dim"), *[c.alias(k) for k, c in same.items()])
    now = per.select("collection_id", F.when(F.col("last") % 2 == 0, "n").otherwise("m").alias("model"), F.when(F.col("n") % 2 == 0, 4).otherwise(3).alias("vector_dim"), *[c.alias(k) for k, c in same.items()])
    return incremental.rebuild_reasons(stored, now).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents""")
def upsert_chunks(spark, sf_dir):
    """A chunk a document; those of the files that the plan marks are written anew, and files not known before are added."""
    ids = files_of(table(spark, sf_dir, "documents")).select("rel_path", F.col("doc_id").alias("chunk_id"))
    marked = incremental_plan(spark, sf_dir).where("action = 'update'").select("rel_path")
    old = ids.where("chunk_id % 7 <> 0").select("chunk_id", F.lit("old").alias("version"))
    return incremental.upsert(old, ids.join(marked, "rel_path").select("chunk_id", F.lit("new").alias("version")))


@query("SELECT doc_id, source FROM documents WHERE source <> 'src3'")
def delete_by_source(spark, sf_dir):
    return incremental.without_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "src3")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def find_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source") == "src3").select("doc_id", "lang")


@query("SELECT doc_id AS chunk_id, label, e.vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings e ON doc_id = vec_id")
def embed_join(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    have, lack = incremental.embedded(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label"))
    return have.withColumn("missing", F.lit(False)).unionByName(lack.withColumns({"label": F.lit(None).cast("int"), "missing": F.lit(True)})).withColumn("label", F.coalesce("label", F.lit(-1)))


ORACLES["embed_join"] = "SELECT doc_id AS chunk_id, coalesce(label, -1)::INT AS label, e.vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings e ON doc_id = vec_id"


# The registry of collections

REGISTRY_SQL = """
paths AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+:/*', '') AS path FROM pages),
registry AS (SELECT DISTINCT root FROM (SELECT '/' || regexp_extract(path, '^/([^/]+)', 1) AS root FROM paths WHERE page_id % 2 = 0
  UNION ALL SELECT regexp_extract(path, '^(/[^/]+/[^/]+)', 1) FROM paths WHERE page_id % 3 = 0) WHERE root <> '' AND root <> '/')
"""


def paths_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+:/*", "")).alias("path"))


def registry_of(spark, sf_dir) -> DataFrame:
    p = paths_of(spark, sf_dir)
    hosts = p.where("page_id % 2 = 0").select(F.concat(F.lit("/"), F.regexp_extract("path", "^/([^/]+)", 1)).alias("root"))
    parts = p.where("page_id % 3 = 0").select(F.regexp_extract("path", "^(/[^/]+/[^/]+)", 1).alias("root"))
    return hosts.union(parts).where("root <> '' and root <> '/'").distinct()


@query(f"""WITH {REGISTRY_SQL}, m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS n FROM (SELECT DISTINCT path FROM paths) JOIN registry ON path = root OR starts_with(path, root || '/'))
SELECT path, root, CASE WHEN path = root THEN '' ELSE substr(path, length(root) + 2) END AS rest FROM m WHERE n = 1""")
def scope_resolve_longest_prefix(spark, sf_dir):
    return scopes.longest_prefix(paths_of(spark, sf_dir), registry_of(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT lang AS path FROM documents), r AS (SELECT DISTINCT lang || '/' || source AS root FROM documents)
SELECT path, root FROM p JOIN r ON starts_with(root, path || '/')""")
def scope_descendants(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return scopes.descendants(d.select(F.col("lang").alias("path")).distinct(), d.select(F.concat_ws("/", "lang", "source").alias("root")).distinct())


@query("""WITH r AS (SELECT DISTINCT substr(sha256(source), 1, 32) AS collection_id FROM documents)
SELECT collection_id, false AS exact, count(*) OVER () AS matches FROM r WHERE starts_with(collection_id, substr(sha256('src3'), 1, 4))""")
def collection_id_prefix(spark, sf_dir):
    import hashlib

    r = table(spark, sf_dir, "documents").select("source").distinct().select(hx.collection_id(F.col("source")).alias("collection_id"))
    return scopes.by_id_prefix(r, hashlib.sha256(b"src3").hexdigest()[:4])


@query("""WITH r AS (SELECT source, CASE WHEN count(*) % 2 = 0 THEN '/var/folders/' ELSE '/home/' END || source AS root, max(doc_id) % 3 <> 0 AS readable FROM documents GROUP BY source)
SELECT substr(sha256(root), 1, 32) AS collection_id, root, CASE WHEN starts_with(root, '/var/folders/') THEN 'temporary' ELSE 'unreadable' END AS reason FROM r WHERE starts_with(root, '/var/folders/') OR NOT readable""")
def collection_prune_candidates(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    r = per.select(F.concat(F.when(F.col("n") % 2 == 0, "/var/folders/").otherwise("/home/"), "source").alias("root"), (F.col("last") % 3 != 0).alias("readable"))
    return scopes.prunable(r.withColumn("collection_id", hx.collection_id(F.col("root"))))


@query("""WITH r AS (SELECT DISTINCT source AS root FROM documents), s AS (SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chunks FROM documents WHERE source <> 'src3' GROUP BY source)
SELECT substr(sha256(root), 1, 12) AS short_id, root, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, CASE WHEN files IS NULL THEN '-' ELSE '2024-03-01 12:30' END AS updated, CASE WHEN files IS NULL THEN 'state not found' ELSE '' END AS error
FROM r LEFT JOIN s ON root = source""")
def collection_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select(F.col("source").alias("root")).distinct().withColumn("collection_id", hx.collection_id(F.col("root")))
    s = d.where("source <> 'src3'").select(hx.collection_id(F.col("source")).alias("collection_id"), F.col("n_chars").alias("chunk_count"), F.to_timestamp(F.lit("2024-03-01 12:30:45")).alias("last_indexed_at"))
    return scopes.listed(r, s)


@query("SELECT 'p' AS provider, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'multiple' END AS model, 0 AS vector_dim, 'v2' AS db_version, 'markdown' AS file_type, false AS mmr_compatible FROM documents")
def combined_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return scopes.combined(d.select(F.lit("p").alias("provider"), F.col("lang").alias("model"), F.length("lang").alias("vector_dim"), F.lit("v2").alias("db_version"), F.lit("markdown").alias("file_type")).withColumn(
        "vector_dim", F.when(F.col("model") == "en", 3).otherwise(F.col("vector_dim"))
    ))


@query(f"""WITH RECURSIVE {windows_sql()} SELECT source || '/' || d.doc_id AS rel_path, sha256(text) AS file_hash, count(part) AS chunk_count
FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id GROUP BY ALL""")
def file_states_snapshot(spark, sf_dir):
    """A state a file: its hash and how many windows it is cut into."""
    docs = table(spark, sf_dir, "documents")
    counts = markdown.text_windows(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    files = files_of(docs).select("doc_id", "rel_path", hx.file_hash(F.col("text")).alias("file_hash"))
    return files.join(counts, "doc_id", "left").select("rel_path", "file_hash", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))


@query("""SELECT count(*) FILTER (s IN ('skipped', 'updated')) AS processed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'updated') AS updated, count(*) FILTER (s = 'deleted') AS deleted, count(*) FILTER (s = 'error') AS errors
FROM (SELECT CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'updated' ELSE 'skipped' END AS s FROM documents UNION ALL SELECT 'deleted' FROM documents WHERE doc_id % 11 = 0)""")
def scan_summary(spark, sf_dir):
    done = incremental_plan(spark, sf_dir).select(F.when(F.col("action") == "skip", "skipped").otherwise("updated").alias("status"))
    return incremental.summary(done.union(reconcile_deleted(spark, sf_dir).select(F.lit("deleted"))))


KNOWN_TYPES = {".html": "page", ".htm": "page", ".md": "markdown", ".com": "site"}


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'md', 'htm', 'com')")
def scan_filter_ext(spark, sf_dir):
    wanted = [e[1:] for e in listing.extensions("HTML, .md,htm , com", KNOWN_TYPES)]
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext")).where(F.col("ext").isin(*wanted))


PLACES = ("docs", "docs/Node_Modules/x", "build", "docs/build/keep", "a/.trash-1", ".config", "docs/drafts", "drafts")
RULES = ["# made by tools", "build/", "/drafts", "*.tmp.md", "!6*.tmp.md", "docs/**/keep?"]


@query(f"""WITH p AS (SELECT page_id, {list(PLACES)}[1 + page_id % {len(PLACES)}] AS place, page_id || CASE page_id % 5 WHEN 0 THEN '.tmp.md' WHEN 1 THEN '.MD' WHEN 2 THEN '.txt' WHEN 3 THEN 'md' ELSE '.html' END AS name FROM pages)
SELECT page_id, place || '/' || name AS rel_path, CASE WHEN name LIKE '%.html' THEN 'page' ELSE 'markdown' END AS doc_type FROM p
WHERE place IN ('docs', '.config', 'docs/drafts') AND (name LIKE '%.html' OR name LIKE '%.MD' OR (name LIKE '6%.tmp.md'))""")
def scan_prune(spark, sf_dir):
    """What a scan lists of an inventory with a file a page: skipped folders, rules of an ignore file, exclusions, types."""
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), 1 + (F.col("page_id") % len(PLACES)).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in (".tmp.md", ".MD", ".txt", "md", ".html")]), 1 + (F.col("page_id") % 5).cast("int"))
    inventory = table(spark, sf_dir, "pages").select("page_id", F.concat(place, F.lit("/"), F.col("page_id").cast("string"), end).alias("rel_path"))
    return listing.kept(inventory, KNOWN_TYPES, rules=[listing.Ignore(RULES), listing.Ignore(listing.patterns(".bak, *.txt,"))])


@query(r"""WITH f AS (SELECT url, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'page' WHEN 'htm' THEN 'page' WHEN 'md' THEN 'markdown' WHEN 'com' THEN 'site' ELSE 'other' END AS doc_type FROM pages)
SELECT doc_type, count(*) AS files, min(url) AS first_path, max(url) AS last_path FROM f GROUP BY doc_type""")
def group_files_by_type(spark, sf_dir):
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KNOWN_TYPES.items() for x in pair])[ext], F.lit("other"))
    return listing.by_type(table(spark, sf_dir, "pages").select(F.col("url").alias("rel_path"), kind.alias("doc_type")))


# Jobs over a store of their own


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for a store, where the cluster keeps its checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


JOB_WORDS = ("the", "der", "en", "de", "fr", "es", "a", "i", "n")
JOB_RECIPE = hx.Recipe("markdown", "v1", "offline", "keyword", len(JOB_WORDS))
ONE_CHUNK = markdown.Splitter(short_file=1 << 30)


def files_under(docs: DataFrame, content: Column) -> DataFrame:
    """A file ``/<source>/<doc_id>`` of the collection ``/<source>`` a document."""
    return docs.select(hx.collection_id(F.concat(F.lit("/"), "source")).alias("collection_id"), F.concat_ws("/", F.lit(""), "source", "doc_id").alias("rel_path"), content.alias("content"), "doc_id").withColumn(
        "file_hash", F.sha2("content", 256)
    )


def job_collections(docs: DataFrame) -> list[index.Collection]:
    return [index.Collection(f"/{r[0]}") for r in docs.select("source").distinct().collect()]  # the registry: a row a collection


@query("""WITH d AS (SELECT '/' || source || '/' || doc_id AS rel_path, doc_id, text, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS before FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'error' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'updated' ELSE 'skipped' END AS status FROM d)
SELECT rel_path, status, CASE WHEN status = 'error' AND doc_id % 7 = 0 THEN NULL WHEN status = 'error' THEN sha256(before) ELSE sha256(text) END AS file_hash,
  CASE WHEN status = 'error' AND doc_id % 7 = 0 THEN 0 ELSE 1 END AS chunk_count FROM s
UNION ALL SELECT rel_path || '.gone', 'deleted', NULL, 0 FROM d WHERE doc_id % 11 = 0""")
def scan_job(spark, sf_dir):
    """Two scans into a store: some files new, some changed, some gone, some unreadable, some with bad front matter; then what the store has of each."""
    docs = table(spark, sf_dir, "documents")
    store, known = index.Store(spark, workspace(spark, "scan-job")), job_collections(docs)
    first = files_under(docs.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    gone = files_under(docs.where("doc_id % 11 = 0"), F.col("text")).withColumn("rel_path", F.concat("rel_path", F.lit(".gone")))
    index.scan(store, first.union(gone).drop("doc_id"), JOB_RECIPE, known, ONE_CHUNK, words=JOB_WORDS)
    bad = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 17 == 0, F.lit("---\ntags: [x\n---\n")).otherwise(F.col("text"))
    second = files_under(docs, bad).withColumn("error", F.when(F.col("content").isNull(), "unreadable"))
    outcome = index.scan(store, second.drop("doc_id"), JOB_RECIPE, known, ONE_CHUNK, words=JOB_WORDS)
    return outcome.join(store.states().select(*index.KEYS, "file_hash", "chunk_count"), list(index.KEYS), "left").select("rel_path", "status", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


JOB_TEXT = "the end of it all"
COUNTS_SQL = "list_transform([" + ", ".join(f"'{w}'" for w in JOB_WORDS) + "], lambda w: ((length({0}) - length(replace({0}, w, ''))) / length(w))::DOUBLE)"
COSINE_SQL = "CASE WHEN list_inner_product({0}, {0}) > 0 THEN list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))) ELSE 0 END"


ASK_SQL = rf"""q AS (SELECT {COUNTS_SQL.format(f"'{JOB_TEXT}'")} AS qv, {COUNTS_SQL.format("'en'")} AS tv),
c AS (SELECT '/' || source || '/' || doc_id AS rel_path, source AS collection, {COUNTS_SQL.format(r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))")} AS v, {COUNTS_SQL.format("lower(lang)")} AS t FROM documents),
u AS (SELECT *, list_transform(t, lambda x: CASE WHEN list_inner_product(t, t) > 0 THEN (x / sqrt(list_inner_product(t, t)))::FLOAT::DOUBLE ELSE x END) AS tag FROM c),
s AS (SELECT rel_path, collection, {COSINE_SQL.format("v", "qv")} AS content_score, {COSINE_SQL.format("tag", "tv")} AS tag_score FROM u, q),
h AS (SELECT *, (1 - 0.3::DOUBLE) * content_score + 0.3::DOUBLE * tag_score AS score FROM s),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, rel_path) AS n FROM h) WHERE n <= 25),
t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, rel_path) AS m, first_value(score) OVER (ORDER BY score DESC, rel_path) AS best FROM w) WHERE m = 1 OR (score >= 0.5::DOUBLE * best AND best - score <= 0.4::DOUBLE))"""


@query(f"WITH {ASK_SQL} SELECT m::INT AS rank, rel_path, round(score, 6) AS score, round(content_score, 6) AS content_score, round(tag_score, 6) AS tag_score FROM t WHERE m <= 15")
def query_job(spark, sf_dir):
    """A text asked of all collections of a store that a scan has made, with tag fusion: front matter gives each file its language as a tag."""
    return shown(job_answer(spark, sf_dir).results, "rank", "rel_path", "score", "content_score", "tag_score")


def job_answer(spark: SparkSession, sf_dir: str) -> ask.Answer:
    docs = table(spark, sf_dir, "documents")
    store, known = index.Store(spark, workspace(spark, "query-job")), job_collections(docs)
    files = files_under(docs, F.concat(F.lit("---\ntags: ["), "lang", F.lit("]\n---\n\n"), "text"))
    index.scan(store, files.drop("doc_id"), JOB_RECIPE, known, ONE_CHUNK, tag_extractor="vocabulary", extractor_options={"words": ("en", "de")}, words=JOB_WORDS)
    return ask.ask(
        store, JOB_TEXT, options=search.Options(limit=15, window=25, alpha=0.5, delta=0.4), tag_extractor="vocabulary", extractor_options={"words": ("en", "de")},
        root_exists=lambda _: True, words=JOB_WORDS,
    )


@query(f"""WITH {ASK_SQL}, n AS (SELECT (SELECT count(*) FROM w) AS retrieved, (SELECT count(*) FROM t) AS passed, (SELECT count(DISTINCT collection) FROM c) AS scopes, (SELECT count(*) FROM documents) AS files)
SELECT 'v1' AS version, '{JOB_TEXT}' AS query, 'offline' AS provider, 'keyword' AS model, {len(JOB_WORDS)} AS vector_dim, 'en' AS query_tags, 25 AS search_window, 'truncate' AS final_strategy, scopes AS scope_count, retrieved AS retrieved_count, passed AS after_threshold_count,
  passed AS after_unique_count, least(passed, 15) AS final_count, m AS rank, rel_path, round(score, 6) AS score, round(content_score, 6) AS content_score, round(tag_score, 6) AS tag_score,
  CASE WHEN length(p) > 120 THEN left(p, 119) || '…' ELSE p END AS preview
FROM t JOIN (SELECT '/' || source || '/' || doc_id AS rel_path, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents) USING (rel_path), n WHERE m <= 15""")
def answer_json(spark, sf_dir):
    """The versioned JSON of an answer with its explanation, read back: a row a result with what the envelope says."""
    made = job_answer(spark, sf_dir).json(explain=True)
    result = "array<struct<rank:long,score:double,rel_path:string,preview:string,explain:struct<content_score:double,tag_score:double>>>"
    counts = ("scope_count", "retrieved_count", "after_threshold_count", "after_unique_count", "final_count")
    schema = f"version string, query string, provider string, model string, vector_dim int, query_tags array<string>, explain struct<search_window:int,final_strategy:string,{','.join(f'{c}:long' for c in counts)}>, results {result}"
    e = made.select(F.from_json("json", schema).alias("e")).select("e.*")
    rows = e.select("version", "query", "provider", "model", "vector_dim", F.array_join("query_tags", ",").alias("query_tags"), "explain.*", F.explode("results").alias("r"))
    told = rows.select(*[c for c in rows.columns if c != "r"], "r.rank", "r.rel_path", "r.score", "r.explain.content_score", "r.explain.tag_score", "r.preview")
    return told.withColumns({c: F.round(c, 6) for c in ("score", "content_score", "tag_score")})


BATCH_SQL = rf"""q AS (SELECT doc_id AS query_id, {COUNTS_SQL.format("lower(text)")} AS qv, {COUNTS_SQL.format("'en'")} AS en, {COUNTS_SQL.format("'de'")} AS de, contains(lower(text), 'en') AS is_en, contains(lower(text), 'de') AS is_de,
  CASE WHEN doc_id % 40 = 0 THEN '/' || source ELSE '' END AS path, CASE WHEN doc_id % 60 = 0 THEN lang END AS tag, length(trim(text)) >= 4 AS gate FROM documents WHERE doc_id % 20 = 0),
m AS (SELECT *, CASE WHEN NOT gate THEN NULL WHEN is_en AND is_de THEN list_transform(en, lambda x, i: x + de[i]) WHEN is_en THEN en WHEN is_de THEN de END AS tv FROM q),
c AS (SELECT '/' || source || '/' || doc_id AS rel_path, source AS collection, lang, {COUNTS_SQL.format(r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))")} AS v, {COUNTS_SQL.format("lower(lang)")} AS t FROM documents),
u AS (SELECT *, list_transform(t, lambda x: CASE WHEN list_inner_product(t, t) > 0 THEN (x / sqrt(list_inner_product(t, t)))::FLOAT::DOUBLE ELSE x END) AS tag_vector FROM c),
s AS (SELECT query_id, rel_path, collection, {COSINE_SQL.format("v", "qv")} AS content_score, CASE WHEN tv IS NOT NULL THEN {COSINE_SQL.format("tag_vector", "tv")} END AS tag_score FROM m JOIN u ON (path = '' OR rel_path = path OR starts_with(rel_path, path || '/')) AND (tag IS NULL OR lang = tag)),
h AS (SELECT *, CASE WHEN tag_score IS NULL THEN content_score ELSE (1 - 0.3::DOUBLE) * content_score + 0.3::DOUBLE * tag_score END AS score FROM s),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, rel_path) AS n FROM h) WHERE n <= 10),
b AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rel_path) AS best, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rel_path) AS k FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rel_path)::INT AS rank FROM b WHERE k = 1 OR (score >= 0.5::DOUBLE * best AND best - score <= 0.4::DOUBLE))"""


@query(f"WITH {BATCH_SQL} SELECT query_id, rank, rel_path, round(score, 6) AS score, round(content_score, 6) AS content_score, round(tag_score, 6) AS tag_score FROM r WHERE rank <= 10")
def query_batch_job(spark, sf_dir):
    """The texts of each twentieth document asked of a store that two scans have made, all at once; some under the path of their source, some with a tag."""
    docs = table(spark, sf_dir, "documents")
    store, known = index.Store(spark, workspace(spark, "query-batch")), job_collections(docs)
    tagged = F.concat(F.lit("---\ntags: ["), "lang", F.lit("]\n---\n\n"), "text")
    how = {"splitter": ONE_CHUNK, "tag_extractor": "vocabulary", "extractor_options": {"words": ("en", "de")}, "words": JOB_WORDS}
    first = files_under(docs, F.when(F.col("doc_id") % 3 == 0, F.concat(tagged, F.lit(" earlier"))).otherwise(tagged)).where("doc_id % 7 <> 0")
    index.scan(store, first.drop("doc_id"), JOB_RECIPE, known, **how)
    index.scan(store, files_under(docs, tagged).drop("doc_id"), JOB_RECIPE, known, **how)
    asked = docs.where("doc_id % 20 = 0").select(
        F.col("doc_id").alias("query_id"), "text", F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("/"), "source")).alias("path"), F.when(F.col("doc_id") % 60 == 0, F.array("lang")).alias("tags")
    )
    got = ask.ask_many(
        store, asked, search.Options(limit=10, window=10, alpha=0.5, delta=0.4), tag_extractor="vocabulary", extractor_options={"words": ("en", "de")}, root_exists=lambda _: True, words=JOB_WORDS,
    )
    return shown(got, "query_id", "rank", "rel_path", "score", "content_score", "tag_score")


@query(r"""SELECT '/' || source || '/' || doc_id AS rel_path, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version, sha256(regexp_replace(text || CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN '' ELSE 'x' END, '^\s+|\s+$', '', 'g')) AS content
FROM documents WHERE source IN ('src1', 'src3') AND lang = 'en' AND doc_id % 11 <> 0""")
def layered_store(spark, sf_dir):
    """What three scans have left, each of which changed other files, of two collections and the files with two tags: from the postings, and without a shuffle of chunks."""
    docs = table(spark, sf_dir, "documents")
    store, known = index.Store(spark, workspace(spark, "layers")), job_collections(docs)
    tagged = lambda body: F.concat(F.lit("---\ntags: ["), "lang", F.lit(", Any]\n---\n\n"), body)
    old, new = F.concat("text", F.lit("x")), F.col("text")
    for changed in (F.lit(False), F.col("doc_id") % 2 == 0, (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0)):
        rows = files_under(docs, tagged(F.when(changed, new).otherwise(old)))
        index.scan(store, rows.where("doc_id % 11 <> 0").drop("doc_id"), JOB_RECIPE, known, ONE_CHUNK, words=JOB_WORDS)
    ids = [c.collection_id for c in known if c.root in ("/src1", "/src3")]
    got = store.chunks(tags=["EN ", "any"], only=ids).join(files_under(docs, new).select("rel_path", "doc_id"), "rel_path")
    version = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0), "new").otherwise("old")
    return got.select("rel_path", version.alias("version"), F.sha2("content", 256).alias("content"))


PICTURES_SQL = "SELECT page_id, '/pages/' || page_id || '.png' AS rel_path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n, url FROM pages"


@query(rf"""WITH p AS ({PICTURES_SQL}), t AS (SELECT *, CASE WHEN trim(title) = '' THEN page_id::VARCHAR ELSE trim(title) END AS shown FROM p)
SELECT rel_path, CASE WHEN page_id % 9 = 0 THEN 'error' ELSE 'updated' END AS status, CASE WHEN page_id % 9 <> 0 THEN shown END AS title, CASE WHEN page_id % 9 <> 0 THEN 'a page of ' || n || ' characters' END AS content,
CASE WHEN page_id % 9 <> 0 THEN sha256(rel_path || '|' || '{hx.Recipe("image", "v1", "offline", "keyword", len(JOB_WORDS)).hash()}' || '|' || sha256(url) || '|0') END AS chunk_id FROM t""")
def scan_images(spark, sf_dir):
    """A picture a page, scanned through the provider of images with captions made of the pages; every ninth has none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("/pages/"), "page_id", F.lit(".png")).alias("rel_path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))
    home = index.Collection("/pages", file_type="image")
    captions = pages.where("page_id % 9 <> 0").select("rel_path", "title", F.array(F.lit(" Page"), F.lit("page")).alias("tags"), F.concat(F.lit(" a page of "), "n", F.lit(" characters")).alias("description"))
    found = pages.select(F.lit(home.collection_id).alias("collection_id"), "rel_path", F.lit(None).cast("string").alias("content"), F.sha2("url", 256).alias("file_hash"))
    store = index.Store(spark, workspace(spark, "scan-images"))
    recipe = hx.Recipe("image", "v1", "offline", "keyword", len(JOB_WORDS))
    outcome = index.scan(store, found, recipe, [home], provider_options={"captions": captions}, words=JOB_WORDS)
    return outcome.join(store.chunks(), list(index.KEYS), "left").select("rel_path", "status", "title", "content", "chunk_id")


@query(r"""SELECT '/' || source || '/' || doc_id AS path, doc_id % 7 <> 0 AS found, CASE WHEN doc_id % 7 <> 0 THEN '/' || source END AS root_dir,
CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '/' || source || '/' || doc_id END AS rel_path, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS file_hash,
CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END AS chunk_count, CASE WHEN doc_id % 7 <> 0 THEN sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS content FROM documents""")
def show_file(spark, sf_dir):
    """What a store shows of the path of every document: stored below its collection's root or under its whole path, or not at all."""
    docs = table(spark, sf_dir, "documents")
    store = index.Store(spark, workspace(spark, "show-file"))
    files = files_under(docs, F.col("text")).where("doc_id % 7 <> 0").withColumn("rel_path", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.col("rel_path")))
    index.scan(store, files.drop("doc_id"), JOB_RECIPE, job_collections(docs), ONE_CHUNK, words=JOB_WORDS)
    got = ask.shown_files(store, files_under(docs, F.col("text")).select(F.col("rel_path").alias("path")))
    return got.select("path", "found", "root_dir", "rel_path", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.sha2(F.get("chunks", F.lit(0))["content"], 256).alias("content"))


@query(r"""SELECT '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN 'true' ELSE 'false' END AS found, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS file_hash, CASE WHEN doc_id % 7 <> 0 THEN '/' || source END AS root_dir,
CASE WHEN doc_id % 7 <> 0 THEN '9' END AS vector_len, CASE WHEN doc_id % 7 <> 0 THEN sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS content, CASE WHEN doc_id % 7 <> 0 THEN 'false' ELSE 'true' END AS alone FROM documents""")
def show_json(spark, sf_dir):
    """The JSON that a store shows of the path of every document, read back; what is not found says only that."""
    docs = table(spark, sf_dir, "documents")
    store, files = index.Store(spark, workspace(spark, "show-json")), files_under(docs, F.col("text"))
    index.scan(store, files.where("doc_id % 7 <> 0").drop("doc_id"), JOB_RECIPE, job_collections(docs), ONE_CHUNK, words=JOB_WORDS)
    said = ask.show_json(ask.shown_files(store, files.select(F.col("rel_path").alias("path"))))
    get = lambda p: F.get_json_object("json", p)
    return said.select(
        "path", get("$.found").alias("found"), get("$.file.file_hash").alias("file_hash"), get("$.collection.root_dir").alias("root_dir"), get("$.chunks[0].vector_len").alias("vector_len"),
        F.sha2(get("$.chunks[0].content"), 256).alias("content"), (F.col("json") == '{"found":false}').cast("string").alias("alone"),
    )


@query("""WITH m AS (SELECT doc_id, source || '/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'metadata: source is required' WHEN doc_id % 7 = 0 THEN 'metadata: chunk_index must be an int'
  WHEN doc_id % 9 = 0 THEN 'metadata: tags must be a list of strings' WHEN doc_id % 11 = 0 THEN 'metadata: chunk_index must be >= 0' END AS error, lang, source FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN path END AS source, path AS file_path, 'h' || doc_id AS file_hash, CASE WHEN doc_id % 7 = 0 THEN -9 WHEN doc_id % 11 = 0 THEN -1 ELSE 3 END::INT AS chunk_index,
CASE WHEN doc_id % 9 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([lower(lang), lower(source)])), ',') END AS tags, error FROM m""")
def metadata_from_map(spark, sf_dir):
    """Metadata of every document from a loose JSON object: names in their other forms, and some fields blank, of another type or out of range."""
    d = files_of(table(spark, sf_dir, "documents"))
    name = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    path = F.concat(F.lit('"'), F.col("rel_path"), F.lit('"'))
    member = lambda key, value: F.concat(F.lit('"'), key, F.lit('": '), value)
    index_ = F.when(F.col("doc_id") % 7 == 0, '"3"').when(F.col("doc_id") % 11 == 0, "-1").otherwise("3")
    tags = F.when(F.col("doc_id") % 9 == 0, "7").otherwise(F.concat(F.lit('["'), F.upper("lang"), F.lit(' ", "'), F.col("source"), F.lit('", ""]')))
    loose = F.concat(
        F.lit("{"),
        F.concat_ws(
            ", ", member(name(2, F.lit("source_path"), F.lit("source")), F.when(F.col("doc_id") % 5 == 0, '" "').otherwise(path)), member(name(3, F.lit("source_file"), F.lit("file_path")), path),
            member(F.lit("rel_path"), path), F.lit('"file_name": "f.md", "doc_type": "md", "title": null'), member(name(4, F.lit("doc_hash"), F.lit("file_hash")), F.concat(F.lit('"h'), "doc_id", F.lit('"'))),
            member(F.lit("chunk_index"), index_), member(F.lit("tags"), tags),
        ), F.lit("}"),
    )
    m = d.select("doc_id", contracts.metadata(loose).alias("m"))
    return m.select("doc_id", F.nullif(F.col("m.source"), F.lit("")).alias("source"), "m.file_path", "m.file_hash", F.coalesce("m.chunk_index", F.lit(-9)).alias("chunk_index"), F.array_join("m.tags", ",").alias("tags"), "m.error")


@query(r"""WITH w AS (SELECT conv_id, turn, turn % 6 AS kind, lower(regexp_extract(text, '[A-Za-z]{2,30}')) AS word, role FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 3 THEN 'tags must be a list of texts' WHEN 4 THEN 'a JSON object is needed' WHEN 1 THEN 'unknown member extra' END AS error,
  CASE WHEN kind IN (0, 1, 5) THEN array_to_string(list_filter(CASE WHEN word = role THEN [word] ELSE [word, role] END, lambda x: x <> ''), ',') WHEN kind = 2 THEN '' END AS tags,
  CASE kind WHEN 2 THEN 'tags' WHEN 4 THEN '' ELSE '' END AS missing, CASE WHEN kind = 1 THEN 'extra' ELSE '' END AS unknown, CASE WHEN kind = 3 THEN 'tags' ELSE '' END AS mistyped FROM w""")
def decode_replies(spark, sf_dir):
    """A tag extractor's reply a turn, some with another member, without tags, with one that is no list, or no object: what strict decoding says, and the tags that tolerant decoding gives."""
    c = table(spark, sf_dir, "conversations").withColumn("word", F.regexp_extract("text", "[A-Za-z]{2,30}", 0))
    good = F.concat(F.lit('"tags": [" '), "word", F.lit('", "'), "role", F.lit('", "'), F.upper("role"), F.lit('"]'))
    kind = F.col("turn") % 6
    reply = (
        F.when(kind == 1, F.concat(F.lit(' {"extra": {"x": [1]}, '), good, F.lit("}"))).when(kind == 2, F.lit('{"tags": null}')).when(kind == 3, F.concat(F.lit('{"tags": "'), "word", F.lit('"}')))
        .when(kind == 4, F.concat(F.lit("["), F.lit('"'), "word", F.lit('"]'))).when(kind == 5, F.concat(F.lit("{"), F.replace(good, F.lit('"tags"'), F.lit('"Tags"')), F.lit("}\n"))).otherwise(F.concat(F.lit("{"), good, F.lit("}")))
    )
    d = c.select("conv_id", "turn", replies.decoded(reply, {"tags": "array<string>"}, strict=True).alias("d"), F.array_join(replies.tags(reply), ",").alias("tags"))
    return d.select("conv_id", "turn", "d.error", "tags", *[F.array_join(f"d.{k}", ",").alias(k) for k in ("missing", "unknown", "mistyped")])


# Sinks


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (ORDER BY {BY}) AS rank FROM hits)
SELECT rank || chr(9) || format('{{:.6f}}', score) || chr(9) || rel_path || chr(9) || array_to_string(tags, ',') || chr(9) || chunk_id AS line FROM r WHERE rank <= 20""")
def result_tsv(spark, sf_dir):
    best = search.top(hits_of(spark, sf_dir), 20)
    return best.select(tx.tsv_line([F.col("rank"), F.format_string("%.6f", "score"), F.col("rel_path"), F.array_join("tags", ","), F.col("chunk_id")]).alias("line"))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (ORDER BY {BY})::INT AS rank FROM hits)
SELECT to_json({{'rank': rank, 'score': round(score, 6), 'rel_path': rel_path, 'tags': tags, 'chunk_id': chunk_id}})::VARCHAR AS json FROM r WHERE rank <= 20""")
def result_json(spark, sf_dir):
    """One JSON object per result; ``Answer.json`` makes the whole envelope."""
    best = search.top(hits_of(spark, sf_dir), 20)
    return best.select(F.to_json(F.struct("rank", F.round("score", 6).alias("score"), "rel_path", "tags", "chunk_id")).alias("json"))
