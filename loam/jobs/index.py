"""The index: scanned files of any number of collections as Parquet tables that grow by layers, and a manifest that says what is current.

Layout of a store: ``layers/<id>/{chunks,states,postings,replaced}``, the first three partitioned by collection, ``outcomes/<id>``, and ``manifest-<n>.json``, of which the
highest number is current. A scan writes what it made into one new layer, with the pairs (file, layer) that it replaces or that are gone, then the manifest that names it;
what it did not touch is neither read nor written again. A read takes all layers without the replaced pairs: few rows, whose number the manifest knows, so they go to every task and
no chunk is shuffled; a scan that leaves more than ``most_replaced`` of them makes the store one layer again. Chunks and states lie in the order of their paths, so a path
prefix reads the row groups that hold it; ``postings`` has the tags of files in order, so a rare tag reads its own. ``vacuum`` deletes what no manifest names. All paths go through
Hadoop's file systems.

Manifests appear whole or not at all, and never replace one. A writer that comes second takes over what others have committed to other collections, and
fails if they changed its own or folded the layers it has read.

A file is read once in a scan: what was read is staged with its hash, and plan, chunks, states and outcome come from there. A file that cannot be read or parsed, or whose
vectors have another length than its collection's, is a row with an error and keeps what it had. A scan with another provider, model, splitter or format starts its
collections anew, which only a scan of whole collections may do.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions.hashing import Recipe
from loam.jobs import embedder as em
from loam.operators import contracts, incremental
from loam.sources import providers
from loam.sources.markdown import Splitter

DB_VERSION = "v2"
KEYS = ("collection_id", "rel_path")
STATES = (
    "rel_path string, source string, file_path string, file_name string, doc_type string, file_hash string, recipe_hash string, chunk_ids array<string>, chunk_count int, "
    "last_indexed_at timestamp, layer long, collection_id string"
)
CHUNKS = (
    "rel_path string, source string, file_path string, file_name string, doc_type string, file_hash string, title string, tags array<string>, yaml string, chunk_index int, "
    "title_path array<string>, content string, recipe_hash string, section_fingerprint string, chunk_id string, created_at timestamp, vector array<float>, "
    "semantic_tags array<string>, tag_vector array<float>, layer long, collection_id string"
)
POSTINGS = "tag string, rel_path string, layer long, collection_id string"
REPLACED = "collection_id string, rel_path string, layer long"
#: Rows of replaced pairs that go to every task (about 100 bytes each), and of files that a filter names one by one.
MOST_SHARED, MOST_NAMED = 200_000, 1000
#: Options of these names never reach a file.
CREDENTIAL = re.compile(r"api_?key|secret|token|password", re.I)


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class StateNotFound(LookupError):
    """There is no manifest yet."""


class RebuildRequired(ValueError):
    """The stored collection cannot be read, or was made another way; a scan of the whole collection makes it anew."""


class CollectionNotFound(LookupError):
    pass


class Conflict(RuntimeError):
    """Another writer has changed what this one builds on."""


def normalized_type(file_type: str | None) -> str:
    kind = (file_type or "").strip().lower()
    return "markdown" if kind in ("", "md") else kind


@dataclass(frozen=True)
class Collection:
    """A row of the registry with the settings its files were indexed with; vector_dim 0 means that none is known yet."""

    root: str
    provider: str = "offline"
    model: str = "keyword"
    splitter: str = "markdown"
    file_type: str = "markdown"
    vector_dim: int = 0
    db_version: str = DB_VERSION
    provider_options: dict[str, str] = field(default_factory=dict)
    created_at: str = ""
    updated_at: str = ""
    revision: int = 0  # counts the commits that changed it

    @property
    def collection_id(self) -> str:
        import hashlib

        kind = normalized_type(self.file_type)
        named = self.root if kind == "markdown" else f"{self.root}|file_type={kind}"
        return hashlib.sha256(named.encode()).hexdigest()[:32]

    def rebuild_reasons(self, other: Collection) -> list[str]:
        """Why files indexed with ``self`` are of no use with ``other``."""
        fields = ("provider", "model", "splitter", "vector_dim", "db_version")
        return [f"{f}_changed" for f in fields if getattr(self, f) != getattr(other, f) and not (f == "vector_dim" and 0 in (self.vector_dim, other.vector_dim))]

    def valid(self) -> Collection:
        """Itself, if a query can be asked of it."""
        if lacking := [f for f in ("provider", "model", "db_version") if not getattr(self, f).strip()] + ([] if self.vector_dim > 0 else ["vector_dim"]):
            raise ValueError(f"collection {self.root}: {', '.join(lacking)} missing")
        return self


def scrubbed(options: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in options.items() if not CREDENTIAL.search(k)}


class Store:
    def __init__(self, spark: SparkSession, root: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now

    # Files

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str, pattern: str) -> list[int]:
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        return sorted(int(m.group(1)) for s in fs.listStatus(p) if (m := re.fullmatch(pattern, s.getPath().getName())))

    def manifest(self) -> dict:
        numbers = self._numbers(self.root, r"manifest-(\d+)\.json")
        if not numbers:
            raise StateNotFound(self.root)
        fs, p = self._at(f"{self.root}/manifest-{numbers[-1]:09d}.json")
        stream = fs.open(p)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            found["collections"] = [Collection(**c) for c in found["collections"]]
            if found["version"] != "v1":
                raise ValueError(found["version"])
        except (KeyError, TypeError, ValueError) as e:
            raise RebuildRequired(f"manifest of {self.root} cannot be read: {e}") from e
        finally:
            stream.close()
        return found | {"number": numbers[-1]}

    def _current(self) -> dict:
        try:
            return self.manifest()
        except StateNotFound:
            return {"version": "v1", "layers": [], "collections": [], "number": 0}

    def _create(self, path: str, body: bytes) -> bool:
        """Makes a file whole, unless there is one: by a link on a local disk, an exclusive put on an object store, else a rename that never replaces."""
        fs, to = self._at(path)
        scheme, jvm = fs.getUri().getScheme(), self.spark._jvm
        if scheme in ("s3a", "s3", "gs", "abfs", "abfss"):
            try:
                stream = fs.create(to, False)
                stream.write(body)
                stream.close()
                return True
            except Exception as e:
                if fs.exists(to):
                    return False
                raise e
        fs, aside = self._at(f"{self.root}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(body)
        stream.close()
        try:
            if scheme == "file":
                os.link(aside.toUri().getPath(), to.toUri().getPath())
            else:
                none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                some = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                some[0] = none
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, to, some)
            return True
        except Exception as e:
            if fs.exists(to):
                return False
            raise e
        finally:
            fs.delete(aside, False)

    def _commit(self, base: dict, layers: list[dict], collections: Sequence[Collection], tries: int = 20) -> None:
        """The next manifest after ``base``. If others were first, what is new here is added to theirs, as long as they left alone what it builds on."""
        key = lambda rows: {c.collection_id: c for c in rows}
        old, new = key(base["collections"]), key(collections)
        if len(new) < len(collections):
            raise ValueError("a root and file type occur twice in the registry")
        changed = {i for i in old.keys() | new.keys() if old.get(i) != new.get(i)}
        new = {i: replace(c, revision=old[i].revision + 1 if i in old else 1) if i in changed else c for i, c in new.items()}
        had, has = {x["id"] for x in base["layers"]}, {x["id"] for x in layers}
        at, now = base, layers
        for _ in range(tries):
            rows = [asdict(replace(c, provider_options=scrubbed(c.provider_options))) for c in sorted(new.values(), key=lambda c: (-len(c.root), c.root, c.file_type))]
            body = json.dumps({"version": "v1", "layers": now, "collections": rows}).encode()
            if self._create(f"{self.root}/manifest-{at['number'] + 1:09d}.json", body):
                return
            at = self.manifest()
            theirs, there = key(at["collections"]), {x["id"] for x in at["layers"]}
            if any(theirs.get(i) != old.get(i) for i in changed) or not had <= there or (had - has and (there != had or theirs != old)):
                raise Conflict(f"another writer has changed {self.root}")
            now = [x for x in at["layers"] if x["id"] not in had - has] + [x for x in layers if x["id"] not in had]
            new = {i: c for i, c in theirs.items() if i not in changed} | {i: c for i, c in new.items() if i in changed}
        raise Conflict(f"{self.root} changes too often")

    def _read(self, name: str, schema: str, layers: Sequence[int]) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(f"{self.root}/layers/{n}/{name}") for n in layers])

    # Tables

    def _live(self, name: str, schema: str, only: Sequence[str] | None = None) -> DataFrame:
        """The rows of all layers, of registered collections (or ``only`` these), without the replaced pairs."""
        m = self._current()
        known = {c.collection_id for c in m["collections"]}
        rows = of_collections(self._read(name, schema, [x["id"] for x in m["layers"]]), sorted(known if only is None else known & set(only)))
        n = sum(x["replaced"] for x in m["layers"])
        if n:
            gone = self._read("replaced", REPLACED, [x["id"] for x in m["layers"] if x["replaced"]])
            rows = rows.join(F.broadcast(gone) if n <= MOST_SHARED else gone, [*KEYS, "layer"], "left_anti")
        return rows.select(*names_of(schema))

    def states(self, validate: bool = False, only: Sequence[str] | None = None) -> DataFrame:
        """The current state of every file of a registered collection. With ``validate`` a row that breaks the contract of states fails the job that reads it."""
        rows = self._live("states", STATES, only)
        return contracts.enforced(rows, contracts.state_problems()) if validate else rows

    def chunks(self, validate: bool = False, tags: Sequence[str] = (), prefix: str = "", only: Sequence[str] | None = None) -> DataFrame:
        """The current chunks, with ``tags`` those of files that have them all, under ``prefix``. With ``validate`` as for states."""
        rows = self._live("chunks", CHUNKS, only)
        if prefix:
            rows = rows.where(tx.under(F.col("rel_path"), prefix))
        if wanted := tx.clean_tags(tags):
            found = self.tagged(wanted, prefix, only)
            named = [r[0] for r in found.select("rel_path").distinct().limit(MOST_NAMED + 1).collect()]
            if len(named) <= MOST_NAMED:  # the paths reach the scan
                rows = rows.where(F.col("rel_path").isin(named)) if named else rows.limit(0)
            rows = rows.join(found, list(KEYS), "left_semi")
        return contracts.enforced(rows, contracts.chunk_problems()) if validate else rows

    def tagged(self, tags: Sequence[str], prefix: str = "", only: Sequence[str] | None = None) -> DataFrame:
        """The files that have all of some normalised tags, from the postings."""
        rows = self._live("postings", POSTINGS, only).where(F.col("tag").isin(list(tags)))
        if prefix:
            rows = rows.where(tx.under(F.col("rel_path"), prefix))
        return rows.groupBy(*KEYS).agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(tags))).select(*KEYS)

    def collections(self) -> list[Collection]:
        """The registry, longest root first."""
        return self._current()["collections"]

    # Registry

    def register(self, collection: Collection) -> None:
        m = self._current()
        self._commit(m, m["layers"], [c for c in m["collections"] if c.collection_id != collection.collection_id] + [collection])

    def remove(self, collection_id: str) -> Collection:
        m = self._current()
        gone = [c for c in m["collections"] if c.collection_id == collection_id.strip()]
        if not gone:
            raise CollectionNotFound(collection_id)
        self._commit(m, m["layers"], [c for c in m["collections"] if c not in gone])
        return gone[0]

    # Upkeep

    def compact(self) -> None:
        """What is current as one layer, unless another writer comes between."""
        m, n = self.manifest(), new_layer()
        for name, rows in (("chunks", self.chunks()), ("states", self.states()), ("postings", self._live("postings", POSTINGS))):
            self._write(rows.withColumn("layer", F.lit(n)), n, name)
        self._commit(m, [{"id": n, "replaced": 0}], m["collections"])

    def _write(self, rows: DataFrame, layer: int, name: str) -> None:
        """A table of a layer in the order in which it is searched."""
        first = "tag" if name == "postings" else "rel_path"
        order = ["collection_id", first, *(["chunk_index"] if name == "chunks" else [])]
        ordered = rows.repartitionByRange("collection_id", first).sortWithinPartitions(*order)
        ordered.write.partitionBy("collection_id").parquet(f"{self.root}/layers/{layer}/{name}")

    def vacuum(self) -> list[int]:
        """Deletes layers that the current manifest does not name, outcomes of scans before the last, what batches of queries have left, and older manifests; readers of those fail."""
        m = self.manifest()
        named = [x["id"] for x in m["layers"]]
        gone = [n for n in self._numbers(f"{self.root}/layers", r"(\d+)") if n not in named]
        told = [n for n in self._numbers(f"{self.root}/outcomes", r"(\d+)") if n not in named[-1:]]
        fs, p = self._at(f"{self.root}/staging")
        asked = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("queries-")] if fs.exists(p) else []
        for path in [*asked, *(f"{self.root}/layers/{n}" for n in gone), *(f"{self.root}/outcomes/{n}" for n in told), *(f"{self.root}/manifest-{k:09d}.json" for k in range(1, m["number"]))]:
            self._delete(path)
        return gone

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def new_layer() -> int:
    """A number that no other writer takes."""
    return uuid.uuid4().int >> 66


def of_collections(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows of some collections: few are named, so that other folders are passed over; more are a small table, a row a collection."""
    if len(ids) <= 50:
        return rows.where(F.col("collection_id").isin(list(ids)))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in ids], "collection_id string")), "collection_id", "left_semi")


def scan(
    store: Store, files: DataFrame, recipe: Recipe, collections: Sequence[Collection], splitter: Splitter | str = Splitter(), tag_extractor: str | None = None,
    extractor_options: dict | None = None, reconcile: bool = True, force: bool = False, most_layers: int = 20, most_replaced: int = MOST_SHARED,
    provider_options: dict | None = None, progress: Callable[[str, dict[str, int]], None] | None = None, **embedder_options,
) -> DataFrame:
    """Brings ``store`` up to ``files(collection_id, rel_path, content, file_hash)``, with a column ``error`` if some could not be read.

    Returns (collection_id, rel_path, status, error) of each file: skipped, updated, deleted or error. ``collections`` are those the files belong to;
    with ``reconcile`` the files are all they have, so others are gone. The recipe's type names the provider that makes chunks (``provider_options`` are its own, such as the
    captions of images), ``splitter`` may be a registered name. ``tag_extractor`` names one of ``embedder.extractors`` and belongs to the recipe; the tags of the
    front matter are taken as they are where a file has any. ``progress`` is told the counts of each step, which its write observes: ``read``
    (files, unreadable, to_update), ``made`` (chunks, errors), ``done`` (those of ``incremental.summary``).
    """
    spark, m, n = store.spark, store._current(), new_layer()
    told = progress or (lambda step, counts: None)
    provider = providers.providers.get(normalized_type(recipe.type))
    if isinstance(splitter, str):
        splitter = providers.splitters.make(splitter)
    if tag_extractor is not None and recipe.tag_extractor is None:
        recipe = replace(recipe, tag_extractor={"name": tag_extractor, **{k: v for k, v in sorted((extractor_options or {}).items())}})
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    stored = {c.collection_id: c for c in m["collections"]}
    wanted = {c.collection_id: c for c in collections}
    rebuilt = [i for i, c in wanted.items() if i in stored and stored[i].rebuild_reasons(c)]
    if rebuilt and not reconcile:
        raise RebuildRequired({stored[i].root: stored[i].rebuild_reasons(wanted[i]) for i in rebuilt})
    before = store.states(only=list(wanted))
    prior = of_collections(before, [i for i in wanted if i not in rebuilt])
    at, aside = f"{store.root}/layers/{n}", f"{store.root}/staging/{n}"

    def written(rows: DataFrame, path: str, counts: dict[str, Column]) -> dict[str, int]:
        seen = Observation()
        rows.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
        return {k: seen.get.get(k) or 0 for k in counts}

    try:
        # read once: content only of what is to be made anew
        seen = incremental.marked(files.select(*KEYS, "content", "file_hash", "error"), prior, recipe.hash(), force, KEYS, ["layer"])
        seen = seen.withColumn("action", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("action")))
        seen = seen.withColumn("content", F.when(F.col("action") == "update", F.col("content")))
        told("read", written(seen, f"{aside}/files", {"files": F.count("*"), "unreadable": F.count_if(F.col("action") == "error"), "to_update": F.count_if(F.col("action") == "update")}))
        staged = spark.read.parquet(f"{aside}/files")
        todo = staged.where("action = 'update'")
        made = provider.chunks(todo.select(*KEYS, "content", "file_hash"), splitter, recipe.hash(), ("collection_id",), **(provider_options or {}))
        made = em.with_vectors(made, recipe.model, provider.embeds, **embedder_options)
        if tag_extractor is not None:
            made.write.parquet(f"{aside}/parsed")  # tags are made of it in several steps, each of which would parse and embed again
            made = spark.read.parquet(f"{aside}/parsed")
            made = em.with_tag_vectors(made, KEYS, recipe.model, tag_extractor, extractor_options=extractor_options, **embedder_options)
        else:
            made = made.withColumns({"semantic_tags": F.lit(None).cast("array<string>"), "tag_vector": F.lit(None).cast("array<float>")})
        told("made", written(made, f"{aside}/made", {"chunks": F.count_if(F.col("chunk_id").isNotNull()), "errors": F.count_if(F.col("error").isNotNull())}))  # parsed and embedded once
        made = spark.read.parquet(f"{aside}/made")
        good = made.where("error is null")
        dims = {c: (stored[c].vector_dim if c in stored and c not in rebuilt else 0) or wanted[c].vector_dim for c in wanted}
        for c, d in good.where("chunk_id is not null").groupBy("collection_id").agg(F.min_by(F.size("vector"), F.struct("rel_path", "chunk_index"))).collect():  # a row a collection
            dims[c] = dims[c] or d
        lengths = F.broadcast(spark.createDataFrame(list(dims.items()), "collection_id string, expected int"))  # a row a collection
        other = good.join(lengths, "collection_id").where(F.size("vector") != F.col("expected")).groupBy(*KEYS).agg(
            F.concat(F.lit("vector dimension mismatch: expected="), F.first("expected"), F.lit(" actual="), F.min(F.size("vector"))).alias("error")
        )
        made.where("error is not null").select(*KEYS, "error").distinct().union(other).write.parquet(f"{aside}/failed")  # few rows, which all that follows asks for
        failed = spark.read.parquet(f"{aside}/failed")
        fine = good.join(failed.select(*KEYS), list(KEYS), "left_anti")
        now = F.lit(store.now()).cast("timestamp")
        about = {
            "source": F.col("rel_path"), "file_path": F.col("rel_path"), "file_name": F.element_at(F.split("rel_path", "/"), -1), "doc_type": F.lit(recipe.type), "layer": F.lit(n),
        }
        body = fine.drop("error").withColumns(about | {"created_at": now}).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        touched = todo.join(failed.select(*KEYS), list(KEYS), "left_anti").select(*KEYS, "file_hash", F.col("layer").alias("old_layer"))
        ids = fine.groupBy(*KEYS).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
        new = touched.join(ids, list(KEYS), "left").withColumns(
            about | {"recipe_hash": F.lit(recipe.hash()), "chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>")), "last_indexed_at": now}
        ).withColumn("chunk_count", F.size("chunk_ids"))
        store._write(body.select(*names_of(CHUNKS)), n, "chunks")
        store._write(contracts.enforced(new, contracts.state_problems()).select(*names_of(STATES)), n, "states")
        store._write(body.select(F.explode(F.array_distinct(tx.normalize_tags(F.col("tags")))).alias("tag"), "rel_path", "layer", "collection_id").distinct(), n, "postings")
        # a rebuilt collection keeps nothing of what it had; another one loses the files that are gone
        gone = incremental.deleted(prior, staged, KEYS) if reconcile else prior.limit(0)
        lost = of_collections(before, rebuilt)
        over = touched.where("old_layer is not null").select(*KEYS, F.col("old_layer").alias("layer")).union(gone.select(*KEYS, "layer")).union(lost.select(*KEYS, "layer"))
        replaced = written(over.select(*names_of(REPLACED)), f"{at}/replaced", {"n": F.count("*")})["n"]
        nothing = F.lit(None).cast("string").alias("error")
        outcome = staged.where("action = 'skip'").select(*KEYS, F.lit("skipped").alias("status"), nothing).union(touched.select(*KEYS, F.lit("updated"), nothing)).union(
            failed.unionByName(staged.where("action = 'error'").select(*KEYS, "error")).select(*KEYS, F.lit("error"), "error")
        ).union(gone.select(*KEYS, F.lit("deleted"), nothing))
        count = lambda *s: F.count_if(F.col("status").isin(*s))
        counts = written(outcome, f"{store.root}/outcomes/{n}", {"processed": count("skipped", "updated"), "skipped": count("skipped"), "updated": count("updated"), "deleted": count("deleted"), "errors": count("error")})
        told("done", counts)
        moment = store.now().isoformat()
        entries = [
            replace(c, vector_dim=dims[i], created_at=stored[i].created_at if i in stored and i not in rebuilt else moment, updated_at=moment, revision=stored[i].revision if i in stored else 0)
            for i, c in wanted.items()
        ]
        kept = [c for c in m["collections"] if c.collection_id not in wanted]
        if counts["updated"] or replaced or any(i not in stored for i in wanted):
            store._commit(m, [*m["layers"], {"id": n, "replaced": replaced}], [*kept, *entries])
            total = store._current()["layers"]
            if len(total) > most_layers or sum(x["replaced"] for x in total) > most_replaced:
                store.compact()
        else:
            store._delete(at)
    finally:
        store._delete(aside)
    return spark.read.schema("collection_id string, rel_path string, status string, error string").parquet(f"{store.root}/outcomes/{n}")
