"""The store: reads of files, layers, writers that meet, postings, providers, and batches of queries."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import hashing as hx
from loam.jobs import embedder, index
from loam.jobs import query as ask
from loam.jobs.index import Collection, Store
from loam.operators import contracts, diversify, search
from loam.sources import listing
from test_index import HOME, RECIPE, files, names, scan


def counting(spark, rows: list[tuple[str, str]], changing: bool = False):
    """Files whose contents a task makes when they are read, counted; with ``changing`` every read gives other bytes."""
    reads = spark.sparkContext.accumulator(0)

    def of(frames):
        for pdf in frames:
            reads.add(len(pdf))
            if changing:
                pdf = pdf.assign(content=[f"{c} {os.urandom(8).hex()}" for c in pdf["content"]])
            yield pdf.assign(file_hash=[hashlib.sha256(c.encode()).hexdigest() for c in pdf["content"]])

    made = spark.createDataFrame([(HOME.collection_id, f"{HOME.root}/{k}", v) for k, v in rows], "collection_id string, rel_path string, content string").repartition(2)
    return made.mapInPandas(of, "collection_id string, rel_path string, content string, file_hash string"), reads


def test_every_file_is_read_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for rows in ([("a", "go"), ("b", "yaml"), ("c", "x")], [("a", "go go"), ("b", "yaml"), ("bad", "---\n- x\n---\n")]):
        found, reads = counting(spark, rows)
        scan(store, found)
        assert reads.value == 3
    assert names(store.chunks()) == ["a", "b"]
    assert not (tmp_path / "store" / "staging").exists() or not list((tmp_path / "store" / "staging").iterdir())
    assert not list((tmp_path / "store" / "layers").glob("*/made"))


def test_hash_and_chunks_agree_when_a_file_changes_meanwhile(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    found, reads = counting(spark, [("a", "go"), ("b", "yaml")], changing=True)
    scan(store, found, tag_extractor="frequent")
    assert reads.value == 2
    rows = store.chunks().join(store.states().select(*index.KEYS, F.col("file_hash").alias("state_hash")), list(index.KEYS)).collect()
    assert len(rows) == 2
    for r in rows:
        assert r["file_hash"] == r["state_hash"] == hashlib.sha256(r["content"].encode()).hexdigest()


def test_progress_is_observed(spark, tmp_path):
    store, told = Store(spark, str(tmp_path / "store")), {}
    scan(store, files(spark, a="go", b="yaml", gone="x"))
    scan(store, files(spark, a="go", b="new", bad="---\n- x\n---\n", lost=None), progress=told.__setitem__)
    assert told["read"] == {"files": 4, "unreadable": 1, "to_update": 2} and told["made"] == {"chunks": 1, "errors": 1}
    assert told["done"] == {"processed": 2, "skipped": 1, "updated": 1, "deleted": 1, "errors": 2}
    scan(store, files(spark, a="go", b="new"), progress=told.__setitem__)
    assert told["made"] == {"chunks": 0, "errors": 0} and told["done"]["skipped"] == 2


def nodes(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_of_layers_shuffle_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for texts in ({"a": "go", "b": "vector", "c": "yaml"}, {"a": "go go", "b": "vector", "c": "yaml"}, {"a": "go go", "b": "vector vector"}):
        scan(store, files(spark, **texts))
    assert [x["replaced"] for x in store.manifest()["layers"]] == [0, 1, 2]
    best = search.top(search.scored(store.chunks(), [1.0, 0.0, 0.0]), 5).select("rank", "rel_path")
    plan = nodes(best)
    assert "vector" not in "".join(x for x in plan.split("\n") if "Exchange" in x and "Broadcast" not in x)
    assert "SortMergeJoin" not in nodes(store.chunks()) and "Exchange hash" not in nodes(store.chunks())
    assert names(store.chunks()) == ["a", "b"] and names(store.states(validate=True)) == ["a", "b"]
    # more pairs than are shared fold the layers
    scan(store, files(spark, a="go", b="go"), most_replaced=2)
    assert [x["replaced"] for x in store.manifest()["layers"]] == [0] and names(store.chunks()) == ["a", "b"]


def test_removed_and_rebuilt_collections(spark, tmp_path):
    store, far = Store(spark, str(tmp_path / "store")), Collection("/far")
    scan(store, files(spark, a="go").union(files(spark, far, z="yaml")), collections=(HOME, far))
    store.remove(far.collection_id)
    assert names(store.chunks()) == ["a"] and names(store.states()) == ["a"]
    many = [Collection(f"/c{k}") for k in range(60)]
    for_all = files(spark, a="go")
    for c in many[:3]:
        for_all = for_all.union(files(spark, c, k="vector"))
    scan(store, for_all, collections=(HOME, *many))
    assert names(store.chunks()) == ["a", "k"] and store.chunks().count() == 4


def test_writers_that_meet(spark, tmp_path):
    """While a scan has not committed, another one does: to another collection both land, to the same one only the first."""
    far = Collection("/far")

    def during(store, first, then):
        commit, done = store._commit, []

        def hook(*args):
            if not done:
                done.append(1)
                then()
            commit(*args)

        store._commit = hook
        try:
            first()
        finally:
            store._commit = commit

    a, b = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    during(a, lambda: scan(a, files(spark, x="go")), lambda: scan(b, files(spark, far, y="yaml"), collections=(far,)))
    assert names(a.chunks()) == ["x", "y"] and {c.root for c in a.collections()} == {"/home/docs", "/far"} and len(a.manifest()["layers"]) == 2
    with pytest.raises(index.Conflict):
        during(a, lambda: scan(a, files(spark, x="go go")), lambda: scan(b, files(spark, x="yaml")))
    assert {r["content"] for r in a.chunks().where("rel_path like '%x'").collect()} == {"yaml"}
    with pytest.raises(index.Conflict):  # layers that were read are folded meanwhile
        during(a, lambda: scan(a, files(spark, x="go go")), b.compact)
    with pytest.raises(index.Conflict):  # and none is folded that another scan has built upon
        during(a, a.compact, lambda: scan(b, files(spark, far, y="new"), collections=(far,)))
    assert sorted(r["content"] for r in a.chunks().collect()) == ["new", "yaml"]
    during(a, lambda: a.register(Collection("/third")), lambda: b.register(Collection("/fourth")))
    assert {"/third", "/fourth"} <= {c.root for c in a.collections()}


def read_by(df, name: str) -> int:
    """What the scans of a plan have counted."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if kind == "FileSourceScanExec" and "chunk_index" in p.simpleString(1000):
            total += p.metrics().apply(name).value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_filters_read_what_they_need(spark, tmp_path):
    """Rows read stay those of a few row groups when the store grows."""
    spark.conf.set("parquet.block.size", str(4096))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = {}
        for n in (400, 1600):
            store = Store(spark, str(tmp_path / f"store{n}"))
            rows = [(HOME.collection_id, f"{HOME.root}/{k // 10:04d}/{k:05d}", f"---\ntags: [{'rare' if k == 77 else 'often'}, t{k % 2}]\n---\n\ngo {k} " + hashlib.sha256(str(k).encode()).hexdigest() * 3) for k in range(n)]
            found = spark.createDataFrame(rows, "collection_id string, rel_path string, content string").withColumn("file_hash", F.sha2("content", 256))
            scan(store, found)
            prefix, rare = store.chunks(prefix=f"{HOME.root}/0007"), store.chunks(tags=["rare", "T1 "])
            assert prefix.count() == 10 and [r["rel_path"] for r in rare.collect()] == [f"{HOME.root}/0007/00077"]
            assert store.chunks(tags=["t0", "often"]).count() == n // 2 and store.chunks(tags=["t0", "rare"]).count() == 0 and store.chunks(tags=["no"]).count() == 0
            got[n] = read_by(prefix, "numOutputRows"), read_by(rare, "numOutputRows"), read_by(store.chunks(), "numOutputRows")
        assert got[400][2] == 400 and got[1600][2] == 1600
        assert got[1600][0] <= 300 and got[1600][1] <= 300, got
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tags_follow_the_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    tagged = lambda t: f"---\ntags: [{t}]\n---\n\ngo"
    scan(store, files(spark, a=tagged("one, two"), b=tagged("two")))
    scan(store, files(spark, a=tagged("three"), b=tagged("two")))
    assert names(store.tagged(["one"])) == [] and names(store.tagged(["two"])) == ["b"] and names(store.tagged(["three"])) == ["a"]
    store.compact()
    assert names(store.tagged(["three"])) == ["a"] and names(store.chunks(tags=[" Two"])) == ["b"]


def test_an_extractor_belongs_to_the_recipe(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    two = files(spark, a="go yaml", b="vector")
    assert scan(store, two) == {"a": "updated", "b": "updated"}
    assert scan(store, two, tag_extractor="vocabulary") == {"a": "updated", "b": "updated"}
    assert {tuple(r["semantic_tags"]) for r in store.chunks().collect()} == {("go", "yaml"), ("vector",)}
    assert scan(store, two, tag_extractor="vocabulary") == {"a": "skipped", "b": "skipped"}
    assert scan(store, two, tag_extractor="vocabulary", extractor_options={"words": ("go",)}) == {"a": "updated", "b": "updated"}


def test_images_are_scanned_through_their_provider(spark, tmp_path):
    store, pictures = Store(spark, str(tmp_path / "store")), Collection("/home/docs", file_type="image")
    said = spark.createDataFrame([("/home/docs/cat.png", "Go cat", ["B ", "a"], "on a vector"), ("/home/docs/dog.png", " ", None, "yaml")], "rel_path string, title string, tags array<string>, description string")
    found = files(spark, pictures, **{"cat.png": "1", "dog.png": "2", "none.png": "3"})
    recipe = hx.Recipe("image", "v1", "offline", "keyword", 3)
    how = {"collections": (pictures,), "provider_options": {"captions": said}, "splitter": "markdown"}
    assert scan(store, found, recipe, **how) == {"cat.png": "updated", "dog.png": "updated", "none.png": "error"}
    got = {r["rel_path"]: r for r in store.chunks(validate=True).collect()}
    assert list(got["/home/docs/cat.png"]["vector"]) == [1, 1, 0] and got["/home/docs/cat.png"]["tags"] == ["a", "b"] and got["/home/docs/dog.png"]["title"] == "dog"
    assert names(ask.ask(store, "vector", file_type="image", root_exists=lambda _: True).results) == ["cat.png"]
    with pytest.raises(ValueError, match="captions"):
        scan(store, found, recipe, collections=(pictures,), force=True)
    with pytest.raises(KeyError):
        scan(store, found, hx.Recipe("movie", "v1", "offline", "keyword", 3))


def test_a_failing_extractor_leaves_the_content(spark, tmp_path):
    def breaks(**_):
        def extract(texts):
            raise RuntimeError("no model")

        return extract

    embedder.extractors.register("breaks", breaks)
    store = Store(spark, str(tmp_path / "store"))
    scan(store, files(spark, a="go vector"), tag_extractor="vocabulary")
    found = ask.ask(store, "go vector", root_exists=lambda _: True, tag_extractor="breaks")
    assert not found.fused and names(found.results) == ["a"]
    asked = spark.createDataFrame([("q", "go vector")], "query_id string, text string")
    assert names(ask.ask_many(store, asked, root_exists=lambda _: True, tag_extractor="breaks")) == ["a"]
    embedder.extractors.register("loud", lambda: lambda texts: [[" GO ", "go", "12", "!!", "yaml "] for _ in texts])
    assert ask.ask(store, "go vector", root_exists=lambda _: True, tag_extractor="loud").query_tags == ["go", "yaml"]


def test_many_queries_are_answered_as_each_one_is(spark, tmp_path):
    store, far, deep = Store(spark, str(tmp_path / "store")), Collection("/far"), Collection("/home/docs/deep")
    tags = lambda t, body: f"---\ntags: [{t}]\n---\n\n{body}"
    body = ["go go vector", "yaml go", "vector", "yaml", "go vector yaml", "nothing", "go", "go"]
    found = files(spark, **{f"f{k}": tags("x" if k % 2 else "x, y", t) for k, t in enumerate(body)}).union(files(spark, far, **{f"g{k}": tags("y", t) for k, t in enumerate(body[:5])}))
    found = found.union(files(spark, deep, **{f"h{k}": t for k, t in enumerate(body[:3])}))
    scan(store, found, collections=(HOME, far, deep), tag_extractor="vocabulary")
    asked = [
        ("a", "go vector", None, None), ("b", "yaml please", "/home/docs", []), ("c", "vector go", "/far", ["y"]), ("d", "go go", "", [" X", "y"]), ("e", "none", "/home", None), ("f", "go yaml", "/home/docs/deep/h1", None),
        ("g", "vector vector yaml", None, ["q"]), ("h", "go", "/nowhere", None), ("i", " ", None, None), ("j", None, None, None), ("k", "go yaml", "/home/docs/f1", None),
    ]
    queries = spark.createDataFrame([(*r, 0.5) for r in asked], "query_id string, text string, path string, tags array<string>, score double")
    for o in (search.Options(limit=4, window=6, alpha=-1, delta=-1), search.Options(limit=3, alpha=0.5, delta=0.4, unique_files=False), search.Options(limit=4, mmr=True, alpha=-1, delta=-1), search.Options(limit=4, rerank="bm25", alpha=-1, delta=-1)):
        got: dict[str, list] = {}
        for r in ask.ask_many(store, queries, o, tag_extractor="vocabulary", root_exists=lambda _: True, most_queries=4).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["rel_path"], r["collection_id"], round(r["score"], 9), round(r["content_score"], 9), r["tag_score"] and round(r["tag_score"], 9)))
        for name, text, path, tag in asked:
            try:
                one = ask.ask(store, text or "", path or "", tag or (), o, tag_extractor="vocabulary", root_exists=lambda _: True)
                want = [(r["rank"], r["rel_path"], r["collection_id"], round(r["score"], 9), round(r["content_score"], 9), r["tag_score"] and round(r["tag_score"], 9)) for r in one.results.collect()]
            except (ask.NotIndexed, ValueError):
                want = []
            assert sorted(got.get(name, [])) == sorted(want), (name, o)
    with pytest.raises(ValueError, match="dimensions"):
        ask.ask_many(store, queries, root_exists=lambda _: True, words=("one",)).count()
    assert ask.ask_many(store, queries.limit(0), root_exists=lambda _: True).count() == 0


def test_many_queries_rank_texts_of_one_direction_by_path(spark, tmp_path):
    """Their scores differ in the last bits, which depend on the lengths; to nine decimals they are one."""
    store = Store(spark, str(tmp_path / "store"))
    scan(store, files(spark, **{f"f{k:02d}": "go go vector vector vector yaml " * (1 + 7 * k % 40) for k in range(40)}))
    queries = spark.createDataFrame([("a", "go vector"), ("b", "yaml go go"), ("c", "go go vector vector vector yaml")], "query_id string, text string")
    for o in (search.Options(limit=40, window=40), search.Options(limit=12, window=12)):
        got = ask.ask_many(store, queries, o, root_exists=lambda _: True).collect()
        for q in "abc":
            assert [r["rel_path"][-3:] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [f"f{k:02d}" for k in range(o.limit)]


def test_masked_topk_keeps_what_single_precision_cannot_tell_apart(spark):
    """Against plain sums: near and equal vectors, tags, prefixes, tag vectors of some, in blocks of few rows."""
    rng = np.random.RandomState(3)
    base = rng.standard_normal((6, 5))
    rows = []
    for k in range(400):
        v = base[k % 6] * (1 + k % 4) + (0 if k % 3 else 1e-6 * rng.standard_normal(5))
        t = None if k % 5 == 0 else rng.standard_normal((3, 2))[k % 3].round(1).tolist()
        rows.append((f"c{k % 2}", f"p{k % 3}/{k:03d}", 0, f"{k:04d}", ["t"] if k % 4 else ["t", "u"], None if k % 50 == 7 else v.tolist(), t))
    chunks = spark.createDataFrame(rows, "collection_id string, rel_path string, chunk_index int, chunk_id string, tags array<string>, vector array<double>, tag_vector array<double>").repartition(3)
    n = 12
    q, tq, fused = base[rng.randint(6, size=n)] + 1e-7 * rng.standard_normal((n, 5)), rng.standard_normal((n, 2)), np.arange(n) % 2 == 0
    scopes, path, wanted = np.arange(n)[:, None] % 3 != np.array([[1, 2]]), np.where(np.arange(n) % 4 == 0, 0, 1), (np.arange(n) % 5 == 0)[:, None]
    asked = search.Asked(q, tq * fused[:, None], fused, scopes, ["c0", "c1"], ["p1"], path, ["u"], wanted)
    got: dict[tuple, list] = {}
    for r in search.top(search.masked_topk(chunks, asked, 7, 0.4, block_bytes=8 * n * 30), 7, "query", "collection_id", score="level").collect():
        got.setdefault((r["query"], r["collection_id"]), []).append((r["rank"], r["chunk_id"], round(r["score"], 12)))
    cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300))
    for i in range(n):
        for c in (0, 1):
            own = []
            for collection, rel_path, _, chunk_id, tags, v, t in rows:
                if collection == f"c{c}" and scopes[i, c] and (path[i] or rel_path.startswith("p1/")) and (not wanted[i, 0] or "u" in tags):
                    score = 0.0 if v is None else cos(q[i], v)
                    own.append((0.6 * score + 0.4 * cos(tq[i], t) if fused[i] and t is not None else score, rel_path, chunk_id))
            own.sort(key=lambda x: (-round(x[0], 9), x[1]))
            assert sorted(got.get((i, f"c{c}"), [])) == [(k, x[2], round(x[0], 12)) for k, x in enumerate(own[:7], 1)], (i, c)


def test_masked_topk_keeps_ties_in_order(spark):
    """Many equal scores, small blocks and several tasks: the first by path, number and id stay."""
    rows = [(f"c{k % 2}", f"p{k % 7}", k % 3, f"{k:04d}", ["t"], [1.0, float(k % 2 == 0)], None) for k in range(500)]
    chunks = spark.createDataFrame(rows, "collection_id string, rel_path string, chunk_index int, chunk_id string, tags array<string>, vector array<double>, tag_vector array<double>").repartition(5)
    asked = search.Asked(np.eye(2), np.zeros((2, 2)), np.zeros(2, bool), np.array([[True, True], [False, True]]), ["c0", "c1"], [], np.zeros(2, int), [], np.zeros((2, 0), bool))
    found = search.masked_topk(chunks, asked, 3, 0.3, block_bytes=2000)
    got = sorted((r["query"], r["collection_id"], r["rank"], r["rel_path"], r["chunk_index"], r["chunk_id"]) for r in search.top(found, 3, "query", "collection_id").collect())
    want = []
    for q, unit in enumerate(((1, 0), (0, 1))):
        for c in ("c0", "c1") if q == 0 else ("c1",):
            own = sorted((-(r[5][0] * unit[0] + r[5][1] * unit[1]) / np.hypot(*r[5]), r[1], r[2], r[3]) for r in rows if r[0] == c)
            want += [(q, c, n, *x[1:]) for n, x in enumerate(own[:3], 1)]
    assert got == sorted(want)


def test_batch_topk_takes_string_ids(spark):
    rng = np.random.RandomState(2)
    rows = [(f"é{k:03d}" if k % 2 else f"{k:03d}", rng.standard_normal(4).tolist()) for k in range(60)] + [("same", [0.0] * 4), ("also", [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id string, vector array<double>")
    got = search.batch_topk(df, df.where("vec_id < '1'").select(F.col("vec_id").alias("query_id"), "vector"), 3).collect()
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in rows}
    for q in {i for i, _ in rows if i < "1"}:
        want = sorted(((-float(unit[q] @ unit[i]), i.encode()) for i in unit if i != q))[:3]
        assert [(r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i.decode() for _, i in want]


def plain_mmr(relevance, vectors, k, lam):
    unit = [v / np.linalg.norm(v) if np.linalg.norm(v) else v for v in vectors]
    picked = []
    while len(picked) < min(k, len(relevance)):
        value = [relevance[i] if not picked else lam * relevance[i] - (1 - lam) * max(0.0, max(float(unit[j] @ unit[i]) for j in picked)) for i in range(len(relevance))]
        picked.append(max((i for i in range(len(relevance)) if i not in picked), key=lambda i: (value[i], -i)))
    return picked


def test_lazy_mmr_picks_what_a_full_search_picks():
    rng = np.random.RandomState(1)
    for n, k, lam in ((1, 3, 0.5), (30, 10, 0.5), (60, 60, 0.3), (40, 12, 0.9), (25, 25, 1.0), (20, 20, 0.0)):
        x = rng.standard_normal((n, 6))
        x[n // 2 :] = x[: n - n // 2]  # equal candidates
        r = np.sort(rng.uniform(-1, 1, n))[::-1]
        assert diversify.select(r, x, k, lam) == plain_mmr(r, x, k, lam)


def test_mmr_of_many_queries(spark):
    rng = np.random.RandomState(5)
    rows, want = [], {}
    for q in range(4):
        query, x = rng.standard_normal(3), rng.standard_normal((15, 3))
        cos = x @ query / (np.linalg.norm(x, axis=1) * np.linalg.norm(query))
        order = np.argsort(-cos)
        want[q] = [f"{q}-{order[i]}" for i in plain_mmr(cos[order], x[order], 5, 0.4)]
        rows += [(q, f"p{i}", 0, f"{q}-{i}", float(cos[i]), x[i].tolist(), query.tolist(), 7) for i in range(15)]
    df = spark.createDataFrame(rows, "query_id int, rel_path string, chunk_index int, chunk_id string, score double, vector array<double>, query_vector array<double>, rank int").repartition(3)
    got = diversify.mmr_batch(df, "query_id", 5, 0.4).orderBy("query_id", "rank").collect()
    for q, ids in want.items():
        assert [r["chunk_id"] for r in got if r["query_id"] == q] == ids
    assert diversify.mmr_batch(df.limit(0), "query_id", 5, 0.4).count() == 0


def test_states_that_break_their_contract_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    broken = files(spark, a="go").withColumn("file_hash", F.lit(" "))
    with pytest.raises(Exception, match="file_hash_required"):
        scan(store, broken)
    assert store.collections() == [] and contracts.enforced(store.states(), contracts.state_problems()).count() == 0


def test_local_files_end_to_end(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    for k in range(3):
        (tmp_path / "notes" / f"{k}.md").write_text(f"# T{k}\n\ngo {'yaml ' * k}")
    home = Collection(str(tmp_path / "notes"))
    found = listing.contents(listing.files(spark, home.root)).withColumn("collection_id", F.lit(home.collection_id))
    store = Store(spark, str(tmp_path / "store"))
    assert set(scan(store, found, collections=(home,)).values()) == {"updated"}
    assert ask.ask(store, "yaml", home.root).results.first()["rel_path"].endswith("2.md")
