import os

import plain_markdown
import pytest
from pyspark.sql import functions as F

from loam.functions import hashing as hx
from loam.jobs import embedder
from loam.jobs import index
from loam.jobs import query as ask
from loam.jobs.index import Collection, Store
from loam.operators import contracts, incremental, scopes, search
from loam.sources import listing, markdown, providers

RECIPE = hx.Recipe("markdown", "v1", "offline", "keyword", 3)


def test_identities(spark):
    split = hx.splitter_hash(options={"short_file_max_chars": 4000})
    assert split == "f595972fb97fce689b896e1d41637cdc9b52ab743602f33a552fd94a453c55de" == markdown.Splitter().recipe_hash()
    assert hx.splitter_hash() == "42a870a5fcdcca6a62410ddb23c921ddb308236d5a83699abdc2147af38c8be2"
    df = spark.range(1).select(hx.fingerprint(F.array(F.lit("Guide")), F.lit("Guide\n\nbody")).alias("f"))
    df = df.withColumn("id", hx.chunk_id(F.lit("docs/guide.md"), F.lit(split), F.lit(0), F.col("f")))
    assert df.first()["f"] == "cea9f9e772dd16ea860320bf3607f72ff4b168d8ccb0c5a2453a9dcb2a64a841"
    assert df.first()["id"] == "25bab58046cdcbc36d25c0228aacfb28e66abc9ce104de0a237cff8c8e683978"
    ids = spark.range(1).select(hx.collection_id(F.lit("/tmp/docs")), hx.collection_id(F.lit("/tmp/docs"), "image")).first()
    assert tuple(ids) == ("6fdb92d73ed94d13055de07d55229929", "faba04d4bf42ca416e1e7304d448f856")


def test_strip_looks_at_the_ends_only(spark):
    """All white space that Unicode has, as the pattern took it off, and a run within a text that would keep a pattern busy for minutes."""
    import time

    from loam.functions import text as tx

    ends = [chr(n) for n in range(0x3100) if not 0xD800 <= n < 0xE000] + ["", "\ufeff", "\U0001f600", " \u3000\n\u0085"]
    df = spark.createDataFrame([(e + "x" + e,) for e in ends] + [(e,) for e in ends] + [(None,)], "t string")
    assert df.where(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    long = spark.range(1).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 500_000), F.lit("b\n")).alias("t"))
    began = time.time()
    assert long.select(F.length(tx.strip(F.col("t")))).first()[0] == 500_002 and time.time() - began < 20


def made_chunks(spark, texts, splitter=markdown.Splitter()):
    """[(title path, content)] of each text, and its error."""
    df = spark.createDataFrame([(f"{n:04d}", t) for n, t in enumerate(texts)], "rel_path string, content string").repartition(3)
    out = [([], None) for _ in texts]
    for r in markdown.chunks(df, splitter).orderBy("rel_path", "chunk_index").collect():
        n = int(r["rel_path"])
        out[n] = (out[n][0], r["error"]) if r["error"] else (out[n][0] + [(r["title_path"], r["content"])], None)
        assert r["error"] or r["chunk_index"] == len(out[n][0]) - 1
    return out


def test_headings_nest_as_specified(spark):
    some = ["## X\n\na\n\n## Y\n\nb\n\n## Z\n\nc", "# A\n\na\n\n### C\n\nc\n\n### D\n\nd", "# A\n\n# B\n\nb\n\n# C"]
    got = [[t for t, _ in c] for c, _ in made_chunks(spark, some, markdown.Splitter(short_file=1))]
    assert got == [[["X"], ["X", "Y"], ["X", "Z"]], [["A"], ["A", "C"], ["A", "C", "D"]], [["B"], ["C"]]]


def test_blocks():
    text = "para *one*\ntwo\n\n```py\nx = 1\n```\n\n> quoted\n\n- a\n- b\n\n1. c\n2. d\n\n---\n\n| h | i |\n|---|---|\n| j | k |\n\n[l](http://u) ![m](n.png)\n\nTitle\n====\n"
    got = markdown.blocks(text)
    assert got == [
        (0, "para one\ntwo"), (0, "```py\nx = 1\n```"), (0, "> quoted"), (0, "- a\n- b"), (0, "1. c\n2. d"), (0, "---"), (0, "h | i\nj | k"), (0, "l <http://u> m"), (1, "Title"),
    ]


def test_windows_follow_the_rule(spark):
    """Against a loop over characters: white space of all kinds, runs of it longer than a segment, characters beyond the basic plane."""
    import random

    from loam.functions import text as tx

    rng = random.Random(3)
    rows = [("".join(rng.choice("ab \n\u2003" if rng.random() < 0.3 else "abcdef\U0001f600") for _ in range(rng.randint(0, 300))), rng.randint(1, 30)) for _ in range(300)]
    rows += [("x" * 500 + " " * 700 + "y" * 300, 90), ("  ", 10), (None, 10), ("word " * 700, 1200), ("x" * 3000, 1200), ("some text", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int")
    for overlap in (0, 5, 12, 120):
        got = {r["i"]: r["w"] for r in df.select("i", tx.windows(F.col("t"), F.col("n"), overlap, 1200).alias("w")).collect()}
        assert got == {i: plain_markdown.windows(t or "", n, overlap) for i, (t, n) in enumerate(rows)}
    got = markdown.text_windows(df.withColumnRenamed("t", "text"), "i").where("i = 304").orderBy("part").collect()
    assert [r["part"] for r in got] == [0, 1, 2] and got[1]["content"] == "x" * 1200
    assert "Python" not in df.select(tx.windows(F.col("t"), 1200, 120))._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    from loam.functions import text as tx

    df = spark.createDataFrame([(k, " ".join(f"word{i}" for i in range(20_000 * k))) for k in (1, 8)], "k int, t string").cache()
    df.count()
    took = {}
    for k in (1, 1, 8):
        began = time.perf_counter()
        df.where(F.col("k") == k).select(F.size(tx.windows(F.col("t"), 1200, 120))).collect()
        took[k] = time.perf_counter() - began
    assert took[8] < 8 * took[1] + 5


def test_splitter_options():
    assert markdown.Splitter.of({}) == markdown.Splitter() and markdown.Splitter.of({"max_chunk_chars": " 50", "overlap_chars": "5"}) == markdown.Splitter(50, 5)
    for bad in ({"max_chunk_chars": "0"}, {"overlap_chars": "x"}, {"max_chunk_chars": "10", "overlap_chars": "10"}, {"other": "1"}, {"short_file_max_chars": "-1"}):
        with pytest.raises(ValueError):
            markdown.Splitter.of(bad)


def test_splitting_equals_a_plain_reading(spark):
    """Files of headings, paragraphs of all lengths, lists, code and tables: sections, packing and cuts as loops over one file have them."""
    import random

    rng = random.Random(5)
    for splitter in (markdown.Splitter(120, 10, 1), markdown.Splitter(60, 20, 200), markdown.Splitter(160, 0, 1), markdown.Splitter(30, 3, 1)):
        texts, fronts = [], []
        for n in range(60):
            lines = []
            for _ in range(rng.randint(0, 14)):
                words = " ".join(rng.choice(["lorem", "ipsum", "dolor", "a", "consectetur"]) for _ in range(rng.randint(1, 60)))
                kind = rng.random()
                lines.append(
                    f"{'#' * rng.randint(1, 6)} {words.split()[0]}{rng.randint(0, 9)}" if kind < 0.35 else f"- {words}\n- x" if kind < 0.4 else f"```\n  {words}\n```" if kind < 0.45
                    else f"| | i |\n|---|---|\n| {words} | k |" if kind < 0.5 else f"{words}\n===" if kind < 0.53 else words
                )
            front = rng.choice(["", "---\ntitle: Base\n---\n\n", "---\ntags: [b, A]\n---\n"])
            fronts.append(["Base"] if "title" in front else [])
            texts.append(front + rng.choice(["\n\n", "\r\n\r\n"]).join(lines))
        got = made_chunks(spark, texts, splitter)
        for text, base, (chunks, error) in zip(texts, fronts, got, strict=True):
            body = text.split("---\n", 2)[2].lstrip("\r\n") if text.startswith("---") else text
            assert error is None and chunks == plain_markdown.split(body, base, splitter), (splitter, text)


def test_trimmed_and_truncated(spark):
    from loam.functions import text as tx

    got = spark.createDataFrame([([" a ", "", None, "\u3000", "b"], "日本語" * 3000)], "x array<string>, t string").select(tx.trimmed(F.col("x")), F.length(tx.truncated(F.col("t")))).first()
    assert tuple(got) == (["a", "b"], 4000)


def test_ignore_rules_can_escape_marks():
    rules = listing.Ignore(["\\!a.md", "\\#b.md", "!!c.md", "*.txt", "!keep.txt"])
    assert rules.match("!a.md", False) and rules.match("#b.md", False) and rules.match("x.txt", False) and not rules.match("keep.txt", False)


def test_oversize_sections_are_cut(spark):
    text = "# T\n\n" + "\n\n".join(["lorem ipsum " * 60] * 8)
    [(got, _)] = made_chunks(spark, [text])
    assert all(len(c) <= 1200 and c.startswith("T\n\n") for _, c in got) and len(got) > 3


def test_front_matter(spark):
    found = markdown.metadata("title: A\ntags: [on, B, b]\nday: 2024-01-01")
    assert found["day"] == "2024-01-01" and found["tags"] == ["on", "B", "b"] and markdown.title_and_tags(found) == ("A", ["b", "on"])
    for bad in ("tags: [a", "- a"):
        with pytest.raises(ValueError):
            markdown.metadata(bad)
    with pytest.raises(ValueError):
        markdown.title_and_tags({"title": 3})
    got = made_chunks(spark, ["---\r\ntitle: A\ntags: [on, B, b]\n---\r\n\r\nbody", "---\ntags: [a\n---\nx", "", None, "---\n---\n", "plain", "---\ntitle: Only\n---\n"])
    assert got[0] == ([(["A"], "A\n\nbody")], None) and "invalid front matter" in got[1][1] and got[2] == got[3] == ([], None) and got[5] == ([([], "plain")], None) and got[6] == ([(["Only"], "Only")], None)


def test_chunks_run_little_python(spark):
    """Front matter and blocks are read in Python; the rest of the plan has none, and texts are shuffled once."""
    df = spark.createDataFrame([("a", "# A\n\n" + "word " * 2000)], "rel_path string, content string")
    plan = markdown.chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "MapIn" not in plan and plan.count("Exchange") == 1


HOME = Collection("/home/docs")


def files(spark, collection=HOME, **content):
    """Files of texts; None is one that cannot be read."""
    rows = [(collection.collection_id, f"{collection.root}/{k}", v, None if v is not None else "cannot be read") for k, v in content.items()]
    df = spark.createDataFrame(rows, "collection_id string, rel_path string, content string, error string")
    return df.withColumn("file_hash", F.sha2("content", 256))


def scan(store, found, recipe=RECIPE, collections=(HOME,), **how):
    return {r["rel_path"].split("/")[-1]: r["status"] for r in index.scan(store, found, recipe, collections, **how).collect()}


def names(df):
    return sorted({r["rel_path"].split("/")[-1] for r in df.collect()})


def test_scan_is_incremental(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(index.StateNotFound):
        store.manifest()
    assert store.chunks().count() == 0 and store.collections() == []
    two = files(spark, a="# A\n\ngo go yaml", b="vector")
    assert scan(store, two) == {"a": "updated", "b": "updated"}
    assert {tuple(r["vector"]) for r in store.chunks(validate=True).collect()} == {(2, 0, 1), (0, 1, 0)}
    layers = store.manifest()["layers"]
    assert scan(store, two) == {"a": "skipped", "b": "skipped"} and store.manifest()["layers"] == layers
    other = hx.Recipe("markdown", "v2", "offline", "keyword", 3)
    assert scan(store, two, other) == {"a": "updated", "b": "updated"}
    assert scan(store, files(spark, a="changed"), other) == {"a": "updated", "b": "deleted"}
    assert scan(store, files(spark, a="changed", bad="---\ntags: [x\n---\n"), other) == {"a": "skipped", "bad": "error"}
    assert names(store.chunks()) == ["a"] and names(store.states()) == ["a"]
    assert scan(store, files(spark, a="changed"), other, force=True) == {"a": "updated"}
    assert scan(store, files(spark, c="new"), other, reconcile=False) == {"c": "updated"} and names(store.chunks()) == ["a", "c"]


def test_unreadable_files_keep_what_they_had(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    scan(store, files(spark, a="go", b="yaml"))
    before = {r["rel_path"]: r["file_hash"] for r in store.states().collect()}
    got = index.scan(store, files(spark, a=None, b="yaml go", c=None), RECIPE, [HOME]).collect()
    assert {r["rel_path"][-1]: (r["status"], r["error"]) for r in got} == {"a": ("error", "cannot be read"), "b": ("updated", None), "c": ("error", "cannot be read")}
    assert names(store.chunks()) == ["a", "b"]
    after = {r["rel_path"]: r["file_hash"] for r in store.states().collect()}
    assert after["/home/docs/a"] == before["/home/docs/a"] and after["/home/docs/b"] != before["/home/docs/b"]
    assert scan(store, files(spark, a="---\n- list\n---\n", b="yaml go"))["a"] == "error" and names(store.chunks()) == ["a", "b"]


def test_other_settings_rebuild_whole_collections_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    far = Collection("/far")
    both = files(spark, a="go", b="yaml").union(files(spark, far, z="vector"))
    scan(store, both, collections=(HOME, far))
    hashed = Collection("/home/docs", model="hashing")
    recipe = hx.Recipe("markdown", "v1", "offline", "hashing", 8)
    with pytest.raises(index.RebuildRequired, match="model_changed"):
        scan(store, files(spark, a="go"), recipe, (hashed,), reconcile=False, dims=8)
    assert scan(store, files(spark, a="go", bad="---\n- x\n---\n"), recipe, (hashed,), dims=8) == {"a": "updated", "bad": "error"}
    assert names(store.chunks()) == ["a", "z"] and names(store.states()) == ["a", "z"]
    assert {c.root: (c.model, c.vector_dim) for c in store.collections()} == {"/home/docs": ("hashing", 8), "/far": ("keyword", 3)}
    assert Collection("/x").rebuild_reasons(Collection("/x", provider="p", splitter="s", vector_dim=4, db_version="v9")) == ["provider_changed", "splitter_changed", "db_version_changed"]


def test_vectors_of_another_length_are_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    scan(store, files(spark, a="go"))
    got = index.scan(store, files(spark, a="go", b="yaml"), RECIPE, [HOME], words=("one", "two")).collect()
    assert {r["rel_path"][-1]: r["status"] for r in got} == {"a": "skipped", "b": "error"}
    assert "expected=3 actual=2" in [r["error"] for r in got if r["error"]][0] and names(store.chunks()) == ["a"]


def test_layers_are_compacted_and_vacuumed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for text in ("one", "two", "three"):
        scan(store, files(spark, a=text, b="same"))
    rows = lambda: sorted((r["rel_path"], r["content"]) for r in store.chunks().collect())
    before = rows()
    assert before == [("/home/docs/a", "three"), ("/home/docs/b", "same")] and len(store.manifest()["layers"]) == 3
    store.compact()
    assert rows() == before and len(store.manifest()["layers"]) == 1 and len(store.vacuum()) == 3 and rows() == before
    scan(store, files(spark, a="four", b="same"), most_layers=1)
    assert rows()[0][1] == "four" and len(store.manifest()["layers"]) == 1


def test_registry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.register(Collection("/a", provider_options={"url": "u", "openai_api_key": "s3cr3t"}))
    store.register(Collection("/a/deep"))
    store.register(Collection("/a", file_type="image"))
    store.register(Collection("/a", model="other", file_type="md"))
    assert [(c.root, c.file_type, c.model) for c in store.collections()] == [("/a/deep", "markdown", "keyword"), ("/a", "image", "keyword"), ("/a", "md", "other")]
    assert "s3cr3t" not in "".join(p.read_text() for p in (tmp_path / "store").glob("manifest-*.json"))
    assert store.remove(Collection("/a", file_type="image").collection_id).file_type == "image" and len(store.collections()) == 2
    with pytest.raises(index.CollectionNotFound):
        store.remove("none")
    (tmp_path / "store" / "manifest-000000099.json").write_text("{")
    with pytest.raises(index.RebuildRequired):
        store.manifest()
    assert Collection("/tmp/docs").collection_id == "6fdb92d73ed94d13055de07d55229929" and Collection("/tmp/docs", file_type="image").collection_id == "faba04d4bf42ca416e1e7304d448f856"


def test_scopes_of_a_query():
    known = [Collection("/a/b"), Collection("/a"), Collection("/z/1"), Collection("/z/2"), Collection("/a", file_type="image")]
    roots = lambda *x, **how: [c.root for c in ask.scopes(known, *x, root_exists=lambda r: r != "/z/2", **how)]
    assert roots("/a/b/deep/guide.md") == ["/a/b"] and roots("/a/x") == ["/a"] and roots("/z") == ["/z/1", "/z/2"]
    assert roots() == ["/a/b", "/a", "/z/1"] and roots("", "image") == ["/a"] and roots("", "md") == roots()
    for path in ("/q", "/a/bc/../x"[:0] or "/ab"):
        with pytest.raises(ask.NotIndexed):
            roots(path)
    with pytest.raises(ask.NotIndexed):
        ask.scopes([], "")
    with pytest.raises(ValueError, match="vector_dim"):
        Collection("/a").valid()


def test_queries_over_stored_collections(spark, tmp_path):
    import json

    store = Store(spark, str(tmp_path / "store"))
    far = Collection("/far")
    found = files(spark, a="---\ntitle: Guide\ntags: [Go]\n---\n\ngo go vector", b="yaml go", sub="go").union(files(spark, far, z="---\ntags: [yaml]\n---\n\nvector vector yaml"))
    scan(store, found, collections=(HOME, far), tag_extractor="vocabulary")
    rows = {r["rel_path"]: r for r in store.chunks().collect()}
    assert rows["/home/docs/a"]["semantic_tags"] == ["go"] and rows["/home/docs/a"]["tag_vector"] == [1, 0, 0] and rows["/home/docs/b"]["semantic_tags"] == ["go", "yaml"]
    assert rows["/home/docs/b"]["tag_vector"] == pytest.approx([0.70710677, 0, 0.70710677])
    wide = search.Options(alpha=-1, delta=-1)
    get = lambda *x, **how: ask.ask(store, *x, root_exists=lambda _: True, **how)
    paths = lambda a: [r["rel_path"] for r in a.results.orderBy("rank").collect()]
    plain = get("go vector", options=wide)
    assert paths(plain)[0] == "/home/docs/a" and len(paths(plain)) == 4 and not plain.fused
    fused = get("go vector", options=wide, tag_extractor="vocabulary")
    top = fused.results.orderBy("rank").first()
    assert fused.query_tags == ["go", "vector"] and fused.fused and top["tag_score"] == pytest.approx(0.70710678) and top["score"] == pytest.approx(0.7 * top["content_score"] + 0.3 * top["tag_score"])
    for how in ({"no_tag": True}, {"options": search.Options(alpha=-1, delta=-1, tag_weight=0)}):
        assert not get("go vector", tag_extractor="vocabulary", **({"options": wide} | how)).fused
    assert not get("go ", tag_extractor="vocabulary").fused
    assert paths(get("go vector", "/far", options=wide)) == ["/far/z"] and paths(get("go", "/home/docs/sub", options=wide)) == ["/home/docs/sub"]
    assert paths(get("go", tags=[" GO "], options=wide)) == ["/home/docs/a"]
    said = json.loads(get("go vector", options=search.Options(limit=2, alpha=-1, delta=-1)).json().first()[0])
    assert said["version"] == "v1" and said["vector_dim"] == 3 and [r["rank"] for r in said["results"]] == [1, 2] and said["results"][0]["title_path"] == ["Guide"] and "explain" not in said and "query_tags" not in said
    for o, strategy in ((search.Options(limit=2, rerank="bm25"), "bm25"), (search.Options(limit=2, mmr=True, alpha=-1, delta=-1), "mmr"), (search.Options(limit=2, alpha=-1, delta=-1), "truncate")):
        said = json.loads(get("go vector", options=o, tag_extractor="vocabulary").json(explain=True).first()[0])
        assert said["explain"]["final_strategy"] == strategy and said["explain"]["search_window"] == 20 and said["explain"]["scope_count"] == 2
        assert said["explain"]["final_count"] == len(said["results"]) and said["query_tags"] == ["go", "vector"]
        own = said["results"][0]["explain"]
        assert {"content_score", "tag_score", "pre_rerank_score", "final_score"} <= set(own) and ("bm25_score" in own) == (strategy == "bm25") and ("mmr_relevance" in own) == (strategy == "mmr")
    with pytest.raises(ValueError):
        get("  ")
    with pytest.raises(ValueError, match="dimensions"):
        get("go", words=("one",))


def test_shown_files(spark, tmp_path):
    import json

    store = Store(spark, str(tmp_path / "store"))
    deep = Collection("/home/docs/deep")
    below = files(spark, deep, k="inside").withColumn("rel_path", F.lit("k"))
    scan(store, files(spark, a="go").union(below), collections=(HOME, deep), most_layers=5)
    paths = spark.createDataFrame([("/home/docs/a",), ("/home/docs/deep/k",), ("/home/docs/none",), ("/else",)], "path string")
    got = {r["path"]: r for r in ask.shown_files(store, paths).collect()}
    assert got["/home/docs/a"]["chunk_count"] == 1 and got["/home/docs/deep/k"]["root_dir"] == "/home/docs/deep" and got["/home/docs/deep/k"]["chunks"][0]["content"] == "inside"
    assert not got["/home/docs/none"]["found"] and not got["/else"]["found"]
    said = {r["path"]: json.loads(r["json"]) for r in ask.show_json(ask.shown_files(store, paths)).collect()}
    assert said["/else"] == {"found": False} and said["/home/docs/a"]["file"]["rel_path"] == "/home/docs/a" and said["/home/docs/a"]["chunks"][0]["vector_len"] == 3


def test_contracts(spark):
    good = {"source": "s", "file_path": "f", "rel_path": "r", "file_name": "n", "doc_type": "d", "file_hash": "h", "chunk_index": 0, "tags": ["a", "b"], "title_path": ["T"], "yaml": "{}"}
    schema = "source string, file_path string, rel_path string, file_name string, doc_type string, file_hash string, chunk_index int, tags array<string>, title_path array<string>, yaml string"
    changes = [{}, {"source": " "}, {"chunk_index": -1}, {"tags": ["b", "a"]}, {"tags": ["A"]}, {"title_path": [" "]}, {"yaml": None}, {"tags": None}]
    df = spark.createDataFrame([tuple((good | c).values()) for c in changes], schema)
    got = [r[0] for r in df.select(contracts.chunk_problems()).collect()]
    assert got == [[], ["source_required"], ["chunk_index_negative"], ["tags_not_normalized"], ["tags_not_normalized"], ["title_path_blank"], ["yaml_required"], []]
    assert contracts.enforced(df.limit(1), contracts.chunk_problems()).count() == 1
    with pytest.raises(Exception, match="invalid row"):
        contracts.enforced(df, contracts.chunk_problems()).collect()
    states = spark.createDataFrame([("r", "h", "c", ["i"], 1, "2024-01-01"), ("r", "", "c", ["i"], 2, "2024-01-01"), ("r", "h", "c", [" "], 1, None)], "rel_path string, file_hash string, recipe_hash string, chunk_ids array<string>, chunk_count int, d string")
    got = [r[0] for r in states.withColumn("last_indexed_at", F.to_timestamp("d")).select(contracts.state_problems()).collect()]
    assert got == [[], ["file_hash_required", "chunk_count_differs"], ["chunk_id_blank", "last_indexed_at_required"]]


def test_metadata_from_loose_maps(spark):
    good = '"source_path": " s ", "source_file": "f", "rel_path": "r", "file_name": "n", "doc_type": "d", "doc_hash": "h", "chunk_index": 2'
    rows = ["{%s}" % good, "{%s, \"tags\": [\" B\", \"a\", \"\"], \"title\": \" T \", \"title_path\": [\" x \", \" \"], \"yaml\": {\"k\": [1]}}" % good, "{%s, \"source\": 3}" % good, "{%s, \"tags\": [1]}" % good, "{%s, \"yaml\": []}" % good, "[]", "no", None, "{}"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(contracts.metadata(F.col("j"))).collect()]
    assert got[0]["error"] is None and got[0]["source"] == "s" and got[0]["file_hash"] == "h" and got[0]["tags"] == [] and got[0]["yaml"] == "{}" and got[0]["title"] == ""
    assert got[1]["error"] is None and got[1]["tags"] == ["a", "b"] and got[1]["title"] == "T" and got[1]["title_path"] == ["x"] and got[1]["yaml"] == '{"k":[1]}'
    assert [g["error"] for g in got[2:]] == ["metadata: source must be a string", "metadata: tags must be a list of strings", "metadata: yaml must be a map", *["metadata: values are required"] * 3, "metadata: source is required"]


def test_providers_and_captions(spark):
    own = providers.Providers()
    own.register(providers.Provider("markdown", (".md",), markdown.chunks))
    for bad in (providers.Provider("markdown", (".x",), None), providers.Provider("other", ("MD",), None), providers.Provider(" ", (".y",), None), providers.Provider("none", (), None)):
        with pytest.raises(ValueError):
            own.register(bad)
    assert own.types() == {".md": "markdown"} and own.get("markdown").chunks is markdown.chunks and ".webp" in providers.providers.types()
    with pytest.raises(KeyError):
        own.get("other")
    assert providers.splitters.names() == ["markdown"] and {"frequent", "vocabulary"} <= set(embedder.extractors.names())
    pictures = spark.createDataFrame([("/p/a.png", "h1"), ("/p/b.jpg", "h2"), ("/p/c.gif", "h3")], "rel_path string, file_hash string")
    said = spark.createDataFrame([("/p/a.png", " Cat ", ["B ", "a"], " on a mat "), ("/p/b.jpg", " ", None, None)], "rel_path string, title string, tags array<string>, description string")
    got = {r["rel_path"]: r for r in providers.captioned(pictures, said, "rh").collect()}
    a, b, c = (got[f"/p/{x}"] for x in ("a.png", "b.jpg", "c.gif"))
    assert (a["title"], a["content"], a["tags"], a["caption_text"], a["error"]) == ("Cat", "on a mat", ["a", "b"], "Cat on a mat a b", None)
    assert (b["title"], b["caption_text"]) == ("b", "b ") and c["error"] == "no caption"
    import hashlib

    assert a["chunk_id"] == hashlib.sha256(b"/p/a.png|rh|h1|0").hexdigest()


def test_stream_ingest(spark, tmp_path):
    from loam.streaming.ingest import arrivals, ingest

    rows = spark.createDataFrame([("a", "go"), ("b", "yaml"), ("a", "go")], "rel_path string, content string").withColumn("arrived", F.to_timestamp(F.lit("2024-01-01")))
    rows.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: ingest(arrivals(spark, str(tmp_path / "in")), store, RECIPE, HOME, str(tmp_path / "progress")).awaitTermination(120)
    run()
    assert store.chunks().count() == 2
    for n, text in enumerate(("changed", "go")):  # a revert within minutes counts
        spark.createDataFrame([("a", text)], "rel_path string, content string").withColumn("arrived", F.to_timestamp(F.lit(f"2024-01-01 00:0{n + 1}:00"))).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert {r["rel_path"]: r["content"] for r in store.chunks().collect()} == {"a": "go", "b": "yaml"}


def test_listing(spark, tmp_path):
    for p in ("a.md", "b.MD", "c.txt", ".hidden/leak.md", "node_modules/x.md", ".Trash-1000/y.md", "sub/keep.md", "sub/drop.md", "_under.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("sub/*\n!sub/keep.md\n")
    names = lambda **k: [r[1].removeprefix(f"{tmp_path}/") for r in listing.walk(str(tmp_path), listing.MARKDOWN, **k)]
    assert sorted(names()) == sorted(["_under.md", "a.md", "b.MD", ".hidden/leak.md", "sub/keep.md"])
    assert sorted(names(recursive=False)) == sorted(["_under.md", "a.md", "b.MD"])
    assert "a.md" not in names(excludes=listing.patterns("a.*, .zip"))
    assert listing.extensions("md, .md", listing.MARKDOWN) == [".md"]
    for fan_out in (1, 2, 1000):  # walked in tasks from the root, from its folders, not at all
        assert sorted(r["rel_path"].removeprefix(f"{tmp_path}/") for r in listing.files(spark, str(tmp_path), fan_out=fan_out).collect()) == sorted(names())
    for most in (0, 1, 3, 8):  # planned until so many entries were seen
        assert sorted(r["rel_path"].removeprefix(f"{tmp_path}/") for r in listing.files(spark, str(tmp_path), most_entries=most).collect()) == sorted(names())
    got = listing.contents(listing.files(spark, str(tmp_path))).collect()
    assert all(r["content"] == "x" and r["error"] is None for r in got)
    with pytest.raises(FileNotFoundError):
        listing.walk(str(tmp_path / "none"), listing.MARKDOWN)


def test_listing_plans_without_files(tmp_path):
    """A flat tree of few large folders: the driver sees a bounded number of entries and no file row, tasks get the folders."""
    for d in range(5):
        (tmp_path / f"d{d}").mkdir()
        for k in range(200):
            (tmp_path / f"d{d}" / f"{k}.md").write_text("x")
    import json

    opened = []
    reader = listing.FileReader({"root": str(tmp_path), "types": json.dumps(listing.MARKDOWN), "most_entries": "50"})
    scandir = os.scandir
    try:
        os.scandir = lambda p: opened.append(p) or scandir(p)
        parts = reader.partitions()
    finally:
        os.scandir = scandir
    assert opened == [str(tmp_path), f"{tmp_path}/d0"] and sorted(f for p in parts for f in p.trees) == [f"{tmp_path}/d{d}" for d in range(5)]
    assert sum(len(list(reader.read(p))) for p in parts) == 1000


def test_listing_by_prefix_and_type(spark, tmp_path):
    for p in ("a/x.md", "a/y.png", "b/z.md", "b/c/w.md", "c/v.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x")
    every = listing.files(spark, str(tmp_path), listing.MARKDOWN | listing.IMAGES)
    names = lambda df: sorted(r["rel_path"].removeprefix(f"{tmp_path}/") for r in df.collect())
    assert names(every.where("doc_type = 'image'")) == ["a/y.png"] and names(every.where(F.col("rel_path").endswith("v.md"))) == ["c/v.md"]
    assert names(listing.files(spark, str(tmp_path), prefix=f"{tmp_path}/b")) == ["b/c/w.md", "b/z.md"]
    parts = listing.FileReader({"root": str(tmp_path), "prefix": f"{tmp_path}/b/z"}).partitions()
    assert not {f.removeprefix(str(tmp_path)) for p in parts for f in p.own + p.trees} & {"/a", "/c", "/b/c"}


def test_longest_prefix_and_descendants(spark):
    paths = spark.createDataFrame([("/a/b/deep/guide.md",), ("/a/x.md",), ("/z",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/z/1",), ("/z/2",)], "root string")
    got = {r["path"]: (r["root"], r["rest"]) for r in scopes.longest_prefix(paths, roots).collect()}
    assert got == {"/a/b/deep/guide.md": ("/a/b", "deep/guide.md"), "/a/x.md": ("/a", "x.md"), "/a/b": ("/a/b", "")}
    assert sorted(r["root"] for r in scopes.descendants(paths, roots).collect()) == ["/z/1", "/z/2"]


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "chunk_id string, v int, created_at int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "chunk_id string, v int, created_at int")
    assert sorted((r["chunk_id"], r["v"]) for r in incremental.upsert(old, new).collect()) == [("a", 1), ("b", 3), ("c", 9)]


def test_mean_pooling(spark):
    df = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0])], "g string, vector array<double>")
    assert embedder.mean_pooled(df, "g").first()["vector"] == pytest.approx([0.70710678, 0.70710678])


def test_embedders_are_registered_once():
    assert {"hashing", "keyword"} <= set(embedder.names())
    with pytest.raises(ValueError):
        embedder.register("keyword", embedder.keyword)
    with pytest.raises(KeyError):
        embedder.make("none")


def test_an_inventory_is_pruned_as_a_walk_is(spark, tmp_path):
    made = [
        "a.md", "b.MD", "c.txt", ".md", "..md", "x.y/d.md", "x.y/e", "sub/a.md", "sub/deep/a.md", "sub/deep/b1.md", "sub/deep/b12.md", "Node_Modules/a.md", "sub/.TRASH-9/a.md",
        ".hidden/a.md", "build/a.md", "sub/build/a.md", "sub/build.md/a.md", "odd [1].md", "b+c.md", "sub/keep/a.md", "sub/drop/keep.md", "z/q/r/s.md", "z/s.md",
    ]
    for name in made:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = [(n, i) for i, n in enumerate(made)] + [("a.md", 99), (None, 100), ("", 101)]
    inventory = spark.createDataFrame(rows, "rel_path string, n int")
    for lines in ([], ["build/"], ["/sub/*", "!/sub/keep"], ["b?.md", "[!a-z]*.md"], ["z/**/s.md"], ["**/deep/**"], ["*.md", "!a.md"], ["odd \\[1].md", "b+c.md", "#c"], ["sub/dr*"], ["?"]):
        for recursive in (True, False):
            (tmp_path / ".gitignore").write_text("\n".join(lines))
            walked = sorted(r[1].removeprefix(f"{tmp_path}/") for r in listing.walk(str(tmp_path), listing.MARKDOWN, recursive, listing.patterns("c.*")))
            rules = [listing.Ignore(lines), listing.Ignore(listing.patterns("c.*"))]
            got = [r["rel_path"] for r in listing.kept(inventory, listing.MARKDOWN, recursive, rules).collect()]
            assert sorted(got) == sorted(walked + ["a.md"] * ("a.md" in walked)), (lines, recursive)
    assert listing.kept(inventory.limit(0), listing.MARKDOWN).count() == 0
    assert listing.Ignore(["b?.md"]).match("x/b1.md", False) and not listing.Ignore(["x?b.md"]).match("x/b.md", False)
