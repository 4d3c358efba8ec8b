import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import common
from loam.llm import token_counts as tc
from loam.llm import token_output as to
from loam.llm import tokenizer as tk

DOCS = "doc_id long, text string, seq string, slot string, spans array<struct<name:string,start:int,end:int>>"
TEXTS = {1: "Hello world.\nSecond line\n\nthird  ", 2: "", 3: None, 4: "\n\n\n", 5: "日本語のテキスト\nß é 🎉🎉 end", 6: "x" * 5000 + "\n" + " " * 3000 + "y", 7: "no line feed"}


@pytest.fixture(scope="module")
def tok():
    return tk.build(tk.vocabulary())


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "a", "b", [("f", 0, 4), ("g", 6, 9)]) for i, t in texts.items()], DOCS)


def brute(tok, text, begin, stop, rule):
    """Owners by looking at every character of every token, from bytes decoded one by one."""
    data, at, out = text.encode(), 0, [0] * len(begin)
    place, k = [], -1
    for b in data:
        k += (b & 0xC0) != 0x80
        place.append(k)
    for t in tok.encode(text):
        n = len(tok.encoding.decode_single_token_bytes(int(t)))
        chars = sorted(set(place[at : at + n]))
        at += n
        held = [sum(b <= c < s for c in chars) for b, s in zip(begin, stop, strict=True)]
        if rule == "most" and max(held, default=0):
            out[held.index(max(held))] += 1
        if rule == "start":
            own = [i for i, (b, s) in enumerate(zip(begin, stop, strict=True)) if b <= chars[0] < s]
            if own:
                out[own[0]] += 1
    return out


@pytest.mark.parametrize("rule", ["most", "start"])
def test_lines_equal_brute_force(spark, tok, rule):
    got = {}
    for r in tc.token_counts(frame(spark), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"], r["doc_tokens"]))
    assert set(got) == set(TEXTS)
    for i, t in TEXTS.items():
        rows = sorted(got[i])
        lines = (t or "").splitlines(keepends=True) if t else [""]
        assert [r[2] - r[1] for r in rows] == [len(x) for x in lines]
        if t:
            assert [r[3] for r in rows] == brute(tok, t, [r[1] for r in rows], [r[2] for r in rows], rule)
            assert sum(r[3] for r in rows) == rows[0][4] == len(tok.encode(t))


@pytest.mark.parametrize("rule", ["most", "start"])
def test_given_spans_with_gaps(spark, tok, rule):
    got = {(r["doc_id"], r["name"]): r["n_tokens"] for r in tc.token_counts(frame(spark), "spans", rule).collect()}
    for i, t in TEXTS.items():
        assert [got[(i, "f")], got[(i, "g")]] == (brute(tok, t, [0, 6], [4, 9], rule) if t else [0, 0])


def test_query_counts_every_token(spark, sf_dir, tok):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: r[1] for r in tc.token_counts(docs).groupBy("doc_id").agg(F.sum("n_tokens")).collect()}
    assert got == {r[0]: len(tok.encode(r[1])) for r in docs.select("doc_id", "text").collect()}


def test_odd_tables(spark):
    assert tc.token_counts(frame(spark).limit(0)).count() == 0 and to.training_order(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(frame(spark), rule="other")
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert tc.token_counts(rows).count() == 3 and sum(len(r["doc_ids"]) for r in to.training_order(rows).collect()) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 65_537])
def test_feistel_permutes(n):
    got = to.feistel(np.arange(n), n, key=9)
    assert sorted(got) == list(range(n))
    if n > 100:
        assert list(got) != list(range(n)) and list(got) != list(to.feistel(np.arange(n), n, key=10))


def texts_of(rows, end):
    """{doc_id: token ids} from packed sequences in order of their numbers; a document that goes on starts the next sequence."""
    out, held = [], []
    for r in rows:
        ids = np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist()
        for doc_id, a, b in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], r["n_tokens"]], strict=True):
            held += ids[a:b]
            if held[-1] == end:
                out.append((doc_id, held))
                held = []
    assert not held
    return out


def test_sequences_are_packed_whole_texts(spark, tok):
    rows = to.packed(frame(spark), 16, tk.VOCABULARY, bucket_docs=2).orderBy("bucket", "at").collect()
    got = texts_of(rows, tok.end)
    assert sorted(i for i, _ in got) == [i for i, t in TEXTS.items() if t]
    assert all(tok.encoding.decode(ids[:-1]) == TEXTS[i] for i, ids in got)
    last = {r["bucket"]: r["at"] for r in rows}
    assert all(r["n_tokens"] == 16 for r in rows if r["at"] != last[r["bucket"]]) and len(last) > 1


def test_shards_round_trip(spark, tok, tmp_path):
    how = {"length": 16, "shard_slots": 8}
    rows = to.training_order(frame(spark), **how).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    assert all((r["shard"], r["offset"]) == (r["slot"] // 8, r["slot"] % 8 * 32) and len(r["tokens"]) == 32 for r in rows)
    folder = str(tmp_path / "shards")
    to.write_shards(frame(spark), folder, **how)
    by_slot = {r["slot"]: bytes(r["tokens"]) for r in rows}
    assert list(to.read_slots(folder, 0, n)) == [by_slot[s] for s in range(n)] and list(to.read_slots(folder, 7, 18)) == [by_slot[s] for s in range(7, 18)]
    (tmp_path / "shards" / "shard-00000000.bin").unlink()
    kept = (tmp_path / "shards" / "shard-00000001.bin").stat().st_mtime_ns
    to.write_shards(frame(spark).repartition(5), folder, **how)  # resumes from other partitions: only what is missing is written
    assert list(to.read_slots(folder, 0, n)) == [by_slot[s] for s in range(n)] and (tmp_path / "shards" / "shard-00000001.bin").stat().st_mtime_ns == kept
    for other in ({"key": 1}, {"length": 8}):
        with pytest.raises(ValueError):
            to.write_shards(frame(spark), folder, **(how | other))
    with pytest.raises(ValueError):
        to.write_shards(frame(spark, {**TEXTS, 1: "changed"}), folder, **how)


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(i % 90, f"text {i % 100} " * (i % 40 + 1)) for i in range(240)] + [(None, "alike")] * 60 + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def slots(d, **how):
        made = to.packed(d, 16, tk.VOCABULARY, 40, **how)
        return sorted((r["slot"], r["doc_ids"], bytes(r["tokens"])) for r in to.arranged(made, made.count(), 16, 8, 5, tk.VOCABULARY).collect())

    two = slots(df.repartition(2), crowd=10)
    assert two == slots(df.repartition(5), crowd=10) and sum(x[1].count(None) for x in two) >= 60
    assert slots(df.repartition(2)) == slots(df.repartition(5, "text"))


def test_partitions_are_ranges_of_slots(spark):
    df = to.training_order(frame(spark), length=16, shard_slots=8).select("slot", F.spark_partition_id().alias("p"))
    parts = {}
    for r in df.collect():
        parts.setdefault(r["p"], []).append(r["slot"])
    ranges = sorted((p[0], p[-1]) for p in parts.values())
    assert all(p == sorted(p) for p in parts.values()) and all(a[1] < b[0] and b[0] % 8 == 0 for a, b in zip(ranges, ranges[1:], strict=False))


def test_long_runs_of_white_space(spark, tok):
    for blank in (" ", "\n", " \n", "\u3000", "\t \x85"):
        for text in ("x" + blank * 5000 + "y", blank * 5000, "a  b" + blank * 4096 + " é" + blank * 9000 + "!", blank * 4095 + "z"):
            assert tok.encode(text).tolist() == tok.encoding.encode_ordinary(text)
    assert tok.encode("a" + "\x1c" * 5000 + "b").tolist() == tok.encoding.encode_ordinary("a" + "\x1c" * 5000 + "b")
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string").select("doc_id", F.concat(F.repeat(F.lit(" "), 5_000_000), F.lit("end")).alias("text"))
    got = tc.token_counts(rows).first()
    assert got["n_tokens"] == got["doc_tokens"] > 1_000_000
    assert to.packed(rows, 1024, tk.VOCABULARY).agg(F.sum("n_tokens")).first()[0] == got["n_tokens"] + 1


def test_other_columns_and_other_types_of_id(spark):
    df = spark.createDataFrame([("k", "some text", 1, "x", 2), (None, "more", 3, None, 4)], "doc_id string, text string, bucket int, h string, copy int")
    assert sorted(x for r in to.training_order(df).collect() for x in r["doc_ids"] if x) == ["k"] and tc.token_counts(df).count() == 2


def plain_slot(x: int, n: int, key: int) -> int:
    """The network on one value, with whole numbers of any size."""
    def mixed(v: int) -> int:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ v >> shift) * factor % 2**64
        return v ^ v >> 31

    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x % 2**half
        for r in range(1, 7):
            left, right = right, left ^ mixed(right ^ mixed((r + key * 13) % 2**64)) % 2**half
        x = left << half | right
        if x < n:
            return x


def test_training_order_equals_plain_packing(spark, tok):
    """Buckets packed in loops, numbered one after the other, each number sent through the network by itself."""
    docs = spark.createDataFrame([(i, t, None) for i, t in TEXTS.items()] + [(3, "said again", None), (None, "no id", None), (None, "no id", None)], "doc_id long, text string, h string").repartition(3)
    length, key = 16, 20240229
    n_buckets = max(1, -(-docs.count() // 5000))
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash", F.lit(0).cast("long")), F.lit(n_buckets)))
    rows = sorted(((r["bucket"], (r["doc_id"] is not None, r["doc_id"] or 0), r["hash"], r["doc_id"], r["text"]) for r in keyed.collect() if r["text"]), key=lambda r: r[:3])
    sequences, bucket, ids, own, starts = [], None, [], [], []

    def close():
        nonlocal ids, own, starts
        if ids:
            sequences.append((own, starts, ids))
        ids, own, starts = [], [], []

    for b, _, _, doc_id, text in rows:
        if b != bucket:
            close()
            bucket = b
        for token in [*tok.encode(text).tolist(), tok.end]:
            if not ids or own_of != (doc_id, text, len(own)):
                own.append(doc_id), starts.append(len(ids))
                own_of = (doc_id, text, len(own))
            ids.append(token)
            if len(ids) == length:
                close()
        own_of = None
    close()
    n = len(sequences)
    want = {plain_slot(k, n, key): (own, starts, len(ids), ids + [tok.end] * (length - len(ids))) for k, (own, starts, ids) in enumerate(sequences)}
    got = {r["slot"]: (r["doc_ids"], r["starts"], r["n_tokens"], np.frombuffer(r["tokens"], "<u2").tolist()) for r in to.training_order(docs, length, key=key).collect()}
    assert got == want and n > 5


def test_tasks_hold_few_rows_and_give_memory_back(spark, monkeypatch):
    """Each task of ``packed`` makes Python objects of a slice of its batch, and gives back what it freed when it ends."""
    tasks, given = [], []
    made = type(spark.range(1))
    monkeypatch.setattr(made, "mapInArrow", lambda self, f, *how, was=made.mapInArrow: tasks.append(f) or was(self, f, *how))
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    rows = [(i, f"text {i} " * 5) for i in range(2 * to.SLICE + 7)]
    to.packed(spark.createDataFrame(rows, "doc_id long, text string"), 64, tk.VOCABULARY)
    encode, pack = tasks
    ids, texts = (list(x) for x in zip(*rows, strict=True))
    out = list(encode(iter([pa.RecordBatch.from_pydict({"doc_id": ids, "h": ids, "copy": ids, "text": texts})])))
    assert [b.num_rows for b in out] == [to.SLICE, to.SLICE, 7] and len(given) == 1
    list(pack(iter([pa.RecordBatch.from_pydict({"bucket": ids, "doc_id": ids, "tokens": pa.array([b"\0\0"] * len(ids), pa.binary())})])))
    assert len(given) == 2


def test_freed_memory_goes_back():
    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    def task(batches):
        for batch in batches:
            made = [bytes(1000) for _ in range(200_000)]
            pins.append(made[-1])  # what lies above what is freed keeps it from going back by itself
            yield batch

    pins: list[bytes] = []
    before = held()
    for run, most in ((task, None), (common.giving_back(task), 60)):
        assert len(list(run(iter([1])))) == 1
        left = held() - before
        assert left > 100 if most is None else left < most
