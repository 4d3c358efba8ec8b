import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from loam.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, part int, kind string"


def rolled(window: bytes) -> int:
    """Trailing ones of the hash of the last bytes, one by one."""
    h = 0
    for j, c in enumerate(reversed(window)):
        h = (h + (c + 1) * pow(0x9E3779B1, 7 - j, 1 << 32)) % (1 << 32)
    h ^= h >> 15
    h = h * 0x2C1B3C6D % (1 << 32)
    h ^= h >> 13
    n = 0
    while n < 32 and h >> n & 1:
        n += 1
    return n


def plain(text: bytes) -> str:
    """Every byte in a loop, chunks as slices."""
    import xxhash

    levels = [rolled(text[max(0, i - 7) : i + 1]) for i in range(len(text))]
    k = 1
    while sum(v >= k for v in levels) >= 64:
        k += 1
    if k > 1 and sum(v >= k for v in levels) < 8:
        k -= 1
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(k: int) -> str:
        chunks, at = [], 0
        for i, v in enumerate(levels):
            if v >= k and len(chunks) < 63:
                chunks.append(text[at : i + 1])
                at = i + 1
        if at < len(text):
            chunks.append(text[at:])
        hashes = [xxhash.xxh3_64_intdigest(c) for c in chunks]
        return "".join(alphabet[h % 64] + alphabet[h // 64 % 64] for h in hashes)

    return f"{2**k}:{signature(k)}:{signature(k + 1)}"


def distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    common = {int(m): x[0], 2 * int(m): x[1]}
    shared = sorted({int(n), 2 * int(n)} & set(common))
    if not shared:
        return 0.0
    one, other = common[shared[0]], {int(n): y[0], 2 * int(n): y[1]}[shared[0]]
    if not one or not other:
        return 0.0
    pairs = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    return 1 - distance(pairs(one), pairs(other)) / max(len(one) // 2, len(other) // 2)


def texts() -> list[str]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeiou tn") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 20, 60, 200, 700, 3000)]
    return [*made, "a", "ab", "abc", "a" * 5000, "one line again\n" * 400, "é" * 50 + "ü€" * 40, "\U0001f600 tail", " ", made[-1][:4000] + "changed" + made[-1][4000:]]


def test_fingerprints_equal_a_plain_loop(monkeypatch):
    some = [t.encode() for t in texts()]
    want = [plain(t) for t in some]
    assert [fp.fingerprint(t) for t in some] == want
    monkeypatch.setattr(fp, "SEGMENT", 100)  # texts over many segments
    assert [fp.fingerprint(t) for t in some] == want
    assert want[0] == "2::" and all(len(w.split(":")[1]) <= 128 for w in want)


def test_likeness_equals_a_plain_table():
    prints = [fp.fingerprint(t.encode()) for t in texts()]
    left = [a for a in prints for _ in prints]
    right = [b for _ in prints for b in prints]
    got = fp.likeness(left, right, block=50)
    assert np.allclose(got, [plain_likeness(a, b) for a, b in zip(left, right, strict=True)])
    assert ((got >= 0) & (got <= 1)).all()


def expected(rows: list[tuple]) -> dict[int, tuple]:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        own = plain(text.encode())
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), own, plain(new.encode()), plain_likeness(own, plain(new.encode())), plain_likeness(own, plain(after.encode())))
    return out


def found(df) -> list[tuple]:
    return [(r.doc_id, (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)) for r in df.collect()]


def test_neighbours_equal_a_plain_walk(spark):
    """Also over many partitions, empty ones among them, and with columns named like the operator's own."""
    rows = [(7 * k, t) for k, t in enumerate(texts())] + [(1, None)]
    docs = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    want = expected(rows)
    for n in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = found(fp.neighbours(docs))
        assert len(got) == len(rows) and dict(got).keys() == want.keys()
        for i, v in got:
            assert v[:4] == want[i][:4] and np.allclose(v[4:], want[i][4:])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    assert fp.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = found(fp.neighbours(spark.createDataFrame([(5, "a text that stands alone", None, None, None)], SCHEMA)))
    assert len(one) == 1 and one[0][1][5] == 1.0
    rows = [(None, "no id at all", "", 0, "")] * 3 + [(4, "the same row", "", 0, "")] * 50 + [(4, None, "", 0, ""), (4, "", "", 0, "")]
    got = found(fp.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert len(got) == len(rows)
    assert sorted(v[0] for i, v in got if i == 4) == [0, 0] + [12] * 50 and all(v[2] == "2::" for _, v in got if v[0] == 0)
    assert len({v[2] for _, v in got if v[0] == 12}) == 2


def test_edits_are_near_and_neighbours_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fp.neighbours(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert got.near_edited.quantile(0.02) > 0.4 and got.near_next.quantile(0.95) < 0.2
    assert got.groupby("text").fingerprint.nunique().max() == 1


def test_fingerprints_keep_columns(spark):
    got = fp.fingerprints(spark.createDataFrame([(1, "some text", None, 2, "k"), (2, None, "x", None, None)], SCHEMA).drop("fingerprint")).orderBy("doc_id").collect()
    assert got[0].fingerprint == plain(b"some text") and got[1].fingerprint == "2::" and got[0].kind == "k"
    assert fp.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("n", F.lit(1))).columns == ["doc_id", "text", "n", "fingerprint"]
