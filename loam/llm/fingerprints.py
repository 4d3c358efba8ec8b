"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over windows of eight bytes; where its low ``k`` bits are all ones, a chunk ends, so the bounds follow from the text around
them and survive edits elsewhere. A signature is the chunks' hashes, two characters each. ``k`` is the least for which a signature has at most
``MOST`` chunks (block size 2^k); a fingerprint ``size:signature:signature`` also holds the signature of twice that size, which has every
chunk end of the first that one more bit allows. Where chunks would thus become far fewer than ``MOST`` at once, as in a text that repeats one line, the finer size
stays and its last chunk takes the rest. Two fingerprints are compared by the edit distance of their signatures of one block size, the smaller they share;
without one, or if one text is empty, the likeness is 0. Equal fingerprints have 1.

``neighbours`` puts rows in an order, shows each one the next, and moves every text once: range partitions are sorted, a task holds two texts at a
time, and only the edges of partitions meet in a join.

Defined cases: a null text is empty, and the fingerprint of an empty text is ``2::``; rows of null id come last, and of one id in the order of their texts' hashes;
repeated rows are rows of their own; a table of one row has itself as the next; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, numbered, stored

WINDOW, MOST, LEAST_BITS = 8, 64, 1
SEGMENT = 1 << 20
DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
VALUES = np.zeros(256, np.uint16)
VALUES[np.frombuffer(DIGITS, np.uint8)] = np.arange(64)
PAIRS = [chr(DIGITS[v & 63]) + chr(DIGITS[v >> 6]) for v in range(4096)]
FACTOR = 0x9E3779B1


def _rolled(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, hash of the last bytes at each byte) of segments of the text; a window of eight is two of four, and so on."""
    for lo in range(0, len(data), SEGMENT):
        ahead = min(lo, WINDOW - 1)
        h = data[lo - ahead : lo + SEGMENT].astype(np.uint32) + np.uint32(1)
        for half in (1, 2, 4):
            more = h * np.uint32(pow(FACTOR, half, 1 << 32))
            more[half:] += h[: max(0, len(h) - half)]
            h = more
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        yield lo, h[ahead:]


def _levels(h: np.ndarray) -> np.ndarray:
    """How many of the lowest bits are ones."""
    zero = ~h & (h + np.uint32(1))
    return np.where(zero == 0, 32, np.frexp(zero.astype(np.float64))[1] - 1)


def _ends(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk ends of block size 2^k, how many bits each has, number of ends that have at least so many bits from k on).

    The first ``MOST`` ends of either size are all that signatures need, so a very long text holds no more at a time.
    """
    mask, ends, bits, counts = np.uint32((1 << k) - 1), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(34, np.int64)
    for lo, h in _rolled(data):
        at = np.flatnonzero((h & mask) == mask)
        level = _levels(h[at])
        counts[:33] += np.bincount(level, minlength=33)
        ends, bits = np.concatenate([ends, at + lo + 1]), np.concatenate([bits, level])
        if len(ends) > 64 * MOST:
            use = np.zeros(len(ends), bool)
            for least in range(k, 33):
                use[np.flatnonzero(bits >= least)[:MOST]] = True
            ends, bits = ends[use], bits[use]
    return ends, bits, counts[::-1].cumsum()[::-1]


def _signature(text: bytes, ends: np.ndarray) -> str:
    """Two characters for each chunk; the ends beyond the last allowed one are passed over."""
    stops = ends[: MOST - 1].tolist()
    if len(text) and (not stops or stops[-1] < len(text)):
        stops.append(len(text))
    whole = memoryview(text)
    return "".join([PAIRS[xxhash.xxh3_64_intdigest(whole[lo:hi]) & 4095] for lo, hi in zip([0, *stops], stops)])  # noqa: B905


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    guess = max(LEAST_BITS, (len(data) // MOST).bit_length() - 3)
    ends, bits, counts = _ends(data, guess)
    if guess > LEAST_BITS and counts[guess] < MOST:  # fewer ends than a text of that length has as a rule
        guess = LEAST_BITS
        ends, bits, counts = _ends(data, guess)
    k = guess
    while counts[k] >= MOST:
        k += 1
    if k > LEAST_BITS and counts[k] < MOST // 8:
        k -= 1
    if k < guess:
        ends, bits, _ = _ends(data, k)
    return f"{1 << k}:{_signature(text, ends[bits >= k])}:{_signature(text, ends[bits > k])}"


def _codes(signatures: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) // 2 for s in signatures])
    out = np.full((len(signatures), MOST), pad, np.uint16)
    for row, s in zip(out, signatures, strict=True):
        v = VALUES[np.frombuffer(s.encode(), np.uint8)]
        row[: len(v) // 2] = v[::2] | v[1::2] << 6
    return out, sizes


def edit_distances(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(least number of chunks to insert, delete or replace, chunks of the longer one) of each pair of signatures: one row of all pairs' tables at a time."""
    a, la = _codes(left, 0xFFFF)
    b, lb = _codes(right, 0xFFFE)
    steps = np.arange(MOST + 1, dtype=np.int16)
    row = np.tile(steps, (len(a), 1))
    out = np.where(la == 0, lb, 0)
    for i in range(1, int(la.max(initial=0)) + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1 : i]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions along the row
        done = np.flatnonzero(la == i)
        out[done] = row[done, lb[done]]
    return out, np.maximum(la, lb)


def likeness(left: list[str], right: list[str], block: int = 2048) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(left))
    for lo in range(0, len(left), block):
        some, one, other = [], [], []
        for i in range(lo, min(lo + block, len(left))):
            if left[i] == right[i]:
                out[i] = 1.0
                continue
            (m, *x), (n, *y) = left[i].split(":"), right[i].split(":")
            m, n = int(m), int(n)
            if m == n or m == 2 * n or n == 2 * m:
                x, y = (x[0], y[0]) if m == n else (x[0], y[1]) if m > n else (x[1], y[0])
                if x and y:
                    some.append(i), one.append(x), other.append(y)
        if some:
            d, longest = edit_distances(one, other)
            out[some] = 1 - d / longest
    return out


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text."""

    def of(batches):
        for batch in batches:
            got = [fingerprint((t.as_py() or "").encode()) for t in as_table(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(of, f"{fields}, `{name}` string")


def edited(text: str, following: str) -> str:
    """``text`` with the first characters of ``following`` in place of its last third."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _closed(kind: pa.DataType, rows: list[tuple]) -> tuple[list, list[str]]:
    """Columns and names of ``RESULT`` with the id, of rows (id, text, fingerprint, next text, next fingerprint)."""
    whole = [edited(t, after).encode() for _, t, _, after, _ in rows]
    own, following = [r[2] for r in rows], [r[4] for r in rows]
    new = [fingerprint(x) for x in whole]
    return [
        pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string()), pa.array(own, pa.string()),
        pa.array(new, pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, following)),
    ], ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]]


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs(doc_id, text)``.

    The next document is the one of the next smaller id, and that of the last is the first.
    """
    rows, file, row = numbered(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.col(file).alias("file"), F.col(row).alias("place"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("file"), F.col("place")]
    sorted_rows = named.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def walk(batches):
        ahead, begun = None, False
        for batch in batches:
            part, ids = batch.column(0), batch.column(1)
            made, edges = [], []
            for p, i, text in zip(part.to_pylist(), ids.to_pylist(), as_table(batch, "text"), strict=True):
                text = text.as_py()
                own = (p, i, text, fingerprint(text.encode()))
                if ahead is not None:
                    made.append((*ahead[1:], *own[2:]))
                if not begun:
                    edges.append(("first", own))
                    begun = True
                ahead = own
                if len(made) >= 512:
                    yield emit(ids.type, made, [])
                    made = []
            yield emit(ids.type, made, edges)
        if begun:
            yield emit(ids.type, [], [("last", ahead)])

    def emit(id_type, made, edges):
        columns, names = _closed(id_type, made)
        n, m = len(made), len(edges)
        columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in columns]
        columns[0] = pa.concat_arrays([columns[0].slice(0, n), pa.array([e[1] for _, e in edges], id_type)])
        columns[3] = pa.concat_arrays([columns[3].slice(0, n), pa.array([e[3] for _, e in edges], pa.string())])
        more = [pa.array(["row"] * n + [k for k, _ in edges], pa.string()), pa.array([0] * n + [e[0] for _, e in edges], pa.int32()), pa.array([None] * n + [e[2] for _, e in edges], pa.string())]
        return pa.RecordBatch.from_arrays([*more, *columns], names=["kind", "part", "text", *names])

    walked = stored(sorted_rows.mapInArrow(walk, f"kind string, part int, text string, doc_id {kind}, {RESULT}"), "fingerprints")
    first = walked.where("kind = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = walked.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
    parts = first.select("part")  # a row a partition
    w = Window.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("following"))
    open_rows = last.join(follows, "part").join(first.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")

    def close(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                columns, names = _closed(batch.column(0).type, [tuple(c[0].as_py() for c in one.columns)])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]]
    return walked.where("kind = 'row'").select(*columns).unionByName(open_rows.mapInArrow(close, f"doc_id {kind}, {RESULT}"))
