"""Token ids in training order: fixed-stride shards of sequences, permuted by a keyed Feistel network.

Texts become token ids, an end token closes each. Documents are dealt to buckets by a hash of their id and text, and within a bucket,
in order of both, packed one after the other into sequences of ``length`` ids; the last one of a bucket is padded. A sequence's number is
the sequences of all buckets before plus its place in its own: it follows from the rows alone, not from files, tasks or cores. The
network permutes 0 .. N-1: an even number of bits covers N, and a value that falls outside is sent through again (cycle-walking)
until it falls inside. Slot s lies in shard s // ``shard_slots`` at byte (s % ``shard_slots``) * stride, so a reader resumes at any slot by
arithmetic, reading in order. A task writes a range of shards.

Token ids cross the network twice, to their bucket and to the range of slots they belong to; packed sequences are written
between, so no task that is lost in the second makes a text be tokenised anew.

Defined cases: null and empty texts give no tokens; null ids and repeated rows are documents of their own (more than ``crowd`` rows alike
in id and text are counted and dealt to buckets copy by copy); other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokenizer as tk
from .common import as_table, giving_back, stored
from .textarrays import mix

#: So many buckets at most, so their starts are a table small enough to broadcast.
MOST_BUCKETS = 100_000

#: So many rows of a batch are Python objects at once.
SLICE = 1000


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. n-1 set by ``key``, applied to the values ``x``."""
    half = max(1, (max(1, int(n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & (2**63 - 1)) * np.uint64(2 * rounds + 1))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def width_of(end: int) -> int:
    return 2 if end < 1 << 16 else 4


def told_apart(docs: DataFrame, crowd: int) -> DataFrame:
    """(doc_id, h, copy, text): rows alike in id and text beyond ``crowd`` are numbered, so no key of id, h and copy is hot."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    some = rows.select("doc_id", "h", F.lit(0).cast("long").alias("copy"), "text")
    often = docs.groupBy("doc_id").count().where(F.col("count") > crowd).select(F.col("doc_id").alias("hot_id"))
    if often.isEmpty():
        return some
    same_id = F.col("doc_id").eqNullSafe(F.col("hot_id"))
    hot = stored(
        rows.join(often, same_id, "left_semi").groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.any_value("text").alias("text")).where(F.col("n") > crowd), "crowded-documents"
    )
    keys = hot.select(F.col("doc_id").alias("hot_id"), F.col("h").alias("hot_h"))
    dealt = hot.select("doc_id", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "text")
    return some.join(keys, same_id & F.col("h").eqNullSafe(F.col("hot_h")), "left_anti").union(dealt)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            yield batch.slice(first, SLICE)


def packed(docs: DataFrame, length: int, vocabulary: str, bucket_docs: int = 5000, crowd: int = 1000) -> DataFrame:
    """(bucket, at, doc_ids, starts, n_tokens, tokens): ids as little-endian, unpadded; document k of a sequence starts at id ``starts[k]``.

    Written to the shared folder. ``at`` counts within ``bucket``; neither depends on how ``docs`` is partitioned.
    """
    content = tk.vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = width_of(tk.build(content).end)
    buckets = min(MOST_BUCKETS, max(1, math.ceil(docs.count() / bucket_docs)))

    def encode(batches):
        tok = tk.build(shared.value)
        for batch in sliced(batches):
            ids = [np.append(tok.encode(t), tok.end).astype(f"<u{width}").tobytes() if (t := x.as_py()) else None for x in as_table(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "h", "copy", "tokens"])

    def pack(batches):
        names, rows = ["bucket", "at", "doc_ids", "starts", "n_tokens", "tokens"], []
        bucket, at, n, own, starts, pieces, id_type = None, 0, 0, [], [], [], None

        def close():
            nonlocal at, n, own, starts, pieces
            if n:
                rows.append((bucket, at, own, starts, n, b"".join(pieces)))
                at, n, own, starts, pieces = at + 1, 0, [], [], []

        def flush():
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.int32(), pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in sliced(batches):
            id_type = batch.column(1).type
            for b, doc_id, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if b != bucket:
                    close()
                    bucket, at = b, 0
                k = 0
                while k < len(tokens):
                    piece = tokens[k : k + (length - n) * width]
                    own.append(doc_id), starts.append(n), pieces.append(piece)
                    n, k = n + len(piece) // width, k + len(piece)
                    if n == length:
                        close()
                if len(rows) >= 2048:
                    yield flush()
        close()
        if rows:
            yield flush()

    made = told_apart(docs, crowd).select("doc_id", "h", "copy", "text").mapInArrow(giving_back(encode), f"doc_id {kind}, h long, copy long, tokens binary").where("tokens is not null")
    placed = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "copy"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "h", "copy")
    rows = placed.select("bucket", "doc_id", "tokens").mapInArrow(giving_back(pack), f"bucket long, at long, doc_ids array<{kind}>, starts array<int>, n_tokens int, tokens binary")
    return stored(rows, "sequences")


def arranged(made: DataFrame, n: int, length: int, shard_slots: int, key: int, vocabulary: str) -> DataFrame:
    """The rows of ``packed`` at their slots; see ``training_order``."""
    end = tk.build(tk.vocabulary(vocabulary)).end
    width = width_of(end)
    counts = made.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"))  # MOST_BUCKETS rows at most

    @F.pandas_udf("long")
    def slot_of(ordinal: pd.Series) -> pd.Series:
        return pd.Series(feistel(ordinal.to_numpy(), n, key))

    shards = max(1, -(-n // shard_slots))
    each = max(1, min(16, shards // (4 * made.sparkSession.sparkContext.defaultParallelism)))  # shards a task; they stay the same
    pad = F.unhex(F.lit(int(end).to_bytes(width, "little").hex()))
    placed = made.join(F.broadcast(starts), "bucket").withColumn("slot", slot_of(F.col("start") + F.col("at"))).select(
        "slot", F.floor(F.col("slot") / shard_slots).cast("int").alias("shard"), ((F.col("slot") % shard_slots) * (length * width)).alias("offset"),
        "doc_ids", "starts", "n_tokens", "tokens",
    )
    ranges = placed.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    return ranges.withColumn("tokens", F.rpad("tokens", F.lit(length * width), pad))


def training_order(docs: DataFrame, length: int = 1024, shard_slots: int = 4096, key: int = 20240229, vocabulary: str = tk.VOCABULARY) -> DataFrame:
    """(slot, shard, offset, doc_ids, starts, n_tokens, tokens), each partition a range of shards in slot order.

    ``tokens`` are padded with the end token to the stride, ``length`` ids of 2 bytes (4 for vocabularies of 2**16 and more).
    """
    made = packed(docs, length, vocabulary)
    return arranged(made, made.count(), length, shard_slots, key, vocabulary)


def write_shards(docs: DataFrame, folder: str, length: int = 1024, shard_slots: int = 4096, key: int = 20240229, vocabulary: str = tk.VOCABULARY) -> dict:
    """One file ``shard-NNNNNNNN.bin`` per shard and ``manifest.json`` in ``folder``, a path or address that every executor can write to.

    A file is written aside and renamed, so it is there whole or not at all; a run that resumes skips those that are. The manifest
    holds the layout, the key and a checksum of the packed sequences; a folder begun with another one is refused.
    """
    made = packed(docs, length, vocabulary)
    n, mark = made.agg(F.count("*"), F.bit_xor(F.xxhash64("bucket", "at", "tokens"))).first()
    manifest = {"sequences": n, "length": length, "width": width_of(tk.build(tk.vocabulary(vocabulary)).end), "shard_slots": shard_slots, "key": key, "checksum": mark or 0}
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    told = f"{at}/manifest.json"
    if system.get_file_info(told).type == fs.FileType.NotFound:
        with system.open_output_stream(f"{told}.aside") as f:
            f.write(json.dumps(manifest).encode())
        system.move(f"{told}.aside", told)
    elif (there := read_manifest(folder)) != manifest:
        raise ValueError(f"{folder} holds shards of {there}, not of {manifest}")

    def write(rows) -> None:
        system, at = fs.FileSystem.from_uri(folder)
        file, aside, shard, skip = None, "", None, None

        def close():
            if file is not None:
                file.close()
                system.move(aside, f"{at}/shard-{shard:08d}.bin")

        for r in rows:
            if r["shard"] == skip:
                continue
            if r["shard"] != shard or file is None:
                close()
                file, shard = None, r["shard"]
                if system.get_file_info(f"{at}/shard-{shard:08d}.bin").type != fs.FileType.NotFound:
                    skip = shard
                    continue
                aside = f"{at}/.shard-{shard:08d}.{TaskContext.get().taskAttemptId()}"
                file = system.open_output_stream(aside)
            file.write(bytes(r["tokens"]))
        close()

    arranged(made, n, length, shard_slots, key, vocabulary).select("shard", "slot", "tokens").foreachPartition(write)
    return manifest


def read_manifest(folder: str) -> dict:
    system, at = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def read_slots(folder: str, first: int, last: int):
    """The sequences of slots ``first`` to ``last`` (exclusive) in order, each shard opened once and read on."""
    m = read_manifest(folder)
    system, at = fs.FileSystem.from_uri(folder)
    stride = m["length"] * m["width"]
    while first < last:
        shard, k = divmod(first, m["shard_slots"])
        with system.open_input_file(f"{at}/shard-{shard:08d}.bin") as f:
            f.seek(k * stride)
            while first < min(last, (shard + 1) * m["shard_slots"]):
                yield f.read(stride)
                first += 1
