"""N-gram Jaccard self-join by MinHash banding, each candidate verified on the full n-gram sets.

``jaccard_classes`` returns one row per document with its class (all documents that links reach), its number of links, and
whether it is the one its class keeps.

How rows move. One pass makes, per document, a key of its word sequence and its band hashes;
documents with equal keys fold into one representative, so groups of exact copies cost one row
from there on. Band hashes shuffle on their value; every bucket links its members to its smallest,
linear in the bucket. The components of these edges hold every candidate pair. A component that fits one block is compared as a whole. A
larger one is either cut into blocks, each compared with each, or, where that copies fewer texts, into its buckets, so that a long chain of
chance candidates costs what its buckets hold; a bucket beyond a block is cut into blocks, and a pair that shares several buckets counts in
the first. One task compares one block or two on full n-gram sets: it returns a row per document (links counted, smallest one
reached), never a row per pair. Texts of candidates alone are shuffled.

Defined cases: every row is a document of its own, also where ids repeat or are null. Null, empty and word-less texts link with nothing
and keep themselves; a text with fewer words than ``width`` has one n-gram, all its words; a class's id is its smallest id that is not
null, null if it has none, and of the rows with that id one is kept; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, checkpointed, components, giving_back, numbered, stored


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows a band): the most rows whose bands, enough for ``recall`` at ``threshold``, fit."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def band_hashes(w: ta.Words, width: int, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes per row of the block; rows without words hold garbage."""
    row, hsh = ta.shingles(w, width)
    low = (hsh >> np.uint64(32)).astype(np.uint32)
    begin = np.searchsorted(row, np.arange(w.rows))
    live = np.flatnonzero(np.bincount(row, minlength=w.rows))
    rng = np.random.RandomState(7)
    out = np.zeros((w.rows, bands), dtype=np.uint64)
    if not len(live):
        return out
    v = np.empty_like(low)
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(live), b + 1, dtype=np.uint64)
            for _ in range(rows):
                x, m = rng.randint(0, 2**32, 2, dtype=np.uint64).astype(np.uint32)
                np.bitwise_xor(low, x, out=v)
                np.multiply(v, m | np.uint32(1), out=v)
                np.bitwise_xor(v, v >> np.uint32(15), out=v)
                np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
                acc = ta.mix(acc * ta.P + np.minimum.reduceat(v, begin[live]).astype(np.uint64))
            out[live, b] = acc
    return out


def word_keys(w: ta.Words) -> np.ndarray:
    """Two 64-bit hashes (rows hi, lo) of the word sequence of each row of the block; 0 for a row without words."""
    h = w.hashes()
    begin = np.cumsum(w.counts) - w.counts
    power, _ = ta._powers(int(w.counts.max(initial=0)) + 1)
    key = np.zeros((2, w.rows), dtype=np.uint64)
    live = np.flatnonzero(w.counts)
    if len(live):
        at = np.arange(len(h)) - begin[w.row]
        with np.errstate(over="ignore"):
            for k in range(2):
                key[k, live] = ta.mix(np.add.reduceat(ta.mix(h + np.uint64(k)) * power[at], begin[live]))
    return key.view(np.int64)


def signatures(rows: DataFrame, width: int, bands: int, per_band: int) -> DataFrame:
    """``rows`` (doc_id, file, row, text) with hi, lo (key of the word sequence), n (words) and bands in place of the text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches):
        for batch in batches:
            parts = []
            for w in ta.blocks(as_table(batch, "text"), 1 << 19):
                parts.append((word_keys(w), w.counts, band_hashes(w, width, bands, per_band)))
            if not parts:
                continue
            key = np.concatenate([p[0] for p in parts], axis=1)
            sig = np.concatenate([p[2] for p in parts]).view(np.int64)
            offsets = np.arange(len(sig) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(key[0]), pa.array(key[1]),
                    pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1))),
                ],
                names=["doc_id", "file", "row", "hi", "lo", "n", "bands"],
            )

    return rows.mapInArrow(giving_back(of), f"doc_id {kind}, file long, row long, hi long, lo long, n long, bands array<long>")


def compare(ids, copies, row, hsh, threshold: float, side, keys, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and smallest linked id reached, for the rows of one group in one cell.

    ``side`` is None where all pairs count, else a 0/1 array: only pairs across the sides count. With a ``band`` the group is a bucket
    of that band, and pairs that share an earlier one of ``keys`` count there.
    """
    m = len(ids)
    size = np.bincount(row, minlength=m).astype(np.float64)
    values, column, df = np.unique(hsh, return_inverse=True, return_counts=True)
    keep = df[column] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((m, m), dtype=np.float32)
    names, column = np.unique(column, return_inverse=True)
    for lo in range(0, len(names), 2048):
        i, j = np.searchsorted(column, [lo, lo + 2048])
        tile = np.zeros((m, min(2048, len(names) - lo)), dtype=np.float32)
        tile[row[i:j], column[i:j] - lo] = 1
        shared += tile @ tile.T
    shared = shared.astype(np.float64)
    union = size[:, None] + size[None, :] - shared
    linked = shared / np.maximum(union, 1) >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if band > 0:
        i, j = np.nonzero(linked)
        met = np.zeros(len(i), dtype=bool)
        for t in range(band):
            met |= keys[i, t] == keys[j, t]
        linked[i[met], j[met]] = False
    links = linked.astype(np.int64) @ copies
    root = ids.copy()
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (lower == root).all():
            return links, root
        root = lower


def verify(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """``members`` (cell, cross, grp, band, block, node, copies, keys, text) -> (node, links, root), a row per document and group."""

    def of(cell: pa.Table) -> pa.Table:
        whole = lambda c: (lambda x: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x)(cell.column(c).combine_chunks())
        nodes, groups, bands, blocks, copies, cross = (whole(c).to_numpy(zero_copy_only=False) for c in ("node", "grp", "band", "block", "copies", "cross"))
        keys, text = whole("keys"), whole("text").cast(pa.string())
        at, values = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)
        rows, hashes = [], []
        for w in ta.blocks(text):
            r, h = ta.shingles(w, width)
            rows.append(r + w.first)
            hashes.append(h)
        row, hsh = ta.distinct_per_row(np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        first = np.searchsorted(row, np.arange(len(nodes) + 1))
        order = np.lexsort((nodes, groups, bands))
        cut = np.flatnonzero((np.diff(groups[order]) != 0) | (np.diff(bands[order]) != 0)) + 1
        found: list[tuple] = []
        for own in np.split(order, cut):
            if len(own) < 2:
                continue
            pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            local = np.repeat(np.arange(len(own)), [first[i + 1] - first[i] for i in own])
            side = (blocks[own] == blocks[own].max()).astype(np.int8) if cross[own[0]] else None
            band = int(bands[own[0]])
            shared = values[at[own][:, None] + np.arange(band)] if band > 0 else None
            links, root = compare(nodes[own], copies[own], local, hsh[pick], threshold, side, shared, band)
            got = links > 0
            found.append((nodes[own][got], links[got], root[got]))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ()))]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["node", "links", "root"])

    return members.groupBy("cell").applyInArrow(of, "node long, links long, root long")


def cut_up(rows: DataFrame, sizes: DataFrame, packs: int) -> DataFrame:
    """A row of ``rows`` (node, grp, band, keys, copies) for each other block of its group, with the cell where the two meet.

    ``sizes`` gives the blocks of each group; groups of one block are packed into ``packs`` cells.
    """
    return (
        rows.join(sizes, ["grp", "band"])
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node", "grp", "band", "block", "copies", "keys", (F.col("block") != F.col("other")).alias("cross"),
            F.when(F.col("blocks") == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64("grp", "band"), F.lit(packs))))
            .otherwise(F.concat_ws(":", "grp", "band", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
        )
    )


def placements(members: DataFrame, cell_rows: int, cell_words: int) -> DataFrame:
    """Where the texts of ``members`` (node, comp, n, copies, bands) are compared: (node, grp, band, block, copies, keys, cross, cell).

    ``grp`` is a component, with band -1, or a bucket of a large component for which buckets copy fewer texts.
    """
    blocks = lambda rows, words: F.greatest(F.ceil(rows / cell_rows), F.ceil(words / cell_words)).cast("int")
    packs = lambda words: max(1, math.ceil((words or 0) / cell_words))
    size = stored(
        members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("comp", "m", "s", blocks(F.col("m"), F.col("s")).alias("blocks")), "component-sizes"
    )
    none = F.array().cast("array<bigint>")
    as_whole = members.select("node", F.col("comp").alias("grp"), F.lit(-1).alias("band"), none.alias("keys"), "copies")
    whole = size.select(F.col("comp").alias("grp"), F.lit(-1).alias("band"), "blocks")
    words = packs(size.where("blocks = 1").agg(F.sum("s")).first()[0])
    large = size.where("blocks > 1")
    if large.isEmpty():
        return cut_up(as_whole, whole, words)
    each = members.join(large.select("comp"), "comp").select("node", "comp", "n", "copies", F.col("bands").alias("keys"), F.posexplode("bands").alias("band", "grp"))
    buckets = each.groupBy("comp", "band", "grp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").withColumn("blocks", blocks(F.col("m"), F.col("s")))
    buckets = stored(buckets, "bucket-sizes")
    cheaper = buckets.groupBy("comp").agg(F.sum(F.col("m") * F.col("blocks")).alias("copied")).join(large, "comp").where("copied < m * blocks").select("comp")
    cheaper = stored(cheaper, "components-by-bucket")
    split = buckets.join(cheaper, "comp", "left_semi")
    by_bucket = cut_up(each.drop("comp"), split.select("grp", "band", "blocks"), packs(split.where("blocks = 1").agg(F.sum("s")).first()[0]))
    kept = whole.join(cheaper.select(F.col("comp").alias("grp")), "grp", "left_anti")
    return cut_up(as_whole, kept, words).union(by_bucket.withColumn("cell", F.concat(F.lit("b"), "cell")))


def jaccard_rows(
    docs: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    most_hashes: int = 160,
    cell_rows: int = 1024,
    cell_words: int = 400_000,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(file, row, doc_id, class_id, n_links, kept) per row of ``docs(doc_id, text)``; file and row are those of ``common.numbered``.

    ``recall`` is the chance that a pair of exactly ``threshold`` becomes a candidate; it rises
    steeply above. ``cell_rows`` and ``cell_words`` bound a block, ``broadcast_rows`` the rows (three numbers each) whose names are sent to all
    tasks to find their texts; none changes a result.
    """
    bands, per_band = choose_bands(threshold, recall, most_hashes)
    wide, file, row = numbered(docs)
    rows = wide.select("doc_id", F.col(file).alias("file"), F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    sigs = stored(signatures(rows, width, bands, per_band), "ngram-signatures")
    first_row = [F.coalesce(F.min_by("file", "doc_id"), F.max("file")).alias("file"), F.coalesce(F.min_by("row", "doc_id"), F.max_by("row", "file")).alias("row")]
    keys = [F.min(F.col("bands")[i]).alias(f"b{i}") for i in range(bands)]  # equal within a class; numbers, so a hash aggregate holds them
    folded = sigs.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), *first_row, F.count("*").alias("copies"), F.min("n").alias("n"), *keys)
    # numbered where they are written, so the numbers stay
    classes = stored(
        folded.select("hi", "lo", "first", "file", "row", "copies", "n", F.array(*[f"b{i}" for i in range(bands)]).alias("bands"), F.monotonically_increasing_id().alias("node")), "ngram-classes"
    )
    keyed = classes.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub")
    near = components(keyed.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    roots = near.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    members = stored(near.union(roots).select("node", F.col("root").alias("comp")).join(classes.select("node", "file", "row", "n", "copies", "bands"), "node"), "ngram-candidates")
    placed = placements(members.drop("file", "row"), cell_rows, cell_words)
    wanted = members.select("file", "row", "node")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted.hint("shuffle_hash")
    texts = rows.select("file", "row", "text").join(wanted, ["file", "row"]).select("node", "text")
    found = checkpointed(verify(texts.join(placed.hint("shuffle_hash"), "node"), width, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_class = classes.drop("bands", "n").join(links, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = by_class.groupBy("root").agg(F.min("first").alias("class_id"), F.coalesce(F.min_by("node", "first"), F.min("node")).alias("keeper"))
    told = by_class.join(whole, "root").select(
        "hi", "lo", F.col("file").alias("first_file"), F.col("row").alias("first_row"), "class_id", (F.col("node") == F.col("keeper")).alias("keeps"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    kept = F.col("keeps") & (F.col("file") == F.col("first_file")) & (F.col("row") == F.col("first_row"))
    out = sigs.where("n > 0").select("file", "row", "doc_id", "hi", "lo").join(told, ["hi", "lo"]).select("file", "row", "doc_id", "class_id", "n_links", kept.alias("kept"))
    alone = sigs.where("n = 0").select("file", "row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.union(alone)


def jaccard_classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_links, kept) per row of ``docs(doc_id, text)``; see the module's text and ``jaccard_rows``."""
    return jaccard_rows(docs, **how).drop("file", "row")
