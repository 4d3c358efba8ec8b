"""Offset-mapped token counts: a document is encoded once, its tokens are then dealt to its sections.

Encoding sections one by one would count other tokens than training sees. Here the whole text is encoded,
each token's character span is found, and spans are joined with the sections' intervals, both in order, within the
document's row: nothing is exploded or shuffled. A token that crosses a boundary goes to one section by ``rule``:

``most``   the section that holds most of its characters, the earlier one on a tie;
``start``  the section that holds its first character.

Tokens outside all sections belong to none. Sections are spans (name, start, end) in code points, in order and apart; without
any they are the text's lines, each with its line feed.

Defined cases: a null or empty text has one empty section, 0, with no tokens (with spans given: each span with none);
null ids and repeated rows are counted like others; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer as tk
from .common import as_table


def owners(start: np.ndarray, end: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token span, the index of the section that owns it (-1: none), and whether it crosses sections."""
    first = np.searchsorted(stop, start, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(begin, end, side="left") - 1  # the last one that begins before the token ends
    owner = np.where(first <= last, first, -1)
    crosses = last > first
    if rule == "start":
        inside = (first < len(begin)) & (start >= begin[np.minimum(first, len(begin) - 1)])
        return np.where(inside, first, -1), crosses
    for i in np.flatnonzero(crosses):
        s = np.arange(first[i], last[i] + 1)
        held = np.minimum(stop[s], end[i]) - np.maximum(begin[s], start[i])
        owner[i] = s[np.argmax(held)]
    return owner, crosses


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    cut = np.flatnonzero(code == 10) + 1
    begin = np.concatenate([[0], cut[cut < len(code)]])
    return begin, np.concatenate([begin[1:], [len(code)]])


def token_counts(docs: DataFrame, spans: str | None = None, rule: str = "most", vocabulary: str = tk.VOCABULARY) -> DataFrame:
    """(doc_id, section, name, start, end, n_tokens, n_crossing, doc_tokens), a row per document and section.

    ``spans`` names a column array<struct<name,start,end>> of ``docs``; ``n_crossing`` counts the owned tokens that
    reach into another section.
    """
    if rule not in ("most", "start"):
        raise ValueError(rule)
    shared = docs.sparkSession.sparkContext.broadcast(tk.vocabulary(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        tok = tk.build(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), as_table(batch, "text")
            given = batch.column(2) if spans else None
            out: list[list] = [[] for _ in range(8)]

            def flush():
                got = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out[0], out[1], *out[3:8])]
                done = pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(got[0].astype(np.int64))), pa.array(got[1].astype(np.int32)), pa.array([x for c in out[2] for x in c], pa.string()), *(pa.array(c.astype(np.int64)) for c in got[2:])],
                    names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
                )
                for c in out:
                    c.clear()
                return done

            held = 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if given is not None:
                    own = given[i].as_py() or []
                    begin, stop = (np.array([s[k] for s in own], dtype=np.int64) for k in ("start", "end"))
                    names = [s["name"] for s in own]
                else:
                    begin, stop = line_bounds(text) if text else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                    names = [None] * len(begin)
                start, end = tok.spans(text) if text else (np.zeros(0, np.int64),) * 2
                owner, crosses = owners(start, end, begin, stop, rule) if len(begin) else (np.full(len(start), -1), np.zeros(len(start), bool))
                mine = owner >= 0
                n = len(begin)
                for c, x in zip(out, (np.full(n, i), np.arange(n), names, begin, stop, np.bincount(owner[mine], minlength=n), np.bincount(owner[mine & crosses], minlength=n), np.full(n, len(start))), strict=True):
                    c.append(x)
                held += n
                if held > 50_000:
                    yield flush()
                    held = 0
            yield flush()

    columns = [F.col("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(spans)] if spans else [])]
    return docs.select(*columns).mapInArrow(of, f"doc_id {kind}, section int, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
