"""Benchmark decontamination by template canonicalisation.

Both sides are read in the forms of ``FORMS``: as plain lower-cased words, and as templates in which numbers, units and
names give way to typed placeholders. Windows of ``window`` tokens of a form are joined on their hash. Matched windows
of one document, item and form that lie on one diagonal are counted together, then with those of neighbouring diagonals, and
the slots they fill are held against each other: a slot value of the item must stand for one value of the document throughout, so a
question asked again with other numbers or names matches and a chance likeness of templates does not.

A number is digits with the separators and the sign between and before them, or a run of ``NUMBER_WORDS``; a unit is a word of ``UNITS`` after a number, also where it touches
its digits; a name is a run of capitalised words. ``PLAIN`` has no slots, so neither case nor numbers keep a copy from being found, ``NUMBERS`` has no
names; ``NAMES`` has each word as a token of its own. A capitalised word that opens a sentence is a name in ``KNOWN`` if it also stands
inside one in that text, and always in ``OPENERS``. Windows with under half their tokens literal say nothing and are left out.

Tasks drop the windows that no item has by a table of hashes, up to ``broadcast_windows``, or by a bitmap of bounded size, beyond it; what is
left is written once. A document and an item that share ``coverage`` of the item's windows share one of the rest and one more, so they are
paired by the item's rarest windows only: one that very many items have pairs no document with all of them. Items of fewer than
``window`` tokens are one window of their own length; items under ``shortest`` words match where they are a whole line or sentence, or some in a row, word for word (``SHORT``).

Defined cases: null and empty texts on either side match nothing; null ids are carried as they are; items of different ids match each, a repeated
item once; every row of the documents is one of its own, also where ids repeat or are null; other columns are passed over; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import as_table, checkpointed, giving_back, numbered, stored

#: Words that are units when they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mile", "miles", "g", "kg", "mg", "lb", "lbs", "oz", "pounds", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "meter", "meters", "metre", "metres",
    "degrees", "kmh", "mph", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "v", "w", "kw", "j", "kj", "n", "pa",
)
#: Words that are numbers.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
NUMBER, NAME, UNIT, SIGN = (np.uint64(x) for x in (0xA11CE00000000001, 0xB0B0000000000002, 0xC0DE000000000003, 0x5161000000000004))
#: The readings of a text, each matched with its like on the other side.
PLAIN, NUMBERS, NAMES, RUNS, KNOWN, OPENERS, SHORT = FORMS = range(7)


def _bytes(chars: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[[ord(c) for c in chars]] = True
    return found


_STOP, _DIGIT, _SEPARATOR, _LINK = _bytes(".!?:\n"), _bytes("0123456789"), _bytes(".,/'"), _bytes(" -'")
_known_words: dict[tuple, np.ndarray] = {}


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    if words not in _known_words:
        _known_words[words] = np.sort(next(ta.blocks(pa.array([" ".join(words)]))).hashes())
    return _known_words[words]


def _apart(w: ta.Words, digits: np.ndarray) -> ta.Words:
    """The words with units that touch a number cut off it."""
    n = digits[w.end] - digits[w.start]
    mixed = np.flatnonzero((n > 0) & (n < w.end - w.start))
    mid = w.start[mixed] + n[mixed]
    leads = digits[mid] - digits[w.start[mixed]] == n[mixed]
    mixed, mid = mixed[leads], mid[leads]
    unit = np.isin(w.hash_range(mid, w.end[mixed]), _hashes_of(UNITS)) if len(mixed) else np.zeros(0, bool)
    mixed, mid = mixed[unit], mid[unit]
    if not len(mixed):
        return w
    end = w.end.copy()
    end[mixed] = mid
    row = np.insert(w.row, mixed + 1, w.row[mixed])
    return replace(w, row=row, start=np.insert(w.start, mixed + 1, mid), end=np.insert(end, mixed + 1, w.end[mixed]), counts=np.bincount(row, minlength=w.rows))


@dataclass
class Template:
    """One reading of a block: of each token its row, hash, whether it is a slot, what fills it, and its words."""

    row: np.ndarray
    hash: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    words: np.ndarray
    counts: np.ndarray  # tokens per row
    opens: np.ndarray | None = None  # does a line or sentence begin there? Only of SHORT


def _capitals(raw: bytes, low: bytes, at: np.ndarray) -> np.ndarray:
    """Is the character at each byte offset of ``low`` another one in ``raw``? Lower-casing keeps the number of characters."""
    changed = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32) != np.frombuffer(low.decode().encode("utf-32-le"), np.uint32)
    lead = (np.frombuffer(low, np.uint8) & 0xC0) != 0x80
    return changed[np.cumsum(lead)[at] - 1]


def templates(col: pa.Array, forms: list[int]):
    """Blocks of (words, {form: its Template})."""
    col = pc.fill_null(col, "")
    for w in ta.blocks(col, 1 << 18):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
        w = _apart(w, digits)
        own = w.hashes()
        n = len(own)
        if not n:
            continue
        none, one = np.zeros(n, dtype=bool), np.ones(n, dtype=np.int64)
        out = {PLAIN: Template(w.row, own, none, own, one, w.counts)}
        if forms != [PLAIN]:
            follows = none.copy()
            follows[1:] = w.row[1:] == w.row[:-1]
            figure = digits[w.end] - digits[w.start] == w.end - w.start
            said = np.isin(own, _hashes_of(NUMBER_WORDS))
            number = figure | said
            after = follows.copy()
            after[1:] &= number[:-1]
            unit = after & ~number & np.isin(own, _hashes_of(UNITS))
            ahead = w.data[w.start - 1]  # what stands before a word; looked at only where something does
            more = after & figure & _SEPARATOR[ahead]
            more[1:] &= (w.start[1:] - w.end[:-1] == 1) & figure[:-1]
            begins = w.offsets[w.row]
            sign = figure & (w.start > begins) & (ahead == ord("-")) & ((w.start - 1 == begins) | ~ta.IS_WORD[w.data[w.start - 2]])
            part = col.slice(w.first, w.rows)
            at = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1]
            capital = _capitals(part.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes(), w.data.tobytes(), w.start) & ~number
            stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
            opens = ~follows
            opens[1:] |= stops[w.start[1:]] > stops[w.end[:-1]]
            apart = np.concatenate([[0], np.cumsum(~_LINK[w.data])])
            linked = follows.copy()
            linked[1:] &= apart[w.start[1:]] == apart[w.end[:-1]]
            words_on = linked & number
            words_on[1:] &= number[:-1] & (said[1:] | said[:-1])
            more |= words_on
            if SHORT in forms:
                out[SHORT] = Template(w.row, own, none, own, one, w.counts, opens)
            with np.errstate(over="ignore"):
                mine = own + w.row.astype(np.uint64) * ta.P
            value = np.where(sign, own ^ SIGN, own)
        for f in forms:
            if f in (PLAIN, SHORT):
                continue
            name = none if f == NUMBERS else capital if f == OPENERS else capital & ~opens
            if f == KNOWN:
                name = name | (capital & opens & np.isin(mine, mine[name]))
            if f != NAMES:
                name = name & ~unit
            slot = number | unit | name
            form = own.copy()
            form[number], form[unit], form[name] = NUMBER, UNIT, NAME
            if f == NAMES:
                out[f] = Template(w.row, form, slot, own, one, w.counts)
                continue
            runs = linked & name
            runs[1:] &= name[:-1]
            runs |= more
            first = np.flatnonzero(~runs)
            filled = value[first]
            rest = np.flatnonzero(runs)
            if len(rest):
                token = np.searchsorted(first, rest, side="right") - 1
                with np.errstate(over="ignore"):
                    np.add.at(filled, token, ta.mix(own[rest] + (rest - first[token]).astype(np.uint64) * ta.P))
            row = w.row[first]
            out[f] = Template(row, form[first], slot[first], filled, np.diff(np.append(first, n)), np.bincount(row, minlength=w.rows))
        yield w, {f: out[f] for f in forms}


def windows(t: Template, form: int, widths: list[int]):
    """(width, first token, hash) of the windows of each width that lie in one row and are literal in half their tokens at least."""
    filled = np.concatenate([[0], np.cumsum(t.slot)])
    acc = np.full(len(t.hash), form + 1, dtype=np.uint64)
    for k in range(max(widths)):
        n = len(t.hash) - k
        if n <= 0:
            return
        with np.errstate(over="ignore"):
            acc = acc[:n] * ta.P + t.hash[k:]
        if k + 1 in widths:
            at = np.flatnonzero((t.row[:n] == t.row[k:]) & (2 * (filled[k + 1 :] - filled[:n]) <= k + 1))
            with np.errstate(over="ignore"):
                yield k + 1, at, ta.mix(acc[at] + np.uint64(k + 1))


MOST_BITS = 27


@dataclass
class Known:
    """The hashes that are looked for: a bitmap of their low bits and, where they are few, themselves in order."""

    bits: np.ndarray
    hashes: np.ndarray | None

    def has(self, h: np.ndarray) -> np.ndarray:
        low = h & np.uint64(8 * len(self.bits) - 1)
        got = (self.bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
        if self.hashes is not None:
            at = np.flatnonzero(got)
            near = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            got[at] = self.hashes[near] == h[at]
        return got


def known_windows(own: DataFrame, most: int) -> Known:
    """What ``own(win)`` holds, as a bitmap of 2**MOST_BITS bits at most, and as a list of up to ``most``."""
    n = own.count()
    size = min(MOST_BITS, max(20, (16 * n).bit_length()))
    place = F.col("win").bitwiseAND(F.lit((1 << size) - 1))
    words = own.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((win & {(1 << size) - 1}L) & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros((1 << size) // 64, dtype=np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    hashes = np.unique(own.select("win").toArrow().column(0).to_numpy().view(np.uint64)) if 0 < n <= most else None
    return Known(bits.view(np.uint8), hashes)


def window_rows(rows: DataFrame, keys: list[str], widths: dict[int, list[int]], shortest: int | None, known: Known | None) -> DataFrame:
    """(*keys, form, width, win, pos, slots) per window of ``rows(*keys, text)``, of those in ``known``, if given.

    With ``shortest`` the rows are items: of at least so many words, with windows under the largest width only where they
    are the whole item and half its words are literal; a form that makes no slot of an item says what PLAIN says, and is left out. Shorter items are one window of SHORT,
    which in documents begins and ends with a line or sentence.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def of(batches):
        known = shared.value
        for batch in batches:
            ids = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            for w, found in templates(as_table(batch, "text"), sorted(widths)):
                for form, t in found.items():
                    begin = np.cumsum(t.counts) - t.counts
                    slots = np.bincount(t.row, weights=t.slot, minlength=w.rows)
                    bare = w.counts - np.bincount(t.row, weights=t.words * t.slot, minlength=w.rows)
                    for width, at, h in windows(t, form, widths[form]):
                        if form == SHORT:
                            r, stop = t.row[at], at + width
                            ends = stop == (begin + t.counts)[r]
                            ends[~ends] = t.opens[stop[~ends]]
                            ok = (t.counts[r] == width) & (width < shortest) if shortest is not None else t.opens[at] & ends
                            at, h = at[ok], h[ok]
                        elif shortest is not None:
                            r = t.row[at]
                            ok = (w.counts[r] >= shortest) & ((form == PLAIN) | (slots[r] > 0))
                            if width < max(widths[form]):
                                ok &= (t.counts[r] == width) & (2 * bare[r] >= w.counts[r])
                            at, h = at[ok], h[ok]
                        if known is not None:
                            ok = known.has(h)
                            at, h = at[ok], h[ok]
                        if not len(at):
                            continue
                        places = at[:, None] + np.arange(width)
                        filled = t.slot[places]
                        offsets = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
                        own = pa.array(w.first + t.row[at])
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(c.take(own) for c in ids), pa.array(np.full(len(at), form, np.int32)), pa.array(np.full(len(at), width, np.int32)),
                                pa.array(h.view(np.int64)), pa.array(at - begin[t.row[at]]),
                                pa.ListArray.from_arrays(pa.array(offsets), pa.array(t.value[places[filled]].view(np.int64))),
                            ],
                            names=[*keys, "form", "width", "win", "pos", "slots"],
                        )

    return rows.mapInArrow(giving_back(of), f"{kinds}, form int, width int, win long, pos long, slots array<long>")


def contaminated_rows(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, shortest: int = 5, coverage: float = 0.5, broadcast_windows: int = 500_000, reach: int = 8
) -> DataFrame:
    """(file, row, doc_id, item_id, n_windows, coverage, same_slots) for every row of ``docs`` that holds an item's template.

    ``coverage`` is the least share of the item's windows, in the form that matches best, that one diagonal must match together
    with those at most ``reach`` from it whose slots agree; ``same_slots`` tells a copy from a re-parameterised one. File and row are those
    of ``common.numbered``.
    """
    texts, file, row = numbered(docs)
    texts = texts.select("doc_id", F.col(file).alias("file"), F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    # numbered where they are written, so the numbers stay
    items = stored(benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    every = window_rows(items, ["item"], {f: list(range(1, window + 1)) for f in FORMS}, shortest, None)
    every = checkpointed(every.select("item", "form", "width", "win", F.col("pos").alias("at"), F.col("slots").alias("asked")))
    widths: dict[int, list[int]] = {}
    for form, width in every.select("form", "width").distinct().collect():  # FORMS by `window` rows at most
        widths.setdefault(form, []).append(width)
    spread = every.groupBy("win").agg(F.count_distinct("item").alias("items"))
    mine = Window.partitionBy("item", "form")
    own = every.drop("width").join(spread, "win").withColumn("size", F.count("*").over(mine)).withColumn("nth", F.row_number().over(mine.orderBy("items", "at")))
    own = stored(own.withColumn("lead", F.col("nth") <= F.col("size") - F.ceil(F.col("size") * coverage) + 1).drop("nth", "items"), "benchmark-windows")
    known = known_windows(own, broadcast_windows)
    few = F.broadcast if known.hashes is not None else lambda df: df
    name = ["file", "row", "doc_id"]
    found = stored(window_rows(texts, ["doc_id", "file", "row"], widths or {PLAIN: [window]}, None, known).select(*name, "win", "pos", "slots"), "matched-windows")
    likely = found.join(few(own.where("lead").select("win", "item", "form")), "win").select("file", "row", "item", "form").distinct()
    needed = likely.join(few(own.drop("lead")), ["item", "form"])
    pairs = found.join(needed, ["file", "row", "win"]).select(
        *name, "item", "form", "size", "at", (F.col("pos") - F.col("at")).alias("diagonal"),
        F.arrays_zip(F.col("asked").alias("asked"), F.col("slots").alias("got")).alias("fills"),
    )
    # one row per item, form, document and diagonal: an item's windows bound the sets
    runs = pairs.groupBy(*name, "item", "form", "size", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("fills"))).alias("fills")
    ).where(_steady(F.col("fills")))
    # every diagonal takes the windows of its neighbours, nearest first, as long as their slots agree
    around = Window.partitionBy(*name, "item", "form").orderBy("diagonal").rangeBetween(-reach, reach)
    near = runs.withColumn("near", F.collect_list(F.struct("diagonal", "ats", "fills")).over(around))
    nearest = F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x["diagonal"] - F.col("diagonal")).alias("off"), x["diagonal"].alias("diagonal"), x["ats"].alias("ats"), x["fills"].alias("fills"))))

    def take(held, x):
        both = F.array_union(held["fills"], x["fills"])
        return F.when(_steady(both), F.struct(F.array_union(held["ats"], x["ats"]).alias("ats"), both.alias("fills"))).otherwise(held)

    all_of = F.when(F.size("near") == 1, F.struct("ats", "fills")).otherwise(F.aggregate(nearest, F.struct("ats", "fills"), take))
    share = near.select(*name, "item", "form", "size", all_of.alias("held")).select(
        *name, "item", F.size("held.ats").cast("long").alias("n_windows"), F.forall("held.fills", lambda x: x["asked"] == x["got"]).alias("same_slots"),
        (F.size("held.ats") / F.col("size")).alias("coverage"),
    ).where(F.col("coverage") >= coverage)
    named = share.join(items.select("item", "item_id"), "item")
    best = named.groupBy(*name, "item_id").agg(F.max(F.struct("coverage", "same_slots", "n_windows")).alias("best"))
    return best.select(*name, "item_id", "best.n_windows", "best.coverage", "best.same_slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, same_slots) for every document that holds an item's template; see ``contaminated_rows``."""
    return contaminated_rows(docs, benchmark, **how).drop("file", "row")


def _steady(fills: Column) -> Column:
    """Does each slot value of the item stand for one value of the document?"""
    return F.size(F.array_distinct(F.transform(fills, lambda x: x["asked"]))) == F.size(fills)
