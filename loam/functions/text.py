"""Text, tag and path expressions; none of them leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blocks whose characters are words of their own.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
TOKEN = rf"[{CJK}]|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+"
#: Fixed value: a block of metadata between fences at the start of a file.
FRONT_MATTER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)"


#: Fixed value: the characters with Unicode's property White_Space.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; what lies between is not looked at."""
    return F.btrim(c, F.lit(SPACES))


def tokens(c: Column) -> Column:
    """Lexical tokens: each ideograph, and each run of other letters, digits and underscores, in lower case.

    The capital I with a dot becomes a plain i first: its lower case is two characters, the second of which would cut a token in two.
    """
    return F.regexp_extract_all(F.lower(F.translate(c, "\u0130", "i")), F.lit(TOKEN), F.lit(0))


def trimmed(items: Column) -> Column:
    """The items trimmed, blanks and nulls left out, in their order."""
    return F.filter(F.transform(items, strip), lambda t: t.isNotNull() & (t != ""))


def truncated(c: Column, most: int = 4000) -> Column:
    """The first ``most`` characters, for prompts that bound them."""
    return F.substring(c, 1, most)


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, without blanks, each once, in order."""
    clean = F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(clean))


def normalize_semantic_tags(tags: Column, most: int = 8, shortest: int = 2, longest: int = 32) -> Column:
    """The first ``most`` fit tags in their given order: no control characters, addresses, bare numbers or bare marks."""
    clean = F.transform(tags, lambda t: F.lower(strip(t)))
    fit = F.filter(
        clean,
        lambda t: F.length(t).between(shortest, longest)
        & ~t.rlike(r"\p{Cc}") & ~F.contains(t, F.lit("://")) & ~t.rlike(r"^\p{Nd}+$") & ~t.rlike(r"^[\p{P}\p{S}]+$"),
    )
    return F.slice(F.array_distinct(fit), 1, most)


def clean_tags(tags: Sequence[str]) -> list[str]:
    """What ``normalize_tags`` makes of a few tags that are at hand."""
    return sorted({re.sub(r"^\s+|\s+$", "", t).lower() for t in tags} - {""})


def has_all(tags: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, tags)) == 0


def under(path: Column, prefix: Column | str) -> Column:
    """Is ``path`` the prefix or below it? An empty prefix holds everything."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (p == "") | (path == p) | path.startswith(F.concat(p, F.lit("/")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it several times or within loops."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(text: Column, limit: Column | int, overlap: int, most: int | None = None) -> Column:
    """Pieces of up to ``limit`` characters that overlap, as an array; ``most`` bounds a limit that is a column.

    A piece that does not reach the end stops at the last white space of its second half, if there is any; the next one starts ``overlap`` before that, at the first
    character that is not white space. A fold over as many steps as there can be pieces: the text is cut into segments once, and a step looks at two of them, so
    the time is linear in the text.
    """
    most = max(most or 0, limit if isinstance(limit, int) else 0, 64)
    state, cut = "struct<begin:bigint,done:boolean,cuts:array<struct<begin:bigint,stop:bigint>>>", "struct<begin:bigint,stop:bigint>"

    def pieces(x: Column) -> Column:
        t, n, parts, lim = x["t"], x["n"], x["parts"], x["lim"]

        def sub(at: Column, size: Column | int) -> Column:
            i = (at / most).cast("bigint").cast("int")
            two = F.concat(F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit("")))
            return F.substring(two, (at - i * most + 1).cast("int"), F.lit(size).cast("int") if isinstance(size, int) else size.cast("int"))

        half = (lim / 2).cast("bigint")

        def stop(b: Column) -> Column:
            tail = sub(b + half + 1, lim - half - 1)
            found = lambda v: F.when(v.rlike(r"(?U)\s"), b + half + 1 + F.length(F.regexp_extract(v, r"(?sU)^(.*)\s", 1))).otherwise(b + lim)
            return F.when(b + lim >= n, n).otherwise(let(tail, found))

        def step(s: Column, _: Column) -> Column:
            def moved(lead: Column) -> Column:
                b = s["begin"] + lead
                grown = lambda e: F.struct(
                    F.when(e - overlap > b, e - overlap).otherwise(e).alias("begin"), (e >= n).alias("done"), F.concat(s["cuts"], F.array(F.struct(b.alias("begin"), e.alias("stop")).cast(cut))).alias("cuts")
                ).cast(state)
                skipped = F.struct(b.alias("begin"), F.lit(False).alias("done"), s["cuts"].alias("cuts")).cast(state)
                return F.when(lead >= most, skipped).otherwise(let(stop(b), grown))

            blanks = F.length(F.regexp_extract(sub(s["begin"], most), r"(?U)^\s*", 0)).cast("bigint")
            return F.when(s["done"], s).otherwise(let(blanks, moved))

        least = F.greatest(half + 1 - overlap, F.lit(1))
        steps = F.sequence(F.lit(1).cast("bigint"), F.ceil(n / least) + F.ceil(n / most) + 2)
        zero = F.struct(F.lit(0).cast("bigint").alias("begin"), F.lit(False).alias("done"), F.array().cast(f"array<{cut}>").alias("cuts")).cast(state)
        cuts = F.aggregate(steps, zero, step, lambda s: s["cuts"])
        every = F.transform(cuts, lambda c: strip(sub(c["begin"], c["stop"] - c["begin"])))
        return F.when((lim <= 0) | (n <= lim), F.array(t)).otherwise(F.filter(every, lambda p: p != ""))

    whole = strip(F.coalesce(text, F.lit("")))
    lim = (F.lit(limit) if isinstance(limit, int) else limit).cast("bigint")
    known = lambda t: F.struct(t.alias("t"), F.length(t).cast("bigint").alias("n"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)).alias("parts"), lim.alias("lim"))
    return let(whole, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(let(known(t), pieces)))


def preview(c: Column, width: int = 120) -> Column:
    """White space made single; beyond ``width`` characters the last one kept is an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(one) > width, F.concat(F.substring(one, 1, width - 1), F.lit("…"))).otherwise(one)


def titled(titles: Column, body: Column) -> Column:
    """The chunk text: titles joined by `` > ``, an empty line, the body; either alone if the other is blank."""
    title = F.array_join(F.filter(F.transform(titles, strip), lambda t: t != ""), " > ")
    text = strip(body)
    return F.when(title == "", text).when(text == "", title).otherwise(F.concat(title, F.lit("\n\n"), text))


def normalize_path(c: Column) -> Column:
    """Slashes forward, ``.`` and empty parts out, ``..`` applied; Windows-like paths in lower case; ``.`` becomes empty."""
    trimmed = strip(c)
    slashed = F.replace(trimmed, F.lit("\\"), F.lit("/"))
    rooted = slashed.startswith("/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return (
            F.when(p != "..", F.concat(done, F.array(p)))
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(rooted, done)
            .otherwise(F.concat(done, F.array(p)))
        )

    body = F.array_join(F.aggregate(parts, empty, step), "/")
    clean = F.when(rooted, F.concat(F.lit("/"), body)).otherwise(body)
    windows = clean.rlike(r"^[A-Za-z]:") | F.contains(trimmed, F.lit("\\"))
    return F.when(windows, F.lower(clean)).otherwise(clean)


def canonical_map(m: Column) -> Column:
    """``{k=v,…}`` with the keys in order."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def tsv_line(fields: Sequence[Column]) -> Column:
    return F.concat_ws("\t", *[F.translate(f.cast("string"), "\t\r\n", "   ") for f in fields])


def tsv_record(fields: Sequence[Column]) -> Column:
    """A NUL-ended record that keeps line feeds: tabs become spaces, NULs go."""
    return F.concat(F.concat_ws("\t", *[F.replace(F.replace(f.cast("string"), F.lit("\t"), F.lit(" ")), F.lit("\u0000"), F.lit("")) for f in fields]), F.lit("\u0000"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.35, "medium").otherwise("low")
