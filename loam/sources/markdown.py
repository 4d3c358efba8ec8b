"""Markdown to chunks: front matter, headings, blocks, and windows over long blocks.

The block parser knows headings (# and underlined), paragraphs, fenced and indented code, block quotes, lists (nested ones
approximately), HTML blocks, rules and pipe tables; inline it knows code, links and images and takes emphasis marks away.
Definition lists, footnotes and mathematics are plain paragraphs.

Python reads the front matter and says which lines make which block. All else is a plan: the blocks of long files are exploded, a running minimum over a file's headings
gives their depths and so the path of titles, sections are packed by a fold over their blocks' lengths, long blocks are cut by ``text.windows``, and
identities are hashes of columns. Files are shuffled once, by the file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import hashing as hx
from loam.functions import text as tx
from loam.functions.text import FRONT_MATTER

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"^( {0,3})(?:([-*+])|(\d{1,9})[.)])[ \t]+(.*)$")
CELLS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
MARKS = re.compile(r"[*_~`\[]")


class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Booleans are ``true`` and ``false`` only, and dates stay text."""


Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in found if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")]
    for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def metadata(front: str) -> dict:
    """What a front matter says; raises ValueError where it is not a mapping with text keys."""
    try:
        found = yaml.load(front, Loader) if front.strip() else {}
    except yaml.YAMLError as e:
        raise ValueError(f"invalid front matter: {e}") from e
    found = {} if found is None else found
    if not isinstance(found, dict) or any(not isinstance(k, str) for k in found):
        raise ValueError("invalid front matter: a mapping with text keys is needed")
    return found


def title_and_tags(found: dict) -> tuple[str, list[str]]:
    title, tags = found.get("title", ""), found.get("tags", [])
    if not isinstance(title, str):
        raise ValueError("title must be text")
    tags = [tags] if isinstance(tags, str) else tags or []
    if not isinstance(tags, list) or any(not isinstance(t, str) for t in tags):
        raise ValueError("tags must be text or a list of texts")
    return title.strip(), sorted({t.strip().lower() for t in tags} - {""})


def inline(s: str) -> str:
    if not MARKS.search(s):
        return s.strip()
    s = re.sub(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)", lambda m: m.group(1).strip() or m.group(2), s)

    def link(m: re.Match) -> str:
        label, to = m.group(1).strip(), m.group(2).strip()
        return to if not label else label if not to or to == label else f"{label} <{to}>"

    s = re.sub(r"\[([^\]]*)\]\(([^)\s]*)[^)]*\)", link, s)
    parts = re.split(r"(`+[^`]*`+)", s)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", parts[i], flags=re.S)
        parts[i] = re.sub(r"(?<![\w*])([*_])(?=\S)([^*_]+?)(?<=\S)\1(?![\w*])", r"\2", parts[i])
    return "".join(parts).strip()


def blocks(text: str) -> list[tuple[int, str]]:
    """(heading level or 0, rendered text) of each block in order."""
    lines, out, i = text.split("\n"), [], 0
    para: list[str] = []

    def flush() -> None:
        if para:
            out.append((0, inline("\n".join(x.strip() for x in para))))
            para.clear()

    while i < len(lines):
        line = lines[i]
        if m := FENCE.match(line):
            flush()
            body, i = [], i + 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append((0, "```" + m.group(2).strip() + "\n" + "\n".join(body).rstrip("\n") + "\n```"))
        elif m := ATX.match(line):
            flush()
            out.append((len(m.group(1)), inline(m.group(2) or "") or "(untitled)"))
        elif para and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line):
            title, level = inline(" ".join(para)), 1 if "=" in line else 2
            para.clear()
            out.append((level, title or "(untitled)"))
        elif RULE.match(line):
            flush()
            out.append((0, "---"))
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            flush()
            body = []
            while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or body):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            i -= 1
            inner = [t for _, t in blocks("\n".join(body)) if t]
            out.append((0, "\n\n".join("\n".join(f"> {x}" for x in t.split("\n")) for t in inner)))
        elif not para and (m := ITEM.match(line)):
            ordered, items = m.group(3) is not None, []
            while i < len(lines):
                if (m := ITEM.match(lines[i])) and (m.group(3) is not None) == ordered:
                    items.append([m.group(4)])
                elif lines[i].startswith(("  ", "\t")) and lines[i].strip():
                    items[-1].append(re.sub(r"^(?: {2,4}|\t)", "", lines[i]))
                elif lines[i].strip() or i + 1 >= len(lines) or not (ITEM.match(lines[i + 1]) or lines[i + 1].startswith("  ")):
                    break
                else:
                    items[-1].append("")
                i += 1
            i -= 1
            shown = []
            for n, item in enumerate(items, 1):
                body = "\n".join(t for _, t in blocks("\n".join(item)) if t).strip()
                if body:
                    mark = f"{n}. " if ordered else "- "
                    shown.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            out.append((0, "\n".join(shown)))
        elif not para and re.match(r"^(?: {4}|\t)\S", line):
            body = []
            while i < len(lines) and (re.match(r"^(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                body.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                i += 1
            i -= 1
            out.append((0, "```\n" + "\n".join(body).rstrip("\n") + "\n```"))
        elif not para and re.match(r"^ {0,3}<[A-Za-z/!]", line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append((0, "\n".join(body).strip()))
        elif not para and "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and CELLS.match(lines[i + 1]):
            rows = [line]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(lines[i])
                i += 1
            i -= 1
            out.append((0, "\n".join(" | ".join(inline(c) for c in r.strip().strip("|").split("|")) for r in rows)))
        elif not line.strip():
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return [(level, t) for level, t in out if t]


@dataclass(frozen=True)
class Splitter:
    most: int = 1200
    overlap: int = 120
    short_file: int = 4000

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Splitter:
        """From options in text: whole numbers above 0, and an overlap that is less than the size of a chunk."""
        fields = {"max_chunk_chars": "most", "overlap_chars": "overlap", "short_file_max_chars": "short_file"}
        given = {}
        for name, value in options.items():
            if name not in fields:
                raise ValueError(f"unknown option {name!r}; known: {sorted(fields)}")
            if not re.fullmatch(r"\s*\+?\d+\s*", str(value)) or int(value) <= 0:
                raise ValueError(f"{name} must be a whole number above 0, not {value!r}")
            given[fields[name]] = int(value)
        made = cls(**given)
        if made.overlap >= made.most:
            raise ValueError("overlap_chars must be less than max_chunk_chars")
        return made

    def recipe_hash(self) -> str:
        options = {"short_file_max_chars": self.short_file}
        if self.most != 1200:
            options["max_chunk_chars"] = self.most
        if self.overlap != 120:
            options["overlap_chars"] = self.overlap
        return hx.splitter_hash(options=options)


CHUNKS = (
    "rel_path string, file_hash string, title string, tags array<string>, yaml string, chunk_index int, title_path array<string>, content string, "
    "recipe_hash string, section_fingerprint string, chunk_id string, error string"
)


def front_of(fronts: pa.Array) -> pa.Array:
    """What the front matter of files says; null is none."""
    rows = []
    for front in fronts.to_pylist():
        try:
            found = metadata(front) if front is not None else {}
            title, tags = title_and_tags(found)
            rows.append({"error": None, "title": title, "tags": tags, "yaml": json.dumps(found, default=str, sort_keys=True)})
        except ValueError as e:
            rows.append({"error": str(e), "title": None, "tags": None, "yaml": None})
    kind = pa.struct([("error", pa.string()), ("title", pa.string()), ("tags", pa.list_(pa.string())), ("yaml", pa.string())])
    return pa.array(rows, kind)


def blocks_of(texts: pa.Array) -> pa.Array:
    """The blocks of texts; null is none."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))
    return pa.array([None if t is None else [{"level": n, "text": b} for n, x in blocks(t) if (b := x.strip())] for t in texts.to_pylist()], kind)


def packed(lengths: Column, lead: Column, most: int) -> Column:
    """Runs (start, size, over) of blocks in order: as many as fit behind ``lead`` characters of titles, with an empty line between them; one that is too long alone is ``over``."""
    kind = "struct<held:int,runs:array<struct<start:int,size:int,over:boolean>>>"
    none = F.struct(F.lit(-1).alias("held"), F.array().cast("array<struct<start:int,size:int,over:boolean>>").alias("runs")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        n, i, runs = x["n"], x["i"], s["runs"]
        joined = s["held"] + 2 + n
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), (last["size"] + 1).alias("size"), F.lit(False).alias("over"))))
        over = lead + n > most
        new = F.concat(runs, F.array(F.struct(i.alias("start"), F.lit(1).alias("size"), over.alias("over"))))
        fits = (s["held"] >= 0) & (lead + joined <= most)
        return F.when(fits, F.struct(joined.alias("held"), longer.alias("runs")).cast(kind)).otherwise(F.struct(F.when(over, -1).otherwise(n).alias("held"), new.alias("runs")).cast(kind))

    numbered = F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.aggregate(numbered, none, step, lambda s: s["runs"])


def pieces(titles: Column, bodies: Column, splitter: Splitter) -> Column:
    """The contents of a section: whole if it fits, else its blocks packed, and long ones cut."""
    prefix = F.length(tx.titled(titles, F.lit("")))
    lead = F.when(prefix > 0, prefix + 2).otherwise(F.lit(0))

    def cut(x: Column) -> Column:
        lead, bodies = x["lead"], x["bodies"]
        room = splitter.most - lead
        own = F.when(room > 0, room).otherwise(F.lit(splitter.most))
        joined = lambda r: F.array_join(F.slice(bodies, r["start"] + 1, r["size"]), "\n\n")
        runs = packed(F.transform(bodies, F.length), lead, splitter.most)
        return F.flatten(F.transform(runs, lambda r: F.when(r["over"], tx.windows(F.get(bodies, r["start"]), own, splitter.overlap, splitter.most)).otherwise(F.array(joined(r)))))

    whole = tx.titled(titles, F.array_join(bodies, "\n\n"))
    fits = F.length(whole) <= splitter.most
    parts = F.transform(tx.let(F.struct(lead.alias("lead"), bodies.alias("bodies")), cut), lambda p: tx.titled(titles, p))
    return F.filter(F.when(fits, F.array(whole)).otherwise(parts), lambda p: p != "")


def chunks(files: DataFrame, splitter: Splitter = Splitter(), keep: Sequence[str] = ()) -> DataFrame:
    """``files(rel_path, content, *keep)`` -> rows of ``CHUNKS`` with the columns ``keep``. A file that fails is one row with its error and no chunk.

    ``file_hash`` is the one that ``files`` has, if it has one, else that of the content.
    """
    content = F.coalesce("content", F.lit(""))
    fenced = content.rlike(FRONT_MATTER)
    body = F.when(fenced, F.regexp_replace(F.regexp_replace(content, FRONT_MATTER, ""), r"^[\r\n]+", "")).otherwise(content)
    own_hash = F.col("file_hash") if "file_hash" in files.columns else hx.file_hash(content)
    read = files.select(
        "rel_path", *keep, own_hash.alias("file_hash"), F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\r", "\n").alias("text"), F.when(fenced, F.regexp_extract(content, FRONT_MATTER, 1)).alias("front")
    ).withColumn("front", F.arrow_udf(front_of, "error string, title string, tags array<string>, yaml string")("front"))
    base = F.when(F.coalesce(F.col("front.title"), F.lit("")) != "", F.array("front.title")).otherwise(F.array().cast("array<string>"))
    read = read.withColumn("base", base)
    whole = tx.titled(F.col("base"), F.col("text"))
    read = read.withColumn("short", F.when(F.col("front.error").isNull() & (whole != "") & (F.length(whole) <= splitter.short_file), whole))
    long_text = F.when(F.col("front.error").isNull() & F.col("short").isNull(), F.col("text"))
    about = F.struct("rel_path", *keep, "file_hash", "front", "base", "short").alias("file")
    rows = read.select(about, F.monotonically_increasing_id().alias("id"), F.arrow_udf(blocks_of, "array<struct<level:int,text:string>>")(long_text).alias("blocks")).select("id", "file", F.posexplode_outer("blocks").alias("pos", "block"))
    # headings: a depth is at most one more than the last one's, so it is a running minimum
    w = W.partitionBy("id").orderBy("pos")
    heading = F.col("block.level") > 0
    rows = rows.withColumn("heading", F.coalesce(heading, F.lit(False))).withColumn("section", F.count_if("heading").over(w).cast("int"))
    rows = rows.withColumn("depth", F.col("section") + F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("heading"), F.col("block.level") - F.col("section"))).over(w), F.lit(0))))
    ancestors = F.array(*[F.last(F.when(F.col("heading") & (F.col("depth") == d), F.col("block.text")), ignorenulls=True).over(w) for d in range(1, 7)])
    rows = rows.withColumns({"titles": F.slice(ancestors, 1, F.col("depth")), "sections": F.max("section").over(W.partitionBy("id"))})
    said = rows.groupBy("id", "section").agg(
        F.first("file").alias("file"), F.first("titles").alias("titles"), (F.first("sections") == F.col("section")).alias("ends"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading") & F.col("block").isNotNull(), F.struct("pos", "block.text")))), lambda b: b["text"]).alias("bodies"),
    )
    kept = said.where((F.size("bodies") > 0) | F.col("ends")).select("id", "section", "file", F.concat("file.base", "titles").alias("titles"), "bodies")
    made = kept.withColumn("contents", F.when(F.col("file.short").isNotNull(), F.array("file.short")).when(F.col("file.front.error").isNull(), pieces(F.col("titles"), F.col("bodies"), splitter)))
    failed = F.col("file.front.error").isNotNull()
    each = made.where(failed | (F.size("contents") > 0)).select("id", "section", "file", "titles", F.posexplode_outer("contents").alias("part", "content"))
    each = each.withColumn("chunk_index", (F.row_number().over(W.partitionBy("id").orderBy("section", "part")) - 1).cast("int"))
    recipe = F.lit(splitter.recipe_hash())
    each = each.withColumn("section_fingerprint", hx.fingerprint(F.col("titles"), F.col("content")))
    good = lambda c: F.when(~failed, c)
    columns = {
        "rel_path": F.col("file.rel_path"), "file_hash": F.col("file.file_hash"), "title": F.col("file.front.title"), "tags": F.col("file.front.tags"), "yaml": F.col("file.front.yaml"),
        "chunk_index": good(F.col("chunk_index")), "title_path": good(F.col("titles")), "content": good(F.col("content")), "recipe_hash": good(recipe), "section_fingerprint": good(F.col("section_fingerprint")),
        "chunk_id": good(hx.chunk_id(F.col("file.rel_path"), recipe, F.col("chunk_index"), F.col("section_fingerprint"))), "error": F.col("file.front.error"),
    }
    return each.select(*[c.alias(k) for k, c in columns.items()], *[F.col(f"file.{c}").alias(c) for c in keep])


def text_windows(df: DataFrame, key: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """(key, part, content): the overlapping windows of ``df(key, text)``."""
    return df.select(key, F.posexplode(tx.windows(F.col("text"), limit, overlap)).alias("part", "content"))
