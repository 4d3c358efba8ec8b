"""File listings. Spark's own file sources pass over names that start with a dot or an underscore, so folders are walked here, as a data source
of its own: the driver looks at a bounded number of entries to plan, and holds names of folders alone; tasks list files and walk what is below."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories never entered, by name in lower case; and a beginning of such names.
SKIPPED = {
    ".claude", ".codex", ".git", ".idea", ".obsidian", ".vscode", "node_modules", "$recycle.bin", "recycler", "system volume information",
    ".trashes", ".trash", ".fseventsd", ".spotlight-v100", ".documentrevisions-v100", ".temporaryitems",
}
SKIPPED_PREFIX = ".trash-"
MARKDOWN = {".md": "markdown"}
IMAGES = {e: "image" for e in (".png", ".jpg", ".jpeg", ".webp", ".svg", ".gif", ".bmp", ".tif", ".tiff")}
FILES = "root string, file_path string, rel_path string, file_name string, doc_type string, mod_time timestamp"


def expression(glob: str) -> str:
    """A glob of one path part as a regular expression that Python and the JVM read alike: ``*``, ``?`` and sets stay within the part."""

    def one(m: re.Match) -> str:
        t = m.group()
        if t[0] == "*":
            return "[^/]*"
        if t == "?":
            return "[^/]"
        if t[0] == "[" and len(t) > 1:
            inner = re.sub(r"([\\\[\]&~|^])", r"\\\1", t[1:-1].lstrip("!^"))
            return f"[^/{inner}]" if t[1] in "!^" else f"[{inner}]"
        return re.escape(t[1] if t[0] == "\\" and len(t) > 1 else t)

    return re.sub(r"\*+|\?|\[[!^]?\]?[^\]/]+\]|\\.|.", one, glob)


class Ignore:
    """Rules of an ignore file: the last one that fits decides; ``!`` takes back, a slash at the end means directories; a backslash
    makes the ``!`` or ``#`` after it a plain first character."""

    def __init__(self, lines: Iterable[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n")
            if not line.strip() or line.startswith("#"):
                continue
            back, line = line.startswith("!"), line.removeprefix("!")
            if line.startswith(("\\!", "\\#")):
                line = line[1:]
            folder, line = line.endswith("/"), line.rstrip("/")
            parts = line.lstrip("/").split("/")
            if "/" not in line:
                parts.insert(0, "**")  # without a slash: at any depth
            deep = ["(?:.*/)?" if part == "**" else f"{expression(part)}/" for part in parts[:-1]]
            self.rules.append((back, folder, "".join(deep) + (".+" if parts[-1] == "**" else expression(parts[-1]))))

    def match(self, rel: str, is_dir: bool) -> bool:
        hit = False
        for back, folder, pattern in self.rules:
            if (is_dir or not folder) and re.fullmatch(pattern, rel):
                hit = not back
        return hit

    def matches(self, rel: Column, is_dir: bool) -> Column:
        """The same of a column of paths."""
        hit = F.lit(False)
        for back, folder, pattern in self.rules:
            if is_dir or not folder:
                hit = F.when(rel.rlike(rf"\A(?:{pattern})\z"), not back).otherwise(hit)
        return hit

    def folders(self, rel: Column) -> Column:
        return self.matches(rel, True)


def patterns(text: str) -> list[str]:
    """A comma list of patterns: trimmed, each once, a bare extension as ``*.ext``."""
    found = [p.strip() for p in text.split(",")]
    return list(dict.fromkeys(f"*{p}" if re.fullmatch(r"\.\w+", p) else p for p in found if p))


def extensions(text: str, known: dict[str, str]) -> list[str]:
    found = list(dict.fromkeys((e if e.startswith(".") else f".{e}").lower() for e in (x.strip() for x in text.split(",")) if e))
    if unknown := [e for e in found if e not in known]:
        raise ValueError(f"unknown extensions: {unknown}")
    return found


@dataclass
class Walk:
    """What a walk below ``root`` enters and lists."""

    root: str
    types: dict[str, str]
    recursive: bool
    rules: list[Ignore]
    prefix: str = ""

    def row(self, path: str, base: str) -> tuple | None:
        kind = self.types.get(os.path.splitext(path)[1].lower())
        if not kind:
            return None
        slashed = path.replace(os.sep, "/")
        when = datetime.fromtimestamp(os.path.getmtime(path), timezone.utc)
        return base, slashed, slashed, os.path.basename(path), kind, when

    def enters(self, entry: os.DirEntry) -> bool | None:
        """Is it a folder to enter (true) or a file to look at (false)? None is neither."""
        rel, is_dir = os.path.relpath(entry.path, self.root).replace(os.sep, "/"), entry.is_dir(follow_symlinks=False)
        if any(r.match(rel, is_dir) for r in self.rules):
            return None
        if not is_dir:
            return False
        name = entry.name.lower()
        return True if self.recursive and name not in SKIPPED and not name.startswith(SKIPPED_PREFIX) and self.near(entry.path) else None

    def near(self, folder: str) -> bool:
        """Can there be a path with the wanted beginning below?"""
        folder = folder.replace(os.sep, "/") + "/"
        return folder.startswith(self.prefix) or self.prefix.startswith(folder)

    def folders(self, folder: str, most: int) -> tuple[list[str], int] | None:
        """The folders in a folder and how many entries it has; None if they are more than ``most``, of which no more are looked at."""
        found, n = [], 0
        with os.scandir(folder) as entries:
            for entry in entries:
                n += 1
                if n > most:
                    return None
                if self.enters(entry):
                    found.append(entry.path)
        return sorted(found), n

    def level(self, folder: str) -> tuple[list[str], list[tuple]]:
        """(folders to enter, rows) of one folder, in lexical order."""
        folders, rows = [], []
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            enter = self.enters(entry)
            if enter:
                folders.append(entry.path)
            elif enter is False and (r := self.row(entry.path, self.root)):
                rows.append(r)
        return folders, rows

    def below(self, folder: str) -> Iterator[tuple]:
        todo = [folder]
        while todo:
            folders, rows = self.level(todo.pop())
            yield from rows
            todo += reversed(folders)


def planned(root: str, types: dict[str, str], recursive: bool = True, excludes: Iterable[str] = ()) -> Walk:
    if not types:
        raise ValueError("at least one extension is needed")
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    own = os.path.join(root, ".gitignore")
    rules = Ignore(open(own, encoding="utf-8").read().splitlines() if os.path.isfile(own) else [])
    return Walk(root, types, recursive, [rules, Ignore(excludes)])


def walk(root: str, types: dict[str, str], recursive: bool = True, excludes: Iterable[str] = ()) -> list[tuple]:
    """Rows of ``FILES``; a file as ``root`` is a listing of one."""
    w = planned(root, types, recursive, excludes)
    if os.path.isfile(w.root):
        return [r for r in [w.row(w.root, os.path.dirname(w.root))] if r]
    return list(w.below(w.root))


@dataclass
class Folders(InputPartition):
    """Folders that a task lists: each alone, or with all that is below."""

    own: list[str]
    trees: list[str]


class FileReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.walk = planned(options["root"], json.loads(options.get("types") or json.dumps(MARKDOWN)), options.get("recursive", "true").lower() != "false", json.loads(options.get("excludes") or "[]"))
        self.walk.prefix = options.get("prefix", "")
        self.fan_out, self.most = int(options.get("fan_out", "1000")), int(options.get("most_entries", "10000"))

    def partitions(self):
        """Level by level until there are ``fan_out`` folders or ``most_entries`` entries were seen; whatever is left is walked in tasks."""
        w, own, level, seen = self.walk, [], [self.walk.root], 0
        if os.path.isfile(w.root) or not w.types:
            return [Folders([], [])]
        while level and len(level) < self.fan_out and seen < self.most:
            deeper, left = [], []
            for folder in level:
                found = w.folders(folder, self.most - seen) if seen < self.most else None
                if found is None:
                    seen = self.most
                    left.append(folder)
                else:
                    own.append(folder)
                    deeper += found[0]
                    seen += found[1]
            level = left + deeper
        parts = [Folders([], []) for _ in range(max(1, min(self.fan_out, len(own) + len(level))))]
        for k, folder in enumerate(level):
            parts[k % len(parts)].trees.append(folder)
        for k, folder in enumerate(own):
            parts[-1 - k % len(parts)].own.append(folder)
        return parts

    def read(self, partition):
        w = self.walk
        rows = (r for p in [partition] for folder in p.own for r in w.level(folder)[1])
        if os.path.isfile(w.root):
            rows = (r for r in [w.row(w.root, os.path.dirname(w.root))] if r)
        for r in rows:
            if r[2].startswith(w.prefix):
                yield r
        for folder in partition.trees:
            for r in w.below(folder):
                if r[2].startswith(w.prefix):
                    yield r


class FileListing(DataSource):
    """``spark.read.format("file_listing")`` with the options root, types and excludes (JSON), recursive, prefix (of paths), fan_out and most_entries: rows of ``FILES``."""

    @classmethod
    def name(cls):
        return "file_listing"

    def schema(self):
        return FILES

    def reader(self, schema):
        return FileReader(self.options)


def files(spark: SparkSession, root: str, types: dict[str, str] = MARKDOWN, recursive: bool = True, excludes: Iterable[str] = (), fan_out: int = 1000, most_entries: int = 10_000, prefix: str = "") -> DataFrame:
    """The same as a DataFrame, by ``FileListing``. Folders that hold no path with the beginning ``prefix`` are not entered.

    Filters are no way to say so: a reader of Spark 4.1 keeps what one query has pushed for the next one of the same frame.
    """
    planned(root, types, recursive, excludes)  # tells what is wrong at once
    spark.dataSource.register(FileListing)
    options = {"root": os.path.abspath(root), "types": json.dumps(types), "recursive": str(recursive), "excludes": json.dumps(list(excludes)), "fan_out": str(fan_out), "most_entries": str(most_entries), "prefix": prefix}
    return spark.read.format("file_listing").options(**options).load()


def kept(inventory: DataFrame, types: dict[str, str], recursive: bool = True, rules: Iterable[Ignore] = ()) -> DataFrame:
    """The rows of a listing that exists already, such as an object store's inventory, which ``walk`` would list: ``inventory(rel_path, ...)``
    below the root, with ``doc_type``. A null or empty path is no file. Nothing is walked and nothing shuffled."""
    rules, path = list(rules), F.col("rel_path")
    parts = F.split(path, "/")
    names = F.slice(parts, 1, F.size(parts) - 1)
    folders = F.transform(names, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    closed = F.exists(names, lambda n: F.lower(n).isin(*sorted(SKIPPED)) | F.lower(n).startswith(SKIPPED_PREFIX))
    for r in rules:
        closed = closed | F.exists(folders, r.folders) | r.matches(path, False)
    if not recursive:
        closed = closed | (F.size(names) > 0)
    ends = F.lower(F.regexp_extract(path, r"(?s)(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return inventory.where(~closed).withColumn("doc_type", known[ends]).where(F.col("doc_type").isNotNull())


def contents(listing: DataFrame) -> DataFrame:
    """``listing`` with content, file_hash and error: a file that cannot be read is a row with an error, not a failed job."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema]

    def of(frames):
        for pdf in frames:
            got = []
            for path in pdf["file_path"]:
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                    got.append((raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), None))
                except OSError as e:
                    got.append((None, None, str(e)))
            yield pdf.assign(**{c: [g[i] for g in got] for i, c in enumerate(("content", "file_hash", "error"))})

    return listing.mapInPandas(of, ", ".join([*fields, "content string", "file_hash string", "error string"]))


def by_type(listing: DataFrame) -> DataFrame:
    return listing.groupBy("doc_type").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))
