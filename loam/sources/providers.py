"""Kinds of files by name: which extensions they have and how they become chunks. And images, from captions that someone else made.

A provider's ``chunks(files, splitter, recipe_hash, keep, **options)`` makes chunks of files; ``embeds`` names the column whose text gets a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import hashing
from loam.functions import text as tx
from loam.jobs.embedder import Registry
from loam.sources import listing, markdown

#: Splitters turn files into chunks.
splitters = Registry("splitter")
splitters.register("markdown", markdown.Splitter)


@dataclass(frozen=True)
class Provider:
    file_type: str
    extensions: tuple[str, ...]
    chunks: Callable[..., DataFrame]
    embeds: str = "content"


class Providers:
    """Scan providers: a type is registered once, and no extension by two types."""

    def __init__(self) -> None:
        self._known: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        kind = provider.file_type.strip()
        own = [(e if e.startswith(".") else f".{e}").lower() for e in (x.strip() for x in provider.extensions) if e]
        if not kind or not own or len(own) < len(provider.extensions):
            raise ValueError("a provider needs a file type and extensions, none of them blank")
        if kind in self._known:
            raise ValueError(f"provider {kind!r} is known already")
        if taken := [f"{e} by {self.types()[e]}" for e in own if e in self.types()]:
            raise ValueError(f"extensions are taken: {', '.join(taken)}")
        self._known[kind] = replace(provider, file_type=kind, extensions=tuple(own))

    def types(self) -> dict[str, str]:
        """Extension to file type, for ``listing.walk``."""
        return {e: p.file_type for p in self._known.values() for e in p.extensions}

    def get(self, file_type: str) -> Provider:
        if file_type.strip() not in self._known:
            raise KeyError(f"unknown file type {file_type!r}; known: {sorted(self._known)}")
        return self._known[file_type.strip()]


def captioned(files: DataFrame, captions: DataFrame, recipe_hash: str) -> DataFrame:
    """One chunk per file of ``files(rel_path, file_hash, ...)``, whose further columns stay, from ``captions(rel_path, title, tags, description)``.

    The content is the description, ``caption_text`` (title, description and tags) is what is embedded; without a title the file's
    name stands in. Files without a caption are rows with an error.
    """
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    said = captions.select("rel_path", tx.strip(F.col("title")).alias("t"), tx.strip(F.coalesce("description", F.lit(""))).alias("content"), tx.normalize_tags(F.col("tags")).alias("tags"), F.lit(True).alias("there"))
    none = F.array().cast("array<string>")
    both = files.join(said, "rel_path", "left").withColumn("tags", F.coalesce("tags", none))
    titled = both.withColumn("title", F.coalesce(F.nullif("t", F.lit("")), stem))
    return titled.select(
        "rel_path", "file_hash", "title", "tags", F.lit(0).alias("chunk_index"), F.array("title").alias("title_path"), "content", F.lit(recipe_hash).alias("recipe_hash"),
        F.sha2(F.concat_ws("|", "rel_path", F.lit(recipe_hash), "file_hash", F.lit("0")), 256).alias("chunk_id"),
        F.concat_ws(" ", F.concat_ws(" ", "title", F.coalesce("content", F.lit(""))), F.when(F.size("tags") > 0, F.array_join("tags", " "))).alias("caption_text"),
        F.when(F.col("there").isNull(), "no caption").alias("error"), *[c for c in files.columns if c not in ("rel_path", "file_hash")],
    )


def of_markdown(files: DataFrame, splitter: markdown.Splitter, recipe_hash: str, keep: Sequence[str] = ()) -> DataFrame:
    return markdown.chunks(files, splitter, keep)


def of_images(files: DataFrame, splitter: markdown.Splitter, recipe_hash: str, keep: Sequence[str] = (), captions: DataFrame | None = None) -> DataFrame:
    """Captioned images as chunks of an index; one caption a path."""
    if captions is None:
        raise ValueError("images need captions")
    made = captioned(files.select("rel_path", "file_hash", *keep), captions, recipe_hash)
    print_ = hashing.fingerprint(F.col("title_path"), F.col("content"))
    return made.withColumns({"yaml": F.lit("{}"), "section_fingerprint": F.when(F.col("error").isNull(), print_)})


providers = Providers()
providers.register(Provider("markdown", tuple(listing.MARKDOWN), of_markdown))
providers.register(Provider("image", tuple(listing.IMAGES), of_images, "caption_text"))
