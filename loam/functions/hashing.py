"""Identities of files, sections, chunks, recipes and collections: SHA-256 over joined fields, in hex."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(titles: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.array_join(titles, "\u001f"), F.lit("\u001e"), strip(content)), 256)


def chunk_id(path: Column, recipe_hash: Column, index: Column, print_: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, recipe_hash, index.cast("string"), print_), 256)


def collection_id(root: Column, file_type: str = "markdown") -> Column:
    named = root if file_type == "markdown" else F.concat(root, F.lit(f"|file_type={file_type}"))
    return F.when(root == "", "").otherwise(F.substring(F.sha2(named, 256), 1, 32))


def canonical(values: Mapping[str, object]) -> str:
    said = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return "{" + ",".join(f"{k}={said(values[k])}" for k in sorted(values)) + "}"


def splitter_hash(name: str = "markdown", version: str = "v1", options: Mapping[str, object] | None = None) -> str:
    parts = [f"name={name}", f"version={version}", *(f"{k}={v}" for k, v in sorted((options or {}).items()))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Recipe:
    """What an index was made with. Only what changes results belongs in the options and flags of a hash."""

    type: str
    version: str
    provider: str
    model: str
    dimensions: int = 0
    provider_version: str = ""
    model_version: str = ""
    splitter: str = "markdown"
    splitter_version: str = "v1"
    provider_options: Mapping[str, object] = field(default_factory=dict)
    model_options: Mapping[str, object] = field(default_factory=dict)
    splitter_options: Mapping[str, object] = field(default_factory=dict)
    flags: Mapping[str, object] = field(default_factory=dict)
    tag_extractor: Mapping[str, object] | None = None

    def identifier(self) -> str:
        if not (self.type and self.provider and self.model):
            return ""
        #: The names of the fields and their order.
        fields = {
            "type": self.type, "version": self.version, "provider.name": self.provider, "provider.version": self.provider_version,
            "provider.options": canonical(self.provider_options), "model.provider": self.provider, "model.name": self.model,
            "model.version": self.model_version, "model.dimensions": self.dimensions, "model.options": canonical(self.model_options),
            "splitter.name": self.splitter, "splitter.version": self.splitter_version, "splitter.options": canonical(self.splitter_options),
        }
        if self.tag_extractor is not None:
            fields["tag_extractor"] = "{" + ",".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in self.tag_extractor.items()) + "}"
        fields["flags"] = canonical(self.flags)
        return "|".join(f"{k}={v}" for k, v in fields.items())

    def hash(self) -> str:
        said = self.identifier()
        return hashlib.sha256(said.encode()).hexdigest() if said else ""
