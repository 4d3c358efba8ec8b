"""Replies of models in JSON, decoded strictly or tolerantly: what is unknown, missing or of another type is told apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions import text as tx

#: What members may be, and how a wrong one is told.
KINDS = {
    "string": (("STRING",), "text"), "array<string>": (("ARRAY<STRING>", "ARRAY<VOID>"), "a list of texts"), "long": (("BIGINT",), "a whole number"),
    "boolean": (("BOOLEAN",), "true or false"),
}


def decoded(reply: Column, members: Mapping[str, str], strict: bool = False) -> Column:
    """A struct with ``members`` (names to types of ``KINDS``), ``unknown``, ``missing`` and ``mistyped`` (names, in order) and ``error``, null for a good reply.

    A reply is a JSON object, with white space around it; what follows it is passed over. A member that is missing or null is null, and no error; one of another type is an
    error and null; one that ``members`` does not name is passed over, but an error if ``strict``. Names are compared in lower case; of members with one name the exactly named one
    counts, else the first. A null reply, and one that is no object, is an error.
    """
    v = F.try_parse_json(tx.strip(reply))
    is_object = F.coalesce(F.upper(F.schema_of_variant(v)).startswith("OBJECT"), F.lit(False))
    names = F.when(is_object, F.coalesce(F.json_object_keys(tx.strip(reply)), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    whole = F.from_json(F.when(is_object, tx.strip(reply)), "map<string,variant>")
    values, missing, mistyped = [], [], []
    for name, kind in members.items():
        fits, said = KINDS[kind]
        like = _alike(names, name)
        key = F.when(F.array_contains(names, name), F.lit(name)).otherwise(F.get(like, F.lit(0)))
        own = F.element_at(whole, key)
        told = F.upper(F.schema_of_variant(own))
        there = key.isNotNull() & own.isNotNull() & (told != "VOID")
        right = there & told.isin(*fits)
        values.append(F.when(right, F.try_variant_get(own, "$", kind)).alias(name))
        missing.append(F.when(is_object & ~F.coalesce(there, F.lit(False)), F.lit(name)))
        mistyped.append(F.when(F.coalesce(there & ~right, F.lit(False)), F.struct(F.lit(name).alias("name"), F.lit(f"{name} must be {said}").alias("said"))))
    wrong = F.array_compact(F.array(*mistyped))
    unknown = F.filter(F.array_distinct(names), lambda k: ~F.lower(k).isin(*[m.lower() for m in members]))
    error = F.when(~is_object, "a JSON object is needed").when(F.size(wrong) > 0, F.get(wrong, F.lit(0))["said"])
    if strict:
        error = F.coalesce(error, F.when(F.size(unknown) > 0, F.concat(F.lit("unknown member "), F.get(unknown, F.lit(0)))))
    return F.struct(*values, unknown.alias("unknown"), F.array_compact(F.array(*missing)).alias("missing"), F.transform(wrong, lambda x: x["name"]).alias("mistyped"), error.alias("error"))


def _alike(names: Column, name: str) -> Column:
    return F.filter(names, lambda k: F.lower(k) == name.lower())


def tags(reply: Column, strict: bool = False, most: int = 8, shortest: int = 2, longest: int = 32) -> Column:
    """The normalised tags of a tag extractor's reply, ``{"tags": [...]}``; null where it has an error, none where it has no tags."""
    found = decoded(reply, {"tags": "array<string>"}, strict)
    clean = tx.normalize_semantic_tags(F.coalesce(found["tags"], F.array().cast("array<string>")), most, shortest, longest)
    return F.when(found["error"].isNull(), clean)
