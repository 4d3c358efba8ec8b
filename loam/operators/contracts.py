"""What rows of the index must be: the contracts of chunks and file states, and metadata built from loose JSON maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators.incremental import reasons

#: Fields that must be there, each with the other names it may come under.
REQUIRED = {
    "source": ("source", "source_path"), "file_path": ("file_path", "source_file"), "rel_path": ("rel_path",), "file_name": ("file_name",), "doc_type": ("doc_type",),
    "file_hash": ("file_hash", "doc_hash"),
}


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (tx.strip(c) == "")


def chunk_problems() -> Column:
    """The names of the rules that a chunk breaks, in order; none for a good one."""
    tags = F.col("tags")
    return reasons(
        **{f"{f}_required": blank(f) for f in REQUIRED},
        chunk_index_negative=F.col("chunk_index").isNull() | (F.col("chunk_index") < 0),
        tags_not_normalized=tags.isNotNull() & ~tags.eqNullSafe(tx.normalize_tags(tags)),
        title_path_blank=F.exists(F.coalesce("title_path", F.array().cast("array<string>")), blank),
        yaml_required=F.col("yaml").isNull(),
    )


def state_problems() -> Column:
    """The same for a file state."""
    return reasons(
        **{f"{f}_required": blank(f) for f in ("rel_path", "file_hash", "recipe_hash")},
        chunk_count_negative=F.coalesce(F.col("chunk_count") < 0, F.lit(True)),
        chunk_count_differs=~F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))).eqNullSafe(F.col("chunk_count")),
        chunk_id_blank=F.exists(F.coalesce("chunk_ids", F.array().cast("array<string>")), blank),
        last_indexed_at_required=F.col("last_indexed_at").isNull(),
    )


def enforced(df: DataFrame, problems: Column) -> DataFrame:
    """``df``; reading a row with problems fails, with their names."""
    checked = F.when(F.size(problems) > 0, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(problems, ", ")))).otherwise(F.lit(True))
    return df.where(checked.cast("boolean"))


def metadata(loose: Column) -> Column:
    """Struct of metadata and ``error`` (null if it has none) from a JSON object in a string; ``error`` is the first rule broken.

    Required fields are text under any of their names, the first that is there; the number of a chunk is a whole number; title, title_path, tags and
    yaml may be missing or null. Text is trimmed, blanks leave lists, tags are normalised.
    """
    v = F.try_parse_json(loose)
    kind = lambda k: F.upper(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")))
    text = lambda k: tx.strip(F.try_variant_get(v, f"$.{k}", "string"))
    there = lambda k: kind(k).isNotNull()
    none = lambda k: kind(k).isNull() | (kind(k) == "VOID")
    fields, errors = [], [(v.isNull() | ~F.upper(F.schema_of_variant(v)).startswith("OBJECT"), "values are required")]
    for f, names in REQUIRED.items():
        value = F.coalesce(*[F.when(there(k), text(k)) for k in names])
        for k in names:
            earlier = F.lit(False)
            for e in names[: names.index(k)]:
                earlier = earlier | there(e)
            errors.append((there(k) & ~earlier & (kind(k) != "STRING"), f"{k} must be a string"))
        errors.append((value.isNull() | (value == ""), f"{f} is required"))
        fields.append(value.alias(f))
    errors += [(~there("chunk_index"), "chunk_index is required"), (kind("chunk_index") != "BIGINT", "chunk_index must be an int")]
    index = F.when(kind("chunk_index") == "BIGINT", F.try_variant_get(v, "$.chunk_index", "int"))
    errors.append((~none("title") & (kind("title") != "STRING"), "title must be a string"))
    lists = {}
    for k in ("title_path", "tags"):
        errors.append((~none(k) & ~kind(k).isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{k} must be a list of strings"))
        lists[k] = tx.trimmed(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>")))
    errors += [(~none("yaml") & ~kind("yaml").startswith("OBJECT"), "yaml must be a map"), (index < 0, "chunk_index must be >= 0")]
    error = F.coalesce(*[F.when(c, F.lit(f"metadata: {said}")) for c, said in errors])
    yaml = F.coalesce(F.when(~none("yaml"), F.to_json(F.try_variant_get(v, "$.yaml", "variant"))), F.lit("{}"))
    title = F.when(~none("title"), text("title")).otherwise("")
    return F.struct(*fields, title.alias("title"), index.alias("chunk_index"), lists["title_path"].alias("title_path"), tx.normalize_tags(lists["tags"]).alias("tags"), yaml.alias("yaml"), error.alias("error"))
