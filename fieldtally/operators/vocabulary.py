"""Edits of a project's vocabulary: species, enums and custom fields, with the guards that keep stored rows valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mutate import rename_key

KINDS = ("int", "float", "string", "bool", "datetime", "enum")
SCOPES = ("detection", "track", "frame", "project")


class InUse(ValueError):
    """Something that stored rows refer to was to be deleted."""


def add_species(species: DataFrame, name: str) -> DataFrame:
    """A new species under the next id; ids are never given twice, so the highest one ever used counts."""
    if species.where(F.lower("name") == name.lower()).head(1):
        raise ValueError(f"{name} is there already")
    top = species.agg(F.greatest(F.lit(0), F.max("species_id")).alias("m")).scalar()
    new = species.sparkSession.range(1).select((top + 1).cast("long").alias("species_id"), F.lit(name).alias("name"), F.lit(False).alias("protected"))
    return species.select("species_id", "name", "protected").unionByName(new)


def rename_species(species: DataFrame, species_id: int, name: str) -> DataFrame:
    """The name changes, the id and so all stored rows stay."""
    if species.where((F.lower("name") == name.lower()) & (F.col("species_id") != species_id)).head(1):
        raise ValueError(f"{name} is there already")
    return species.withColumn("name", F.when(F.col("species_id") == species_id, name).otherwise(F.col("name")))


def usage(tables: dict[str, DataFrame], column: str, value) -> dict[str, int]:
    """Rows of each table that refer to a value: one count a table."""
    return {name: t.where(F.col(column) == value).count() for name, t in tables.items()}


def delete_species(species: DataFrame, species_id: int, tables: dict[str, DataFrame]) -> DataFrame:
    """Without a species; refused for protected ones and for those that rows refer to."""
    if species.where((F.col("species_id") == species_id) & F.col("protected")).head(1):
        raise InUse("protected")
    used = {k: v for k, v in usage(tables, "species_id", species_id).items() if v}
    if used:
        raise InUse(f"used by {used}")
    return species.where(F.col("species_id") != species_id)


def add_value(values: DataFrame, enum_id: int, label: str) -> DataFrame:
    """A new label at the end of an enum, under a value id that was never used in it."""
    own = values.where(F.col("enum_id") == enum_id)
    if own.where(F.lower("label") == label.lower()).head(1):
        raise ValueError(f"{label} is there already")
    new = own.agg(F.lit(enum_id).cast("long").alias("enum_id"), (F.coalesce(F.max("value_id"), F.lit(-1)) + 1).cast("long").alias("value_id"), F.lit(label).alias("label"), (F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).cast("long").alias("ordinal"))
    return values.unionByName(new)


def reorder(values: DataFrame, enum_id: int, order: list[int]) -> DataFrame:
    """Display order of an enum's values; value ids stay."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    new = F.try_element_at(places, F.col("value_id").cast("int")).cast("long")
    return values.withColumn("ordinal", F.when(F.col("enum_id") == enum_id, F.coalesce(new, F.col("ordinal"))).otherwise(F.col("ordinal")))


def add_field(fields: DataFrame, name: str, scope: str, kind: str, enum_id: int | None = None) -> DataFrame:
    """Declare a custom field. An enum field needs its enum."""
    if kind not in KINDS or scope not in SCOPES or (kind == "enum") != (enum_id is not None):
        raise ValueError(f"{name}: {kind}, {scope}, {enum_id}")
    if fields.where((F.lower("name") == name.lower()) & (F.col("scope") == scope)).head(1):
        raise ValueError(f"{name} is there already")
    row = [(name, scope, kind, enum_id)]
    return fields.unionByName(fields.sparkSession.createDataFrame(row, "name string, scope string, type string, enum_id long"))


def rename_field(fields: DataFrame, tables: dict[str, DataFrame], name: str, scope: str, new: str | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A field renamed (or deleted, with None) in its declaration and in the attributes of its own scope's tables only."""
    hit = (F.col("name") == name) & (F.col("scope") == scope)
    fields = fields.where(~hit) if new is None else fields.withColumn("name", F.when(hit, new).otherwise(F.col("name")))
    return fields, {k: rename_key(t, name, new) if k == scope else t for k, t in tables.items()}


def prune(rows: DataFrame, fields: DataFrame, scope: str) -> DataFrame:
    """Attributes without keys that the scope doesn't declare."""
    known = fields.where(F.col("scope") == scope).agg(F.collect_set("name").alias("n")).scalar()
    m = F.from_json("attributes", "map<string,string>")
    out = rows.withColumn("_known", known).withColumn("attributes", F.to_json(F.map_filter(m, lambda k, v: F.array_contains(F.col("_known"), k))))
    return out.drop("_known")
