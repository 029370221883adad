"""Table mutations as new tables: replacement by producer, key or task, diffs, ids, custom fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Words that a boolean field takes for true and false.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")


def replace_where(old: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """``old`` with the rows of one producer, run or task replaced by ``new``."""
    return old.where(~F.col(column).eqNullSafe(value)).unionByName(new)


def replace_keys(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced; other keys stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_geo(resolved: DataFrame, failed: DataFrame) -> DataFrame:
    """State of each detection of a new run: resolved, or failed with a reason; a position wins over a failure."""
    r = resolved.select("detection_id", F.lit("resolved").alias("state"), F.lit(None).cast("string").alias("reason"))
    f = without(failed, resolved, "detection_id").select("detection_id", F.lit("failed").alias("state"), "reason")
    return r.unionByName(f)


def adopt(store: DataFrame, legacy: DataFrame, by: str) -> DataFrame:
    """The store with legacy rows of those groups for which it has none."""
    return store.unionByName(legacy.join(store.select(by).distinct(), by, "left_anti").select(*store.columns))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def ensure_ids(old: DataFrame, wanted: DataFrame, name: str, number: str, by: str | None = None) -> DataFrame:
    """``old`` (a vocabulary) with the missing names added under the next ids, by name. With ``by``, each project has its own."""
    keys = [by] if by else []
    missing = wanted.select(*keys, name).distinct().join(old.select(*keys, name), [*keys, name], "left_anti")
    top = old.groupBy(*keys).agg(F.max(number).alias("top"))
    both = missing.join(top, keys, "left") if by else missing.withColumn("top", old.agg(F.max(number).alias("top")).scalar())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    added = both.select(*keys, name, (F.coalesce("top", F.lit(0)) + place).cast("long").alias(number))
    return old.select(*keys, name, number).unionByName(added)


def rekey_tracks(members: DataFrame, offset: int) -> DataFrame:
    """Members (legacy, detection_id) under fresh track ids by first appearance, each once."""
    first = members.groupBy("legacy").agg(F.min("detection_id").alias("first"))
    once = numbered(first.select("first").distinct(), "first", "n")
    ids = first.join(once, "first").withColumn("track_id", F.col("n") + offset)
    return members.distinct().join(ids.select("legacy", "track_id"), "legacy").select("track_id", "detection_id").distinct()


def diff_boxes(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys and ``change``: added, removed, moved (any coordinate by more than ``tolerance``) or kept."""
    box = ["x1", "y1", "x2", "y2"]
    o = old.select(*keys, F.struct(*box).alias("o"))
    n = new.select(*keys, F.struct(*box).alias("n"))
    moved = F.lit(False)
    for c in box:
        moved = moved | (F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) > tolerance)
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(moved, "moved").otherwise("kept")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def observed_classes(detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """All classes seen or mapped, with counts; numbers first in order, then names."""
    seen = detections.groupBy("source_class").agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(mapping.select("source_class", "species_id").distinct(), "source_class", "full_outer")
    number = F.expr("try_cast(source_class as int)")
    rank = F.row_number().over(Window.orderBy(number.isNull(), number, "source_class"))
    return both.select("source_class", F.coalesce("n", F.lit(0)).alias("n"), "species_id", rank.cast("long").alias("rank"))


def class_map(rows: DataFrame, species: DataFrame) -> DataFrame:
    """Species present with dense 0-based class indices by id and their names."""
    present = rows.select("species_id").distinct().join(F.broadcast(species), "species_id", "left")
    index = F.dense_rank().over(Window.orderBy("species_id")) - 1
    return present.select("species_id", index.cast("long").alias("class_index"), F.coalesce("name", F.concat(F.lit("species_"), F.col("species_id").cast("string"))).alias("name"))


def coerce(raw: Column, kind: str) -> Column:
    """A custom field's text as its declared kind (int, float, bool, datetime, string), null where it doesn't fit."""
    if kind == "int":
        return raw.try_cast("double").try_cast("long")
    if kind == "float":
        return raw.try_cast("double")
    if kind == "bool":
        word = F.lower(F.trim(raw))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind == "datetime":
        return F.when(F.try_to_timestamp(raw).isNotNull(), raw)
    return raw


def coercible(rows: DataFrame, field: str, kinds: list[str]) -> DataFrame:
    """For each kind, rows and those whose field fits it."""
    raw = F.get_json_object("attributes", f"$.{field}")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(coerce(raw, k)).alias(k) for k in kinds])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ok"), F.col("n").alias("n")) for k in kinds])))


def rename_key(rows: DataFrame, old: str, new: str | None) -> DataFrame:
    """``attributes`` (JSON) with a key renamed, or dropped if ``new`` is None. Broken JSON becomes an empty object."""
    m = F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(m, lambda k, v: k != old)
    if new is not None:
        moved = F.transform_keys(F.map_filter(m, lambda k, v: k == old), lambda k, v: F.lit(new))
        rest = F.map_concat(F.map_filter(rest, lambda k, v: k != new), moved)
    return rows.withColumn("attributes", F.to_json(rest))


def parity(a: DataFrame, b: DataFrame, group: str, order_a: str, order_b: str, va: str, vb: str) -> DataFrame:
    """First position in each group at which two tables differ: (group, first_mismatch, compared)."""
    x = a.select(group, va, F.row_number().over(Window.partitionBy(group).orderBy(order_a)).alias("n"))
    y = b.select(group, vb, F.row_number().over(Window.partitionBy(group).orderBy(order_b)).alias("n"))
    both = x.join(y, [group, "n"])
    differ = F.abs(F.col(va) - F.col(vb)) > 1e-6
    return both.groupBy(group).agg(F.min(F.when(differ, F.col("n"))).cast("long").alias("first_mismatch"), F.count(F.lit(1)).alias("compared"))


def append_run(runs: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """Runs with a new active one of a kind, next generation of it; all others become inactive. With ``by``, one for each project."""
    keys = [by] if by else []
    run, generation = F.coalesce(F.max("run_id"), F.lit(0)) + 1, F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("generation"))), F.lit(0)) + 1
    new = runs.groupBy(*keys).agg(run.alias("run_id"), generation.alias("generation"))
    new = new.select(*keys, "run_id", F.lit(kind).alias("kind"), "generation", F.lit(True).alias("is_active"))
    return runs.withColumn("is_active", F.lit(False)).unionByName(new)
