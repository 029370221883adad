"""Which observations count: runs, species rules, canonical rows, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FALLBACK_SPECIES, NOT_AN_ANIMAL
from .numbering import numbered


def analysis_runs(runs: DataFrame, include_manual: bool = True, by: str | None = None) -> DataFrame:
    """run_id of the latest active run that isn't manual, and of the latest manual run; with ``by``, of each project."""
    keys = [by] if by else []
    manual = F.coalesce(F.col("kind") == "manual", F.lit(False))
    usable = runs.where(manual | F.col("is_active")).where(F.lit(include_manual) | ~manual)
    return usable.groupBy(*keys, manual.alias("_manual")).agg(F.max("run_id").alias("run_id")).select(*keys, "run_id")


def latest_active(runs: DataFrame, by: str | None = None) -> DataFrame:
    """The active run with the highest run_id: (by, run_id, kind)."""
    keys = [by] if by else []
    return runs.where("is_active").groupBy(*keys).agg(F.max("run_id").alias("run_id"), F.max_by("kind", "run_id").alias("kind")).where("run_id is not null")


def vocabulary_differences(names: DataFrame, project: str, name: str = "name") -> DataFrame:
    """For each name the number of projects that have it, whether all do, and the first of them."""
    projects = names.agg(F.count_distinct(project).alias("n")).scalar()
    each = names.groupBy(name).agg(F.count_distinct(project).alias("projects"), F.min(project).alias("first_project"))
    return each.withColumn("shared", F.col("projects") == projects)


def superseded(label_tracks: DataFrame) -> DataFrame:
    """track_id of tracks that a materialised label was made from."""
    return label_tracks.where("origin_track_id is not null and track_id is not null").select(F.col("origin_track_id").alias("track_id")).distinct()


def resolve_species(detections: DataFrame, mapping: DataFrame, default: int = FALLBACK_SPECIES) -> DataFrame:
    """``detections`` with species_id by (source_id, source_class); ``default`` where there is no mapping."""
    known = F.broadcast(mapping.select("source_id", "source_class", F.col("species_id").alias("_s")))
    joined = detections.drop("species_id").join(known, ["source_id", "source_class"], "left")
    return joined.withColumn("species_id", F.coalesce("_s", F.lit(default).cast("long"))).drop("_s")


def run_members(members: DataFrame, tracks: DataFrame, runs: DataFrame) -> DataFrame:
    """Members of the given runs alone: (detection_id, track_id, track_species_id)."""
    chosen = tracks.join(F.broadcast(runs.select("run_id")), "run_id", "left_semi")
    return members.join(chosen.select("track_id", F.col("species_id").alias("track_species_id")), "track_id").select("detection_id", "track_id", "track_species_id")


def canonical(detections: DataFrame, geo: DataFrame | None, members: DataFrame, tracks: DataFrame, runs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row a detection: box, position if there is one, track of the analysis runs if there is one.

    Members are cut to the analysis runs before the left join, so that a detection tracked in an old run too isn't
    doubled. A superseded track's rows stay, without track; a label's own species wins over the detection's.
    """
    own = run_members(members, tracks, runs)
    if labels is not None:
        gone = superseded(labels).withColumn("gone", F.lit(True))
        own = own.join(gone, "track_id", "left")
        keep = F.col("gone").isNull()
        own = own.select("detection_id", F.when(keep, F.col("track_id")).alias("track_id"), F.when(keep, F.col("track_species_id")).alias("track_species_id"))
    out = detections if geo is None else detections.join(geo, "detection_id", "left")
    return out.join(own, "detection_id", "left")


def species_filter(ids: list[int] | None) -> Column:
    """None: all rows. An empty list: none."""
    if ids is None:
        return F.lit(True)
    return F.col("species_id").isin(ids) if ids else F.lit(False)


def countable(rows: DataFrame, ids: list[int] | None = None, geo: bool = True) -> DataFrame:
    """Rows that analytics count: no false positives, positioned, of the wanted species."""
    out = rows.where(F.col("species_id") != NOT_AN_ANIMAL).where(species_filter(ids))
    return out.where("gx1 is not null") if geo else out


def centroids(rows: DataFrame) -> DataFrame:
    """Mean box centre of each track: track_id, species_id, n, cx, cy."""
    cx, cy = (F.col("gx1") + F.col("gx2")) / 2, (F.col("gy1") + F.col("gy2")) / 2
    tracked = rows.where("track_id is not null")
    return tracked.groupBy("track_id").agg(F.min("species_id").alias("species_id"), F.count(F.lit(1)).alias("n"), F.avg(cx).alias("cx"), F.avg(cy).alias("cy"))


def provenance(rows: DataFrame, runs: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """One row: what was counted, what was left out and why; one scan with conditional sums."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    wrong, placed, wanted = F.col("species_id") == NOT_AN_ANIMAL, F.col("gx1").isNotNull(), species_filter(ids)
    sums = rows.agg(
        F.count(F.lit(1)).alias("detections"), one(wrong).alias("excluded_not_an_animal"), one(~placed).alias("without_position"),
        one(~wrong & placed & wanted).alias("counted"), one(~wrong & placed & wanted & F.col("track_id").isNull()).alias("untracked"),
    )
    used = runs.agg(F.array_join(F.array_sort(F.collect_set(F.col("run_id").cast("string"))), ",").alias("runs"))
    return sums.withColumn("runs", used.scalar())


def accounting(detections: DataFrame, geo: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: detections resolved, failed, in neither and in both."""
    a = detections.select("detection_id").join(geo.select("detection_id", F.lit(1).alias("g")), "detection_id", "left")
    a = a.join(failures.select("detection_id", F.lit(1).alias("f")), "detection_id", "left")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g, f = F.col("g").isNotNull(), F.col("f").isNotNull()
    return a.agg(F.count(F.lit(1)).alias("total"), one(g).alias("resolved"), one(f).alias("failed"), one(~g & ~f).alias("unaccounted"), one(g & f).alias("both"))


def stride(rows: DataFrame, start: int, end: int, step: int, by: str = "frame") -> DataFrame:
    """Every ``step``-th of the distinct frames in a range, by position among those that there are."""
    frames = rows.where(F.col(by).between(start, end)).select(by).distinct()
    kept = numbered(frames, by, "_i").where((F.col("_i") - 1) % step == 0)
    return rows.join(kept.drop("_i"), by, "left_semi")


def strata(rows: DataFrame, species: DataFrame) -> DataFrame:
    """Counts over all species and for each one, in one pass; species without a row don't appear."""
    named = rows.join(F.broadcast(species.select("species_id", F.col("name").alias("species"))), "species_id")
    return named.rollup("species").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("n_tracks"))
