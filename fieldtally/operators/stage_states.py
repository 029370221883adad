"""Stage states of many flights as tables: completion, reconciliation and reset over a graph of what needs what.

States are rows (by columns, stage, state, generation, row_count) and the graph rows (stage, needed). Dependents come
from one recursive query over the graph, which is a table of a project's few stages; states join it by stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, RUNNING, COMPLETE, FAILED, STALE = "pending", "running", "complete", "failed", "stale"


def dependents(needs: DataFrame) -> DataFrame:
    """(root, stage): all stages that need a stage, directly or not. ``needs`` has no cycle; nulls need nothing."""
    spark = needs.sparkSession
    text = """
        with recursive found(root, stage) as (
          select needed, stage from {needs}
          union all
          select found.root, n.stage from found join {needs} n on n.needed = found.stage)
        select distinct root, stage from found where root is not null and stage is not null"""
    return spark.sql(text, needs=needs)


def _hit(changed: DataFrame, needs: DataFrame, by: list[str], *facts: Column) -> DataFrame:
    """(by, stage, facts): stages that depend on a changed one, with facts of those that they depend on."""
    reached = changed.join(dependents(needs).withColumnRenamed("stage", "below"), F.col("stage") == F.col("root"))
    return reached.groupBy(*by, F.col("below").alias("stage")).agg(*facts)


def completed(states: DataFrame, done: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """``states`` after the runs ``done`` (by, stage, at, row_count), with ``went_stale``.

    A run makes its stage complete, with a generation more for each run and the last one's row_count; stages without a
    row get one. It makes its dependents stale, where they are complete, unless they themselves ran later (``at``).
    """
    last = done.groupBy(*by, "stage").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("runs"), F.max_by("row_count", "at").alias("new_count"))
    above = _hit(done, needs, by, F.max("at").alias("above"))
    every = states.join(last, [*by, "stage"], "full").join(above, [*by, "stage"], "left")
    now = F.when(F.col("runs").isNotNull(), COMPLETE).otherwise(F.col("state"))
    hit = F.col("above").isNotNull() & (F.col("at").isNull() | (F.col("above") > F.col("at")))
    return every.select(
        *by, "stage", F.when(hit & now.isin(COMPLETE, STALE), STALE).otherwise(now).alias("state"),
        (F.coalesce("generation", F.lit(0)) + F.coalesce("runs", F.lit(0))).alias("generation"),
        F.when(F.col("runs").isNotNull(), F.col("new_count")).otherwise(F.col("row_count")).alias("row_count"),
        F.coalesce(hit & (now == COMPLETE), F.lit(False)).alias("went_stale"),
    )


def reconciled(states: DataFrame, outputs: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """``states`` with ``changed``: complete or stale stages without a row in ``outputs`` (by, stage) become pending, their dependents stale."""
    kept = outputs.select(*by, "stage").distinct().withColumn("there", F.lit(True))
    seen = states.join(kept, [*by, "stage"], "left").withColumn("gone", F.col("there").isNull() & F.col("state").isin(COMPLETE, STALE))
    above = _hit(seen.where("gone"), needs, by, F.lit(True).alias("above"))
    both = seen.join(above, [*by, "stage"], "left")
    state = F.when(F.col("gone"), PENDING).when(F.col("above") & F.col("state").isin(COMPLETE, STALE), STALE).otherwise(F.col("state"))
    return both.select(*by, "stage", state.alias("state"), "generation", "row_count", F.col("gone").alias("changed"))


def reset(states: DataFrame, targets: DataFrame, needs: DataFrame, by: list[str], cascade: bool = False) -> DataFrame:
    """``states`` with ``removed``: stages in ``targets`` (by, stage) become pending and lose their rows' counts.

    With ``cascade`` so do all that depend on them; else those become stale where they were complete.
    """
    own = targets.select(*by, "stage").distinct().withColumn("own", F.lit(True))
    above = _hit(targets.select(*by, "stage"), needs, by, F.lit(True).alias("above"))
    both = states.join(own, [*by, "stage"], "left").join(above, [*by, "stage"], "left")
    gone = F.col("own").isNotNull() | F.col("above").isNotNull() if cascade else F.col("own").isNotNull()
    stale = F.col("above").isNotNull() & F.col("state").isin(COMPLETE, STALE)
    return both.select(
        *by, "stage", F.when(gone, PENDING).when(stale, STALE).otherwise(F.col("state")).alias("state"), "generation",
        F.when(~gone, F.col("row_count")).alias("row_count"), gone.alias("removed"),
    )


def described(states: DataFrame, outputs: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """What to show for each stage: state as the outputs have it, whether there are any, and how many stages depend on it."""
    kept = outputs.select(*by, "stage").distinct().withColumn("there", F.lit(True))
    below = dependents(needs).groupBy(F.col("root").alias("stage")).agg(F.count(F.lit(1)).alias("n_dependents"))
    both = states.join(kept, [*by, "stage"], "full").join(below, "stage", "left")
    there = F.coalesce("there", F.lit(False))
    state = F.when(F.col("state").isin(COMPLETE, STALE) & ~there, PENDING).when(F.col("state").isNull(), COMPLETE).otherwise(F.col("state"))
    return both.select(*by, "stage", state.alias("state"), there.alias("on_disk"), F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"))
