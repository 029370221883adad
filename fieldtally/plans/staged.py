"""Queries over stage states, runs and vocabularies of many flights, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, mutate, select, stage_states, survey
from . import domain as d
from .domain import sql
from .stages import NEEDS

Q: dict = {}
BY = ["flight_id", "modality"]


def query(text: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


def _needs(spark) -> DataFrame:
    return spark.createDataFrame([(stage, needed) for stage, all_needed in NEEDS.items() for needed in all_needed], "stage string, needed string")


def _stages(spark, sf) -> DataFrame:
    """Every flight's and camera's stages, with a number that decides what happened to them."""
    n = d.detections(spark, sf).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    ordinals = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).cast("long").alias("ord")) for i, s in enumerate(NEEDS)])
    return n.select(*BY, "n", F.inline(ordinals)).withColumn("k", F.col("n") + 3 * F.col("ord") + F.col("flight_id"))


def _states(spark, sf) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("complete", "pending", "complete", "stale", "failed"))), (F.col("k") % 5 + 1).cast("int"))
    return _stages(spark, sf).where("k % 11 <> 0").select(*BY, "stage", state.alias("state"), (F.col("k") % 4).alias("generation"), F.col("n").alias("row_count"))


def _outputs(spark, sf) -> DataFrame:
    return _stages(spark, sf).where("k % 3 <> 1").select(*BY, "stage")


_ORD = ", ".join(f"('{s}', {i}::bigint)" for i, s in enumerate(NEEDS))
_EDGES = ", ".join(f"('{s}', '{n}')" for s, all_needed in NEEDS.items() for n in all_needed)
_BASE = f"""with recursive needs(stage, needed) as (select * from (values {_EDGES}) v(stage, needed)),
below(root, stage) as (
  select needed, stage from needs
  union
  select below.root, needs.stage from below join needs on needs.needed = below.stage),
stages as (
  select flight_id, modality, n, stage, n + 3 * ord + flight_id as k
  from (select flight_id, modality, count(*) as n from det group by 1, 2), (values {_ORD}) o(stage, ord)),
states as (
  select flight_id, modality, stage, (['complete', 'pending', 'complete', 'stale', 'failed'])[(k % 5 + 1)::int] as state, k % 4 as generation, n as row_count
  from stages where k % 11 <> 0),
outputs as (select flight_id, modality, stage from stages where k % 3 <> 1),
done as (select flight_id, modality, stage, k % 13 as turn, k as row_count from stages where k % 7 in (0, 3))"""


@query(_BASE + """
select root, count(*) as n_reached, count(*) filter (state = 'complete') as n_complete
from states join below using (stage) group by root""")
def c1_dependents(spark, sf):
    """How many recorded states depend on each stage, directly or not."""
    reached = _states(spark, sf).join(stage_states.dependents(_needs(spark)), "stage")
    return reached.groupBy("root").agg(F.count(F.lit(1)).alias("n_reached"), F.count_if(F.col("state") == "complete").alias("n_complete"))


@query(_BASE + """,
last as (select flight_id, modality, stage, max(turn) as turn, count(*) as runs, arg_max(row_count, turn) as new_count from done group by 1, 2, 3),
above as (
  select flight_id, modality, below.stage, max(turn) as above from done join below on below.root = done.stage group by 1, 2, 3),
every as (
  select flight_id, modality, stage, case when runs is not null then 'complete' else state end as now, coalesce(generation, 0) + coalesce(runs, 0) as generation,
    case when runs is not null then new_count else row_count end as row_count, coalesce(above > coalesce(turn, -1), false) as hit
  from states full join last using (flight_id, modality, stage) left join above using (flight_id, modality, stage))
select flight_id, modality, stage, case when hit and now in ('complete', 'stale') then 'stale' else now end as state, generation, row_count,
  hit and now = 'complete' as went_stale from every""")
def c2_mark_complete(spark, sf):
    """States after a round of runs in every flight; what depends on a later run goes stale."""
    done = _stages(spark, sf).where("k % 7 in (0, 3)").select(*BY, "stage", (F.col("k") % 13).alias("at"), F.col("k").alias("row_count"))
    return stage_states.completed(_states(spark, sf), done, _needs(spark), BY)


@query(_BASE + " select stage, modality, state, count(*) as n, max(generation) as generation from states group by 1, 2, 3")
def c3_recorded_states(spark, sf):
    """Recorded states by stage and camera."""
    return _states(spark, sf).groupBy("stage", "modality", "state").agg(F.count(F.lit(1)).alias("n"), F.max("generation").alias("generation"))


@query(_BASE + """,
seen as (
  select s.*, o.stage is null and state in ('complete', 'stale') as gone from states s left join outputs o using (flight_id, modality, stage)),
above as (select distinct flight_id, modality, below.stage from seen join below on below.root = seen.stage where gone)
select flight_id, modality, stage, case when gone then 'pending' when a.stage is not null and state in ('complete', 'stale') then 'stale' else state end as state,
  generation, row_count, gone as changed from seen left join above a using (flight_id, modality, stage)""")
def c5_reconcile(spark, sf):
    """States brought in line with the outputs that are there."""
    return stage_states.reconciled(_states(spark, sf), _outputs(spark, sf), _needs(spark), BY)


@query(_BASE + """,
above as (
  select distinct flight_id, modality, below.stage from stages join below on below.root = stages.stage where k % 17 = 0),
own as (select flight_id, modality, stage from stages where k % 17 = 0),
both_ as (
  select s.*, o.stage is not null as own, a.stage is not null as above
  from states s left join own o using (flight_id, modality, stage) left join above a using (flight_id, modality, stage))
select flight_id, modality, stage, case when own then 'pending' when above and state in ('complete', 'stale') then 'stale' else state end as state,
  generation, case when not own then row_count end as row_count, own as removed, false as cascade from both_
union all
select flight_id, modality, stage, case when own or above then 'pending' else state end, generation, case when not (own or above) then row_count end,
  own or above, true from both_""")
def c6_reset(spark, sf):
    """States after a reset of some stages, without and with their dependents."""
    states, needs = _states(spark, sf), _needs(spark)
    targets = _stages(spark, sf).where("k % 17 = 0")
    each = [stage_states.reset(states, targets, needs, BY, c).withColumn("cascade", F.lit(c)) for c in (False, True)]
    return each[0].unionByName(each[1])


@query(_BASE + """,
n as (select root as stage, count(*) as n_dependents from below group by 1)
select flight_id, modality, stage,
  case when state in ('complete', 'stale') and o.hit is null then 'pending' when state is null then 'complete' else state end as state,
  o.hit is not null as on_disk, coalesce(n_dependents, 0) as n_dependents
from states full join (select *, true as hit from outputs) o using (flight_id, modality, stage) left join n using (stage)""")
def c7_stage_summary(spark, sf):
    """What is shown for each stage of each flight."""
    return stage_states.described(_states(spark, sf), _outputs(spark, sf), _needs(spark), BY)


@query(_BASE + """
select flight_id, modality, count(*) filter (o.hit) as with_output, count(*) filter (o.hit and state = 'complete') as complete,
  count(*) filter (o.hit and state = 'stale') as stale
from states full join (select *, true as hit from outputs) o using (flight_id, modality, stage) group by 1, 2""")
def c8_output_inventory(spark, sf):
    """Outputs of each flight and camera by recorded state."""
    there = _outputs(spark, sf).withColumn("there", F.lit(True))
    both = _states(spark, sf).join(there, [*BY, "stage"], "full")
    return both.groupBy(*BY).agg(
        F.count_if("there").alias("with_output"), F.count_if(F.col("there") & (F.col("state") == "complete")).alias("complete"),
        F.count_if(F.col("there") & (F.col("state") == "stale")).alias("stale"),
    )


def _runs(spark, sf) -> DataFrame:
    """Track runs of every flight: one for each producer that its detections name."""
    by = d.detections(spark, sf).groupBy("flight_id", "source_class").agg(F.count(F.lit(1)).alias("n"), F.min("detection_id").alias("first"))
    return by.selectExpr(
        "flight_id", "first as run_id", "case source_class when 'click' then 'builtin' when 'view' then 'boxmot' when 'error' then 'manual' when 'signup' then 'manual' else 'builtin' end as kind",
        "n % 5 as generation", "n % 2 = 0 as is_active",
    )


_RUNS = """with runs as (
  select flight_id, min(detection_id) as run_id, count(*) % 5 as generation, count(*) % 2 = 0 as is_active,
    case source_class when 'click' then 'builtin' when 'view' then 'boxmot' when 'error' then 'manual' when 'signup' then 'manual' else 'builtin' end as kind
  from det group by flight_id, source_class)"""


@query(_RUNS + """
select flight_id, max(run_id) as run_id from runs where is_active or kind = 'manual' group by flight_id, kind = 'manual'""")
def j7_analysis_runs(spark, sf):
    """Runs that count for the analysis of each flight."""
    return select.analysis_runs(_runs(spark, sf), by="flight_id")


@query(_RUNS + """
select flight_id, run_id, kind from (select *, row_number() over (partition by flight_id order by run_id desc) as r from runs where is_active) where r = 1""")
def l2_latest_active(spark, sf):
    """Latest active run of each flight."""
    return select.latest_active(_runs(spark, sf), "flight_id")


@query(_RUNS + """
select flight_id, run_id from runs where is_active union select flight_id, max(run_id) from runs where kind = 'manual' group by 1""")
def u1_union_of_runs(spark, sf):
    """Active runs of each flight and its latest manual one, each once."""
    r = _runs(spark, sf)
    manual = r.where("kind = 'manual'").groupBy("flight_id").agg(F.max("run_id").alias("run_id"))
    return r.where("is_active").select("flight_id", "run_id").union(manual).distinct()


@query(_RUNS + """
select flight_id, run_id, kind, generation, false as is_active from runs
union all
select flight_id, max(run_id) + 1, 'builtin', coalesce(max(generation) filter (kind = 'builtin'), 0) + 1, true from runs group by 1""")
def k4_activate_run(spark, sf):
    """Runs of each flight after a new one was added and made the active one."""
    return mutate.append_run(_runs(spark, sf), "builtin", "flight_id")


@query("""
with old as (
  select flight_id, source_class as kind, row_number() over (partition by flight_id order by source_class) as source_id
  from (select distinct flight_id, source_class from det where detection_id % 7 = 0 and source_class in ('error', 'view', 'signup'))),
want as (select distinct flight_id, source_class as kind from det)
select * from old
union all
select flight_id, kind, coalesce((select max(source_id) from old where old.flight_id = want.flight_id), 0) + row_number() over (partition by flight_id order by kind)
from want where (flight_id, kind) not in (select (flight_id, kind) from old)""")
def k2_ensure_source(spark, sf):
    """Sources of each flight, with those that its detections name and that it doesn't have yet."""
    x = d.detections(spark, sf)
    old = x.where("detection_id % 7 = 0 and source_class in ('error', 'view', 'signup')").select("flight_id", F.col("source_class").alias("kind")).distinct()
    old = mutate.ensure_ids(old.limit(0).withColumn("source_id", F.lit(0).cast("long")), old, "kind", "source_id", "flight_id")
    return mutate.ensure_ids(old, x.select("flight_id", F.col("source_class").alias("kind")), "kind", "source_id", "flight_id")


_LABELS = """with named as (
  select distinct flight_id, label as name from predictions join det using (detection_id) where detection_id % (3 + flight_id % 4) = 0
  union select distinct flight_id, source_class from det where detection_id % (5 + flight_id % 3) = 1 and frame % 50 = 0)"""


def _names(spark, sf) -> DataFrame:
    """Names that each flight uses: some of the vocabulary's, and some of its own."""
    x = d.detections(spark, sf)
    p = d.predictions(spark, sf).join(x.select("detection_id", "flight_id"), "detection_id").where("detection_id % (3 + flight_id % 4) = 0")
    own = x.where("detection_id % (5 + flight_id % 3) = 1 and frame % 50 = 0")
    return p.select("flight_id", F.col("label").alias("name")).union(own.select("flight_id", "source_class")).distinct()


@query(_LABELS + " select flight_id, name, species_id from named left join species using (name)")
def j29_species_by_name(spark, sf):
    """Names of each flight with their species in the vocabulary, by name alone."""
    return joins.by_name(_names(spark, sf), d.species(spark, sf)).select("flight_id", "name", "species_id")


@query(_LABELS + """
select name, count(distinct flight_id) as projects, min(flight_id) as first_project, count(distinct flight_id) = (select count(distinct flight_id) from named) as shared
from named group by name""")
def a16_vocabulary_compare(spark, sf):
    """Names by the flights that have them."""
    return select.vocabulary_differences(_names(spark, sf), "flight_id")


@query(_LABELS + """,
a as (select flight_id, name from named), b as (select flight_id - 1 as flight_id, name from named where flight_id > 0)
select flight_id, name, 'both' as where_ from (select * from a intersect select * from b)
union all select flight_id, name, 'first' from (select * from a except select * from b)
union all select flight_id, name, 'second' from (select * from b except select * from a)""")
def u3_vocabulary_sets(spark, sf):
    """Each flight's names and the next one's: in both, in the first or in the second."""
    a = _names(spark, sf).select("flight_id", "name")
    b = a.where("flight_id > 0").select((F.col("flight_id") - 1).alias("flight_id"), "name")
    each = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    parts = [v.withColumn("where_", F.lit(k)) for k, v in each.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
with used as (select track_id // 150 as flight_id, species_id, count(*) as n from tracks group by 1, 2)
select f.flight_id, s.species_id, s.name, coalesce(n, 0) as n_tracks
from (select distinct flight_id from used) f, species s left join used u on u.flight_id = f.flight_id and u.species_id = s.species_id where s.species_id <> -2""")
def r1_species_options(spark, sf):
    """What can be chosen in each flight: the vocabulary without what is no animal, with the flight's tracks of each."""
    t = d.tracks(spark, sf).groupBy(F.expr("track_id div 150").alias("flight_id"), "species_id").agg(F.count(F.lit(1)).alias("n"))
    known = d.species(spark, sf).where("species_id <> -2").agg(F.array_sort(F.collect_list(F.struct("species_id", "name"))).alias("s")).scalar()
    options = t.select("flight_id").distinct().withColumn("s", known).select("flight_id", F.inline("s"))
    return options.join(t, ["flight_id", "species_id"], "left").select("flight_id", "species_id", "name", F.coalesce("n", F.lit(0)).alias("n_tracks"))


@query("""
with box as (select flight_id, min(x1) as lx, min(y1) as ly, max(x2) as hx, max(y2) as hy from det group by 1)
select flight_id, lx + c * 25 as x, ly + r * 25 as y
from (select *, unnest(range(0, floor((hx - lx) / 25)::bigint + 1)) as c from box) s, lateral (select unnest(range(0, floor((hy - ly) / 25)::bigint + 1)) as r)""")
def g17_grid_points(spark, sf):
    """Points of a planning grid over what each flight has seen."""
    box = d.detections(spark, sf).groupBy("flight_id").agg(F.min("x1").alias("lx"), F.min("y1").alias("ly"), F.max("x2").alias("hx"), F.max("y2").alias("hy"))
    return box.select("flight_id", F.explode(survey.grid_points(F.col("lx"), F.col("ly"), F.col("hx"), F.col("hy"), 25.0)).alias("p")).select("flight_id", "p.x", "p.y")
