"""Queries over statistics, matching and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, matching, statistics
from . import domain as d
from .domain import sql

Q: dict = {}


def query(text: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


def _pairs(spark, sf):
    """All box pairs of both cameras on equal frames; colour boxes are in a frame of twice the size."""
    x = d.detections(spark, sf).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    t = x.where("modality = 't'").selectExpr("flight_id", "frame as frame_t", "detection_id as id_t", "obj as track_t", "cx as xt", "cy as yt", "confidence as conf_t")
    w = x.where("modality = 'w'").selectExpr("flight_id", "frame as frame_t", "detection_id as id_w", "obj as track_w", "2 * cx + 30 as xw", "2 * cy - 12 as yw", "confidence as conf_w")
    return t.join(w, ["flight_id", "frame_t"])


def _affines(spark, sf):
    return matching.registrations(_pairs(spark, sf), "flight_id", (800.0, 512.0), (1600.0, 1024.0))


def _candidates(spark, sf):
    # the known registration, so that SQL can follow
    flights = d.detections(spark, sf).select("flight_id").distinct()
    affines = flights.select("flight_id", *[F.lit(v).alias(c) for c, v in zip(("a", "b", "tx", "c", "d", "ty"), (0.5, 0.0, -15.0, 0.0, 0.5, 6.0))])
    return matching.candidates(_pairs(spark, sf), affines, "flight_id")


CAND = "with t as (select flight_id, frame, obj as track_t, (x1+x2)/2 as xt, (y1+y2)/2 as yt, confidence as ct from det where modality = 't'), w as (select flight_id, frame, obj as track_w, (x1+x2)/2 as xw, (y1+y2)/2 as yw, confidence as cw from det where modality = 'w'), p as (select *, sqrt((xw-xt)*(xw-xt) + (yw-yt)*(yw-yt)) as dist from t join w using (flight_id, frame)), c as (select flight_id, track_t, track_w, count(distinct frame) as shared, median(dist) as median_dist, avg(ct) as conf_t, avg(cw) as conf_w from p group by 1, 2, 3)"


@query(CAND + " select flight_id, track_t, track_w, shared, round(median_dist, 6) as median_dist, round(conf_t, 6) as conf_t from c")
def a5_match_candidates(spark, sf):
    c = _candidates(spark, sf)
    return c.select("flight_id", "track_t", "track_w", "shared", F.round("median_dist", 6).alias("median_dist"), F.round("conf_t", 6).alias("conf_t"))


@query(CAND + " select coalesce(case when shared < 2 then 'too_few_frames' when median_dist >= 28 then 'too_far' when conf_t < 0.2 or conf_w < 0.2 then 'low_confidence' end, 'admitted') as reason, count(*) as n from c group by 1")
def f12_rejection_reasons(spark, sf):
    g = matching.gate(_candidates(spark, sf), shared=2)
    return g.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def g10_one_to_one(spark, sf):
    admitted = matching.gate(_candidates(spark, sf), shared=2).where("reason is null")
    return matching.one_to_one(admitted, "flight_id")


@query()
def g11_registration(spark, sf):
    a = _affines(spark, sf)
    return a.select("flight_id", *[F.round(c, 3).alias(c) for c in ("a", "b", "tx", "c", "d", "ty", "rmse")], "pairs")


@query()
def g12_cross_modal_match(spark, sf):
    p = _pairs(spark, sf)
    found = matching.candidates(p, _affines(spark, sf), "flight_id")
    matched = matching.one_to_one(matching.gate(found, shared=2).where("reason is null"), "flight_id")
    return matching.match_summary(found, matched, "flight_id")


@query()
def w16_tracker(spark, sf):
    x = d.detections(spark, sf).select("flight_id", "modality", "frame", "detection_id", "x1", "y1", "x2", "y2", (F.col("detection_id") % 2).alias("cls"))
    return matching.track(x, ["flight_id", "modality"])


@query("with recursive e as (select event_id as a, event_id + 3 as b from events where event_id % 3 = 0 and event_id % 12 <> 9), s as (select a, b from e union select b, a from e), r as (select a as node, a as root from s union select s.b, r.root from r join s on s.a = r.node) select node, min(root) as root from r group by node")
def u7_merge_groups(spark, sf):
    pairs = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 3 = 0 and event_id % 12 <> 9").selectExpr("event_id as a", "event_id + 3 as b")
    return graphs.merge_groups(pairs)


def _transects(spark, sf):
    """Counts and areas: one transect for each flight and object."""
    x = d.detections(spark, sf).groupBy("flight_id", "obj").agg(F.sum((F.col("confidence") > 0.9).cast("long")).alias("count"))
    area = 1.0 + (F.col("obj") * 7 % 11) / 10.0 + F.col("flight_id") % 3 / 100.0
    return x.select("flight_id", F.col("obj").alias("transect_id"), "count", area.alias("area_ha"))


@query("with t as (select flight_id, obj, count(*) filter (confidence > 0.9) as c, 1.0::double + (obj * 7 % 11) / 10.0::double + flight_id % 3 / 100.0::double as a from det group by 1, 2) select flight_id, round(sum(c) / sum(a) * 100, 6) as density, count(*) as transects from t group by 1")
def a28_naive_density(spark, sf):
    n = statistics.naive_density(_transects(spark, sf), "flight_id")
    return n.select("flight_id", F.round("density", 6).alias("density"), "transects")


@query()
def a27_bootstrap(spark, sf):
    return statistics.population(_transects(spark, sf), "flight_id", "bootstrap")


def _projects(spark, sf):
    """Transects of fifty flights pooled: the fit's cost is by stratum, not by animal."""
    t = _transects(spark, sf).withColumn("project", F.expr("flight_id div 50"))
    return t.groupBy("project", "transect_id").agg(F.sum("count").alias("count"), F.sum("area_ha").alias("area_ha"))


@query()
def g5_population_zinb(spark, sf):
    return statistics.population(_projects(spark, sf), "project", "zinb")


@query()
def g7_zinb_fit(spark, sf):
    return statistics.zinb_fits(_projects(spark, sf), "project")


@query()
def g8_zinb_bounds(spark, sf):
    """What ran to a bound, with the standard error of what is left."""
    held = statistics.zinb_fits(_projects(spark, sf), "project").select("project", "size_held", "zero_held")
    return held.join(statistics.population(_projects(spark, sf), "project", "zinb").select("project", "se"), "project")


def _sampled(spark, sf):
    x = d.detections(spark, sf).where("detection_id % 10 <> 0")
    dist = x.select("modality", (F.sqrt(-2 * F.log(F.lit(1.0) - (F.col("detection_id") % 997) / 1000.0)) * F.abs(F.cos(F.col("detection_id") * 1.0)) * 10).alias("distance_m"))
    lengths = spark.createDataFrame([("t", 4000.0), ("w", 5000.0)], "modality string, length_m double")
    return statistics.distance_sampling(dist, lengths, "modality")


@query()
def g2_width_cv(spark, sf):
    """Coefficient of variation of the effective strip width."""
    return _sampled(spark, sf).select("modality", "model", "sigma", "esw", "w", "n", "cv_esw")


@query()
def g1_distance_sampling(spark, sf):
    r = _sampled(spark, sf)
    return r.select("modality", "model", "n", *[F.round(c, 4).alias(c) for c in ("w", "sigma", "esw", "p", "density_ha", "low", "high")])


@query("select flight_id * 1000000 + frame // 20 as transect_id, round(sum(case when nxt is null then 900 else 900 - greatest(0, 30 - abs(nxt - x)) * 30 end), 4) as area from (select flight_id, frame, x, lead(x) over (partition by flight_id, frame // 20 order by x) as nxt from poses where x is not null) group by 1")
def a26_union_area(spark, sf):
    pt = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    ring = F.array(pt(-15.0, -15.0), pt(15.0, -15.0), pt(15.0, 15.0), pt(-15.0, 15.0))
    f = d.poses(spark, sf).where("x is not null").withColumn("ring", ring).withColumn("transect_id", F.expr("flight_id * 1000000 + frame div 20"))
    return statistics.union_areas(f, "transect_id").withColumn("area", F.round("area", 4))
