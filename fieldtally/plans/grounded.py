"""Queries over terrain, areas and projections."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import joins, outlines, terrain
from ..sources import photos
from ..sources.scratch import binary_files, spread
from . import domain as d
from .domain import sql

Q: dict = {}


def query(text: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


def _vertices(spark, sf) -> DataFrame:
    """Heights at every frame's place in a grid of twenty columns."""
    h = F.sum((F.col("detection_id") * 7 + F.col("obj")) % 11) % 23
    by = d.detections(spark, sf).groupBy("frame").agg(h.cast("double").alias("h"))
    return by.selectExpr("frame % 20 as ix", "frame div 20 as iy", "h")


def _cameras(spark, sf) -> DataFrame:
    """Every detection's box with a camera above its frame's place; some look over the horizon, some have no pose."""
    return d.detections(spark, sf).selectExpr(
        "detection_id", "x1", "y1", "x2", "y2", "case when frame % 37 <> 0 then (frame % 20) * 10D + 3 end as x", "(frame div 20) * 10D + 4 as y",
        "60D as z", "50D as fovy", "cast(frame * 37 % 360 as double) as yaw", "cast(detection_id % 7 * 20 as double) as pitch",
    )


_CAMERA = """
v as (
  select frame % 20 as ix, frame // 20 as iy, (sum((detection_id * 7 + obj) % 11) % 23)::double as h from det group by frame),
mesh as (
  select min(ix) * 10 as lx, max(ix) * 10 as hx, min(iy) * 10 as ly, max(iy) * 10 as hy, avg(h) as mean from v),
cell as (
  select a.ix as cx, a.iy as cy, a.h as h00, b.h as h10, c.h as h01, e.h as h11
  from v a join v b on b.ix = a.ix + 1 and b.iy = a.iy join v c on c.ix = a.ix and c.iy = a.iy + 1 join v e on e.ix = a.ix + 1 and e.iy = a.iy + 1),
cam as (
  select *, case when frame % 37 <> 0 then (frame % 20) * 10 + 3.0::double end as ox, (frame // 20) * 10 + 4.0::double as oy, 60.0::double as oz,
    radians((frame * 37 % 360)::double) as yaw, radians((detection_id % 7 * 20)::double) as pitch from det),
corner as (
  select detection_id, ox, oy, oz, yaw, pitch, 0 as k, x1 as px, y1 as py from cam
  union all select detection_id, ox, oy, oz, yaw, pitch, 1, x2, y1 from cam
  union all select detection_id, ox, oy, oz, yaw, pitch, 2, x2, y2 from cam
  union all select detection_id, ox, oy, oz, yaw, pitch, 3, x1, y2 from cam),
uv as (
  select *, (2 * px / 800 - 1) * 1.5625 * tan(radians(50.0::double) / 2) as u, (1 - 2 * py / 512) * tan(radians(50.0::double) / 2) as v from corner),
ray as (
  select *, cos(yaw) * u - sin(yaw) * (cos(pitch) * v + sin(pitch)) as dx, sin(yaw) * u + cos(yaw) * (cos(pitch) * v + sin(pitch)) as dy,
    sin(pitch) * v - cos(pitch) as dz from uv)"""

_HITS = _CAMERA + """,
side as (
  select cx, cy, h00, true as low, h10 - h00 as a, h11 - h10 as b from cell
  union all select cx, cy, h00, false, h11 - h01, h01 - h00 from cell),
met as (
  select *, dz - a * dx / 10 - b * dy / 10 as rate, ox / 10 - cx as u0, oy / 10 - cy as v0 from ray, side where ox is not null),
hit as (
  select *, u0 + t * dx / 10 as hu, v0 + t * dy / 10 as hv
  from (select *, (h00 + a * u0 + b * v0 - oz) / rate as t from met where abs(rate) > 1e-12) where t >= 0),
one as (
  select detection_id, k, min(t) as t, any_value(ox) as ox, any_value(oy) as oy, any_value(oz) as oz, any_value(dx) as dx, any_value(dy) as dy, any_value(dz) as dz
  from hit where hu between -1e-9 and 1 + 1e-9 and hv between -1e-9 and 1 + 1e-9 and (case when low then hv <= hu + 1e-9 else hv >= hu - 1e-9 end)
  group by detection_id, k)"""


@query("with " + _HITS + """
select detection_id, count(*) as hits, round(min(ox + t * dx), 4) as gx1, round(min(oy + t * dy), 4) as gy1, round(min(oz + t * dz), 4) as gz1,
  round(max(ox + t * dx), 4) as gx2, round(max(oy + t * dy), 4) as gy2, round(max(oz + t * dz), 4) as gz2
from one group by detection_id""")
def m11_terrain_boxes(spark, sf):
    """Box on the terrain of every detection whose rays meet it."""
    r = terrain.ground_boxes(_cameras(spark, sf), _vertices(spark, sf), 10.0, 800.0, 512.0, 800 / 512).where("hits > 0")
    return r.select("detection_id", "hits", *[F.round(f"g{c}{i}", 4).alias(f"g{c}{i}") for i in (1, 2) for c in "xyz"])


@query("with " + _HITS + """,
plane as (
  select detection_id, ox, case when dz < -1e-9 then ox + (mean - oz) / dz * dx end as gx, case when dz < -1e-9 then oy + (mean - oz) / dz * dy end as gy,
    lx, hx, ly, hy from ray, mesh),
r as (
  select detection_id, case when max(ox) is null then 'no_pose' when bool_or(coalesce(gx between lx and hx and gy between ly and hy, false)) then 'other'
    when count(gx) > 0 then 'beyond_mesh' else 'above_horizon' end as reason from plane group by detection_id)
select reason, count(*) as n from r where detection_id not in (select detection_id from one) group by reason""")
def m12_terrain_misses(spark, sf):
    """How many detections don't meet the terrain, by reason."""
    r = terrain.ground_boxes(_cameras(spark, sf), _vertices(spark, sf), 10.0, 800.0, 512.0, 800 / 512)
    return r.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _inverse_sql() -> str:
    """Positions of all detections in the zones of their flights, back to degrees: the published inverse series."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    up = " - ".join(["xi", *[f"{b!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(beta, 1)]])
    out = " - ".join(["eta", *[f"{b!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(beta, 1)]])
    phi = " + ".join(["chi", *[f"{x!r}::double * sin({2 * j} * chi)" for j, x in enumerate(delta, 1)]])
    return f"""with p as (
  select detection_id, flight_id % 60 + 1 as zone, detection_id % 2 = 1 as south, gx1 - 500000 as e, gy1 as north from geo join det using (detection_id)),
x as (select *, (north - case when south then 10000000 else 0 end) / {a!r}::double as xi, e / {a!r}::double as eta from p),
y as (select *, {up} as u, {out} as o from x),
z as (select *, asin(sin(u) / cosh(o)) as chi from y)
select detection_id, round(zone * 6 - 183 + degrees(atan2(sinh(o), cos(u))), 9) as lon, round(degrees({phi}), 9) as lat from z"""


@query(_inverse_sql())
def m16_from_utm(spark, sf):
    """Degrees of every georeferenced detection, each flight in a zone of its own, every other one in the south."""
    p = d.geo(spark, sf).join(d.detections(spark, sf).select("detection_id", "flight_id"), "detection_id")
    epsg = F.col("flight_id") % 60 + F.when(F.col("detection_id") % 2 == 1, 32701).otherwise(32601)
    at = p.select("detection_id", geometry.from_utm(F.col("gx1"), F.col("gy1"), epsg).alias("p"))
    return at.select("detection_id", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("""with p as (
  select detection_id, detection_id % 3590 / 10.0::double - 179.5 as lon, detection_id % 1600 / 10.0::double - 80 as lat from det)
select detection_id, round(lon, 6) as lon, round(lat, 6) as lat, true as within_a_millimetre from p""")
def m16_round_trip(spark, sf):
    """Positions in all zones and both halves, to UTM and back."""
    i = F.col("detection_id")
    p = d.detections(spark, sf).select("detection_id", (i % 3590 / 10.0 - 179.5).alias("lon0"), (i % 1600 / 10.0 - 80).alias("lat0"))
    u = geometry.to_utm(F.col("lon0"), F.col("lat0"))
    p = p.select("*", u.alias("u"), geometry.utm_epsg(F.col("lon0"), F.col("lat0")).alias("epsg"))
    p = p.withColumn("p", geometry.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("epsg")))
    metres = 6378137.0 * math.pi / 180
    off = F.hypot((F.col("p.lon") - F.col("lon0")) * F.cos(F.radians("lat0")) * metres, (F.col("p.lat") - F.col("lat0")) * metres)
    return p.select("detection_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), (off < 0.001).alias("within_a_millimetre"))


@query("""
with c as (
  select distinct flight_id, obj as pos, obj * 40 as start_frame, obj * 40 + 60 + flight_id % 7 as end_frame, (obj - 7) / 10.0::double as tz from det where obj % 4 < 3),
r as (
  select det.detection_id, c.pos, c.tz, row_number() over (partition by detection_id order by c.pos) as k
  from det left join c on c.flight_id = det.flight_id and det.frame between start_frame and end_frame)
select detection_id, pos, coalesce(tz, 0.0::double) as tz from r where k = 1""")
def j8_correction_by_flight(spark, sf):
    """Every detection with the first correction of its own flight that holds its frame."""
    x = d.detections(spark, sf)
    ranges = x.where("obj % 4 < 3").selectExpr("flight_id", "obj as pos", "obj * 40 as start_frame", "obj * 40 + 60 + flight_id % 7 as end_frame", "(obj - 7) / 10D as tz").distinct()
    r = joins.first_range(x, ranges, by="flight_id")
    return r.select("detection_id", "range.pos", F.coalesce("range.tz", F.lit(0.0)).alias("tz"))


@query("""
with s as (
  select distinct frame as seg_id, (frame * 7 % 190)::double as ax, (frame * 3 % 400)::double as ay, (frame * 11 % 190)::double as bx, (frame * 5 % 400)::double as by_
  from det where frame % 5 = 0),
p as (select detection_id as id, (x1 + x2) / 2 / 4 as x, (y1 + y2) / 2 as y from det),
f as (
  select id, seg_id, greatest(0.0::double, least(1.0::double, case when ax = bx and ay = by_ then 0.0::double
    else ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) end)) as t, x, y, ax, ay, bx, by_ from p, s),
g as (select id, seg_id, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) as d from f)
select id, round(min(d), 6) as distance from g where d <= 8 group by id""")
def j23_nearest_diagonal(spark, sf):
    """Distance of every detection to the nearest of many slanted segments, which are entered along their way."""
    x = d.detections(spark, sf)
    s = x.where("frame % 5 = 0").selectExpr(
        "frame as seg_id", "cast(frame * 7 % 190 as double) as ax", "cast(frame * 3 % 400 as double) as ay", "cast(frame * 11 % 190 as double) as bx", "cast(frame * 5 % 400 as double) as by_"
    ).distinct()
    r = joins.nearest_segment(x.selectExpr("detection_id as id", "(x1 + x2) / 2 / 4 as x", "(y1 + y2) / 2 as y"), s, 8.0)
    return r.select("id", F.round("distance", 6).alias("distance"))


@query("""
with p as (
  select flight_id, frame, min(detection_id) as i, to_timestamp(min(t_us) // 1000000) at time zone 'UTC' as ts from det where frame % 4 = 0 group by 1, 2)
select flight_id, frame, case when i % 11 in (3, 7) then null else strftime(ts, '%Y:%m:%d %H:%M:%S') end as taken,
  case when i % 11 in (3, 7) then null else round(hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double, 6) end as hour from p""")
def s19_photo_times(spark, sf):
    """Times of photos, written as files of three kinds and two byte orders, some without a time or cut off, and read back."""
    ts = F.date_format(F.timestamp_seconds(F.floor(F.min("t_us") / 1_000_000)), "yyyy:MM:dd HH:mm:ss")
    p = d.detections(spark, sf).where("frame % 4 = 0").select("flight_id", "frame", "detection_id", "t_us").repartition(spread(spark), "flight_id").groupBy("flight_id", "frame").agg(F.min("detection_id").alias("i"), ts.alias("ts"))

    def files(frames):
        for f in frames:
            rows = []
            for flight, frame, i, taken in f.itertuples(index=False):
                block = photos.tagged_tiff(None if i % 11 == 3 else taken, i % 2 == 0)
                block = block[:-9] if i % 11 == 7 else block
                kind = ("jpg", "tif", "png")[i % 3]
                content = {"jpg": photos.tagged_jpeg, "tif": bytes, "png": photos.tagged_png}[kind](block)
                rows.append((f"flight_id={flight}/{frame}.{kind}", content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    folder = binary_files(p.select("flight_id", "frame", "i", "ts").mapInPandas(files, "path string, content binary"), "photos")
    r = photos.photo_times(spark, f"{folder}/*")
    place = [F.regexp_extract("file", r"flight_id=(\d+)/(\d+)\.", k).cast("long").alias(n) for k, n in ((1, "flight_id"), (2, "frame"))]
    return r.select(*place, "taken", F.round(photos.hours(F.col("taken")), 6).alias("hour"))


@query("""
with p as (select flight_id * 1000000 + frame // 20 as transect_id, x, y from poses where x is not null),
i as (
  select *, sum(case when x - prev <= 30 then 0 else 1 end) over (partition by transect_id order by x) as island
  from (select *, lag(x) over (partition by transect_id order by x) as prev from p))
select transect_id, 4 as corners, round(min(x) - 15, 4) as lx, round(max(x) + 15, 4) as hx, round(min(y) - 15, 4) as ly, round((max(x) - min(x) + 30) * 30, 4) as area, false as hole
from i group by transect_id, island""")
def r22_union_outlines(spark, sf):
    """Rings around what the footprints of each transect cover."""
    pt = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    f = d.poses(spark, sf).where("x is not null").withColumn("ring", F.array(pt(-15.0, -15.0), pt(15.0, -15.0), pt(15.0, 15.0), pt(-15.0, 15.0)))
    r = outlines.union_outlines(f.withColumn("transect_id", F.expr("flight_id * 1000000 + frame div 20")), "transect_id", F.col("ring"))
    edge = lambda f, c: F.round(f(F.col(f"ring.{c}")), 4)
    return r.select(
        "transect_id", F.size("ring").alias("corners"), edge(F.array_min, "x").alias("lx"), edge(F.array_max, "x").alias("hx"), edge(F.array_min, "y").alias("ly"),
        F.round("area", 4).alias("area"), "hole",
    )
