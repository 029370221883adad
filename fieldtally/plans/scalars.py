"""Queries over scalar functions: geometry, text, dates, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from . import domain as d
from .domain import sql

Q: dict = {}
X = "(detection_id % 400)::double"
BOX = lambda: [F.col(c) for c in ('x1', 'y1', 'x2', 'y2')]


def scalar(name: str, columns, text: dict[str, str]) -> None:
    """A query of detection_id and some columns: their Spark expressions (made when it runs) and SQL over det."""

    def run(spark, sf):
        return d.detections(spark, sf).select("detection_id", *[c.alias(k) for k, c in columns().items()])

    Q[name] = (run, sql("select detection_id, " + ", ".join(f"{s} as {k}" for k, s in text.items()) + " from det"))


id_ = lambda: F.col('detection_id')
v = lambda: (id_() % 400).cast('double')
r6 = lambda c: F.round(c, 6)
R = lambda s: f"round({s}, 6)"

_shift = lambda: [F.col('x1') + id_() % 30, F.col('y1') + id_() % 11, F.col('x2') + id_() % 30, F.col('y2') + id_() % 11]
_iw = "greatest(0, least(x2, x2 + detection_id % 30) - greatest(x1, x1 + detection_id % 30))"
_ih = "greatest(0, least(y2, y2 + detection_id % 11) - greatest(y1, y1 + detection_id % 11))"
scalar(
    "m1_iou",
    lambda: {"iou": r6(g.iou(BOX(), _shift()))},
    {"iou": R(f'case when {_iw} * {_ih} > 0 then {_iw} * {_ih} / (2 * (x2 - x1) * (y2 - y1) - {_iw} * {_ih}) else 0 end')},
)
_aff = lambda: g.affine(F.col('x1'), F.col('y1'), (0.8, 0.05, -0.05, 0.8, 30.0, -12.0))
scalar(
    "m2_affine",
    lambda: {"x": r6(_aff()['x']), "y": r6(_aff()['y'])},
    {"x": R('0.8 * x1 + 0.05 * y1 + 30'), "y": R('-0.05 * x1 + 0.8 * y1 - 12')},
)
_sc = lambda: g.size_scale(F.lit(640.0), F.lit(512.0), id_() % 5 * 100.0, F.lit(1024.0))
scalar(
    "m5_size_scale",
    lambda: {"sx": r6(_sc()['sx']), "sy": r6(_sc()['sy'])},
    {"sx": R('case when detection_id % 5 > 0 then 640.0::double / (detection_id % 5 * 100) else 1 end'), "sy": R('case when detection_id % 5 > 0 then 0.5::double else 1 end')},
)
_L = lambda: F.array(*[F.struct(F.lit(float(a)).alias('x'), F.lit(float(b)).alias('y')) for a, b in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))])
_px = lambda: (id_() % 9 * 0.5).cast('double') + 0.25
_py = lambda: (F.expr('detection_id div 9 % 9') * 0.5).cast('double') + 0.25
_sx, _sy = "(detection_id % 9 * 0.5 + 0.25)", "(detection_id // 9 % 9 * 0.5 + 0.25)"
scalar(
    "m6_in_polygon",
    lambda: {"inside": g.in_polygon(_px(), _py(), _L())},
    {"inside": f'({_sx} < 4 and {_sy} < 2) or ({_sx} < 2 and {_sy} < 4)'},
)
_qx = lambda: (id_() % 9 * 0.5).cast('double')
_qy = lambda: (F.expr('detection_id div 9 % 9') * 0.5).cast('double')
_tx, _ty = "(detection_id % 9 * 0.5)", "(detection_id // 9 % 9 * 0.5)"
scalar(
    "m9_covers_boundary",
    lambda: {"inside": g.covers(_qx(), _qy(), _L())},
    {"inside": f'({_tx} <= 4 and {_ty} <= 2) or ({_tx} <= 2 and {_ty} <= 4)'},
)
_pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
scalar(
    "m7_segments_cross",
    lambda: {"cross": g.segments_cross(_pt(id_() % 5, F.lit(0)), _pt(id_() % 5, F.lit(4)), _pt(F.lit(0), id_() % 3), _pt(F.lit(2), id_() % 3))},
    {"cross": 'detection_id % 5 > 0 and detection_id % 5 < 2 and detection_id % 3 > 0'},
)
scalar(
    "m8_segment_touches",
    lambda: {"touches": g.segment_touches(_pt(id_() % 7 - 1, F.lit(-1)), _pt(id_() % 7 - 1, F.lit(5)), _L())},
    {"touches": 'detection_id % 7 - 1 >= 1 and detection_id % 7 - 1 < 4'},
)
_fp = lambda: g.flat_footprint(v(), v() * 2, F.lit(100.0), F.lit(50.0), v())
scalar(
    "m10_flat_footprint",
    lambda: {"x": F.round(_fp()[2]['x'], 4), "y": F.round(_fp()[2]['y'], 4)},
    {"x": f'round({X} + cos(radians({X} - case when {X} >= 360 then 360 else 0 end)) * 100 * tan(radians(25)) * 4 / 3 - sin(radians({X} - case when {X} >= 360 then 360 else 0 end)) * 100 * tan(radians(25)), 4)', "y": f'round(2 * {X} + sin(radians({X} - case when {X} >= 360 then 360 else 0 end)) * 100 * tan(radians(25)) * 4 / 3 + cos(radians({X} - case when {X} >= 360 then 360 else 0 end)) * 100 * tan(radians(25)), 4)'},
)
_ray = lambda: g.ground_ray(F.col('x1'), F.col('y1'), 800.0, 512.0, v(), v(), F.lit(100.0), F.lit(50.0), F.lit(0.0), F.lit(0.0), F.lit(10.0))
scalar(
    "m11_ground_ray",
    lambda: {"x": F.round(_ray()['x'], 4), "y": F.round(_ray()['y'], 4)},
    {"x": f'round({X} + 90 * (2 * x1 / 800 - 1) * tan(radians(25)), 4)', "y": f'round({X} + 90 * (1 - 2 * y1 / 512) * tan(radians(25)), 4)'},
)
_hit = lambda: [g.ground_ray(F.lit(a), F.lit(b), 100.0, 100.0, F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0), F.lit(0.0), (id_() % 4 * 40).cast('double'), F.lit(0.0)) for a, b in ((0.0, 0.0), (100.0, 0.0))]
scalar(
    "m12_miss_reason",
    lambda: {"reason": g.miss_reason(F.array(*_hit()), -60.0, 60.0, -60.0, 60.0)},
    {"reason": "case detection_id % 4 when 0 then 'other' when 1 then 'beyond_mesh' else 'above_horizon' end"},
)
_prj = lambda: g.project(F.col('x1'), F.col('y1'), F.lit(10.0), v(), v(), F.lit(100.0), F.lit(50.0), F.lit(0.0), F.lit(0.0), 800.0, 512.0)
scalar(
    "m13_project",
    lambda: {"px": F.round(_prj()['px'], 4), "py": F.round(_prj()['py'], 4)},
    {"px": f'round(((x1 - {X}) / 90 / tan(radians(25)) + 1) * 400, 4)', "py": f'round((1 - (y1 - {X}) / 90 / tan(radians(25))) * 256, 4)'},
)
_lon = lambda: v() * 0.9 - 180
_lat = lambda: v() * 0.4 - 80
_slon, _slat = f"({X} * 0.9::double - 180)", f"({X} * 0.4::double - 80)"
_epsg = f"(case when {_slat} >= 0 then 32600 else 32700 end + greatest(1, least(60, trunc(({_slon} + 180) / 6)::int + 1)))"
scalar(
    "m15_utm_epsg",
    lambda: {"epsg": g.utm_epsg(_lon(), _lat()), "valid": g.is_utm(g.utm_epsg(_lon(), _lat()))},
    {"epsg": _epsg, "valid": f'{_epsg} between 32601 and 32660 or {_epsg} between 32701 and 32760'},
)
_tile = lambda: g.tile(_lon(), _lat(), 12)
scalar(
    "m17_tile",
    lambda: {"tx": _tile()['x'], "ty": _tile()['y'], "lat": r6(g.tile_corner(id_() % 4096, id_() % 4096, 12)['lat'])},
    {"tx": f'trunc(({_slon} + 180) / 360 * 4096)::int', "ty": f'trunc((1 - asinh(tan(radians({_slat}))) / pi()) / 2 * 4096)::int', "lat": R('degrees(atan(sinh(pi() * (1 - 2 * (detection_id % 4096)::double / 4096))))')},
)
scalar(
    "m18_wrap",
    lambda: {"deg": r6(g.wrap_degrees(v() * 7 - 1000))},
    {"deg": R(f'({X} * 7 - 1000 + 180) - 360 * floor(({X} * 7 - 1000 + 180) / 360) - 180')},
)
scalar(
    "m19_circles_meet",
    lambda: {"meet": g.circles_meet(v(), F.lit(50.0), F.lit(120.0))},
    {"meet": f'{X} between 70 and 170'},
)
_ci = lambda: g.lognormal_interval(v() + 1, F.lit(0.3))
scalar(
    "m20_lognormal",
    lambda: {"low": r6(_ci()['low']), "high": r6(_ci()['high'])},
    {"low": R(f'({X} + 1) / exp(1.96::double * sqrt(ln(1.09::double)))'), "high": R(f'({X} + 1) * exp(1.96::double * sqrt(ln(1.09::double)))')},
)
_cw = lambda: g.crop_window(BOX(), 0.1, True)
scalar(
    "m21_crop_window",
    lambda: {"x1": r6(_cw()['x1']), "y2": r6(_cw()['y2'])},
    {"x1": R('(x1 + x2) / 2 - greatest(x2 - x1, y2 - y1) * 1.2 / 2'), "y2": R('(y1 + y2) / 2 + greatest(x2 - x1, y2 - y1) * 1.2 / 2')},
)
_ub = lambda: g.unit_box(BOX(), 800.0, 512.0)
scalar(
    "m22_unit_box",
    lambda: {"line": F.format_string('%.6f %.6f %.6f %.6f', F.bround(_ub()['cx'], 6), F.bround(_ub()['cy'], 6), F.bround(_ub()['w'], 6), F.bround(_ub()['h'], 6))},
    {"line": "printf('%.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 800, (y1 + y2) / 2 / 512, (x2 - x1) / 800, (y2 - y1) / 512)"},
)
_wr = lambda: g.world_to_raster(F.col('x1'), F.col('y1'), 10.0, 400.0, 0.5)
scalar(
    "m23_world_to_raster",
    lambda: {"col": _wr()['col'], "row": _wr()['row']},
    {"col": '(x1 - 10) / 0.5::double', "row": '(400 - y1) / 0.5::double'},
)
scalar(
    "m26_focal_length",
    lambda: {"f": r6(g.diagonal_focal(v() / 4 + 20, 640.0, 512.0))},
    {"f": R(f'sqrt(640.0::double * 640 + 512 * 512) / 2 / tan(radians({X} / 4 + 20) / 2)')},
)
_m2 = lambda: v() * v() * v()
_sm2 = f"({X} * {X} * {X})"
scalar(
    "m27_area_text",
    lambda: {"area": g.area_text(_m2())},
    {"area": f"case when {_sm2} >= 1e6 then printf('%.2f km2', {_sm2} / 1e6) when {_sm2} >= 1e4 then printf('%.2f ha', {_sm2} / 1e4) else printf('%.0f m2', {_sm2}) end"},
)
_or = lambda: g.usable_origin(v(), v() / 5)
scalar(
    "m28_usable_origin",
    lambda: {"x": _or()['x'], "y": r6(_or()['y'])},
    {"x": f'case when {X} <= 180 then 0 else {X} end', "y": R(f'case when {X} <= 180 then 0 else {X} / 5 end')},
)
_pb = lambda: g.padded_bounds(F.col('x1'), F.col('y1'), v(), v(), 3.0)
scalar(
    "m29_padded_bounds",
    lambda: {"lx": _pb()['lx'], "hy": _pb()['hy']},
    {"lx": f'least(x1, {X}) - 3', "hy": f'greatest(y1, {X}) + 3'},
)
scalar(
    "m30_range_gap",
    lambda: {"gap": g.range_gap(id_() % 50, id_() % 50 + 5, id_() % 30, id_() % 30 + 2)},
    {"gap": 'greatest(0, detection_id % 30 - (detection_id % 50 + 5), detection_id % 50 - (detection_id % 30 + 2))'},
)
scalar(
    "f16_sees_tile",
    lambda: {"seen": g.sees_tile(F.col('x1'), F.col('y1'), id_() % 30 * 1.0, F.lit(50.0), (100.0, 100.0, 300.0, 200.0))},
    {"seen": 'detection_id % 30 < 1 or (x1 - greatest(100, least(300, x1)))^2 + (y1 - greatest(100, least(200, y1)))^2 <= (2.5 * (detection_id % 30) * tan(radians(25)))^2'},
)
scalar(
    "f14_f9_validity",
    lambda: {"utm": g.is_utm((id_() % 200 + 32550).cast('int')), "placed": ~((id_() % 3 == 0) & (id_() % 5 == 0))},
    {"utm": '(detection_id % 200 + 32550) between 32601 and 32660 or (detection_id % 200 + 32550) between 32701 and 32760', "placed": 'not (detection_id % 3 = 0 and detection_id % 5 = 0)'},
)
scalar(
    "t1_slug",
    lambda: {"slug": t.slug(F.concat(F.lit(' Roe  Deer! '), F.col('source_class'))), "none": t.slug(F.lit('--!'))},
    {"slug": "'roe-deer-' || source_class", "none": "'species'"},
)
scalar(
    "t2_epsg",
    lambda: {"epsg": t.epsg(F.concat(F.lit(' epsg:'), (32600 + id_() % 60).cast('string'))), "bad": t.epsg(F.lit('EPSG:x'))},
    {"epsg": '(32600 + detection_id % 60)::int', "bad": 'null::int'},
)
scalar(
    "t3_iso_utc",
    lambda: {"iso": t.iso_utc(id_() * 1000 + 1717000000), "none": t.iso_utc(F.lit(None).cast('long'))},
    {"iso": "strftime(make_timestamp((detection_id * 1000 + 1717000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')", "none": "''"},
)
scalar(
    "t4_epoch",
    lambda: {"epoch": t.epoch(t.iso_utc(id_() * 1000 + 1717000000)), "bad": t.epoch(F.lit('soon'))},
    {"epoch": '(detection_id * 1000 + 1717000000)::double', "bad": 'null::double'},
)
_ts = lambda: F.timestamp_seconds(id_() * 977)
_sts = "make_timestamp(detection_id * 977 * 1000000)"
scalar(
    "t5_hour_of_day",
    lambda: {"hour": r6(t.hour_of_day(_ts()))},
    {"hour": R(f'hour({_sts}) + minute({_sts}) / 60.0::double + second({_sts}) / 3600.0::double')},
)
scalar(
    "t7_resolved_attributes",
    lambda: {"sex": F.try_element_at(t.resolved(F.concat(F.lit('{"sex":"'), (id_() % 4).cast('string'), F.lit('","collar":"R-1"}')), {'sex': ('unknown', 'female', 'male')}), F.lit('sex'))},
    {"sex": "case detection_id % 4 when 0 then 'unknown' when 1 then 'female' when 2 then 'male' else '3' end"},
)
scalar(
    "t8_value_id",
    lambda: {"id": t.value_id(F.when(id_() % 3 == 0, 'Female').when(id_() % 3 == 1, 'bull').otherwise('cow'), ('unknown', 'female', 'male'), {'bull': 2})},
    {"id": 'case detection_id % 3 when 0 then 1::bigint when 1 then 2 end'},
)
scalar(
    "t9_fingerprint",
    lambda: {"print": t.fingerprint([('b', F.col('source_class')), ('a', id_())])},
    {"print": 'substr(sha256(\'{"a":"\' || detection_id || \'","b":"\' || source_class || \'"}\'), 1, 16)'},
)
_ring = lambda: F.array(_pt(id_() % 5, F.lit(0)), _pt(F.lit(1), F.lit(1)), _pt(F.lit(2), F.lit(0)), _pt(F.lit(0), F.lit(0)))
scalar(
    "t10_closed_ring",
    lambda: {"points": F.size(t.closed_ring(_ring())).cast('long')},
    {"points": 'case when detection_id % 5 = 0 then 4::bigint else 5 end'},
)
scalar(
    "t12_remarks",
    lambda: {"text": t.remarks(F.create_map(F.lit('b'), F.col('source_class'), F.lit('a'), id_().cast('string')))},
    {"text": "'a=' || detection_id || '; b=' || source_class"},
)
scalar(
    "t13_taxon_url",
    lambda: {"url": t.taxon_url(F.when(id_() % 2 == 0, id_()))},
    {"url": "case when detection_id % 2 = 0 then 'https://www.gbif.org/species/' || detection_id end"},
)
scalar(
    "t14_vector_key",
    lambda: {"name": t.vector_key(id_()), "back": t.vector_id(t.vector_key(id_())), "bad": t.vector_id(F.lit('det_x'))},
    {"name": "'det_' || detection_id", "back": 'detection_id', "bad": 'null::bigint'},
)
scalar(
    "t15_repository",
    lambda: {"repo": t.repository(F.lit('org/model@v2'))['repo'], "revision": t.repository(F.when(id_() % 2 == 0, 'org/model@v2').otherwise('org/model'))['revision']},
    {"repo": "'org/model'", "revision": "case when detection_id % 2 = 0 then 'v2' end"},
)
scalar(
    "t17_rounding",
    lambda: {"r": F.bround(id_() % 100 * 0.5, 0)},
    {"r": 'round_even((detection_id % 100) * 0.5::double, 0)'},
)
scalar(
    "s25_config_truth",
    lambda: {"eq1": t.truthy((id_() % 3).cast('string'), 'eq1'), "ne0": t.truthy((id_() % 3).cast('string'), 'ne0')},
    {"eq1": 'detection_id % 3 = 1', "ne0": 'detection_id % 3 <> 0'},
)
scalar(
    "f13_has_attribute",
    lambda: {"has": F.col('attributes').contains('"k"') & F.get_json_object('attributes', '$.k').isNotNull()},
    {"has": 'attributes like \'%"k"%\' and (attributes->>\'$.k\') is not null'},
)
scalar(
    "f4_box_centre",
    lambda: {"cx": (F.col('x1') + F.col('x2')) / 2, "cy": (F.col('y1') + F.col('y2')) / 2},
    {"cx": '(x1 + x2) / 2', "cy": '(y1 + y2) / 2'},
)


def m3_affine_fit(spark, sf):
    p = d.detections(spark, sf).withColumn("qx", 0.8 * F.col("x1") + 0.05 * F.col("y1") + 30 + F.col("detection_id") % 3).withColumn("qy", -0.05 * F.col("x1") + 0.8 * F.col("y1") - 12)
    fit = p.groupBy("modality").agg(*g.affine_fit("x1", "y1", "qx", "qy"))
    return fit.select("modality", *[F.round(c, 4).alias(c) for c in ("a", "b", "tx", "c", "d", "ty", "rmse")])


_cov = lambda a, b: f"covar_pop({a}, {b})"
Q["m3_affine_fit"] = (m3_affine_fit, sql(
    "with p as (select *, 0.8 * x1 + 0.05 * y1 + 30 + detection_id % 3 as qx, -0.05 * x1 + 0.8 * y1 - 12 as qy from det), "
    "m as (select modality, covar_pop(x1,x1) as xx, covar_pop(y1,y1) as yy, covar_pop(x1,y1) as xy, covar_pop(x1,qx) as xq, covar_pop(y1,qx) as yq, covar_pop(x1,qy) as xr, covar_pop(y1,qy) as yr, covar_pop(qx,qx) as qq, covar_pop(qy,qy) as rr, avg(x1) as mx, avg(y1) as my, avg(qx) as mq, avg(qy) as mr from p group by 1), "
    "s as (select *, (xq*yy - yq*xy) / (xx*yy - xy*xy) as a, (yq*xx - xq*xy) / (xx*yy - xy*xy) as b, (xr*yy - yr*xy) / (xx*yy - xy*xy) as c, (yr*xx - xr*xy) / (xx*yy - xy*xy) as d from m) "
    "select modality, round(a, 4) as a, round(b, 4) as b, round(mq - a*mx - b*my, 4) as tx, round(c, 4) as c, round(d, 4) as d, round(mr - c*mx - d*my, 4) as ty, round(sqrt(greatest(qq - a*xq - b*yq + rr - c*xr - d*yr, 0)), 4) as rmse from s"
))
