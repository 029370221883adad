"""Work that is done for many cells, rows or files at once, against plain versions of it."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import areas, joins, outlines, terrain, tracks
from fieldtally.operators.numerics import union_area
from fieldtally.plans import domain, registry
from fieldtally.sources import exports, legacy, photos, stores


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def polygons(r, n):
    return [[(r.randint(0, 12) / 2, r.randint(0, 12) / 2) for _ in range(r.choice([3, 4, 5]))] for _ in range(n)]


def test_cells_swept_at_once_are_those_swept_alone():
    r = random.Random(7)
    cells = [polygons(r, r.randint(1, 9)) for _ in range(200)]
    rings = [(c, p) for c, ps in enumerate(cells) for p in ps]
    points = np.asarray([q for _, p in rings for q in p])
    ring = np.repeat(np.arange(len(rings)), [len(p) for _, p in rings])
    got = areas.swept(points, ring, np.asarray([c for c, _ in rings])[ring], len(cells) + 1)
    assert got[:-1] == pytest.approx([union_area(ps) for ps in cells], abs=1e-9) and got[-1] == 0
    assert areas.swept(np.empty((0, 2)), np.empty(0, int), np.empty(0, int), 2).tolist() == [0, 0]


def test_a_cell_of_footprints_is_no_python_group(spark):
    box = F.expr("array(named_struct('x', x, 'y', 0D), named_struct('x', x + 30, 'y', 0D), named_struct('x', x + 30, 'y', 30D), named_struct('x', x, 'y', 30D))")
    f = spark.range(4000).selectExpr("id % 400 as g", "(id * 7 % 90) * 1D as x").withColumn("ring", box)
    got = areas.union_areas(f, "g", F.col("ring"))
    assert "FlatMapGroups" not in plan(got)
    xs = {}
    for x in f.select("g", "x").collect():
        xs.setdefault(x.g, set()).add(x.x)
    for x in got.collect():
        row = sorted(xs.pop(x.g))
        assert x.area == pytest.approx(30 * (30 + sum(min(30, b - a) for a, b in zip(row, row[1:]))))
    assert not xs


def test_equal_places_and_segments_meet_once(spark):
    points = spark.range(900).selectExpr("id", "(id % 3) * 4D as x", "1D as y")
    segments = spark.range(800).selectExpr("id + 5 as seg_id", "0D as ax", "(id % 2) * 3D as ay", "4D as bx", "(id % 2) * 3D as by_")
    got = joins.nearest_segment(points, segments, 8.0)
    assert plan(got).count("Aggregate ") == 3  # places, segments, and the best of each place
    assert {(x.id, x.seg_id, x.distance) for x in got.collect()} == {(i, 5, 1.0 if i % 3 < 2 else 17**0.5) for i in range(900)}


def test_cells_along_a_ray_need_no_join(spark):
    v = spark.range(40 * 40).selectExpr("id % 40 as ix", "id div 40 as iy", "(id * 7 % 23) * 1D as h")
    rays = spark.createDataFrame([(1, 5.0, 5.0, 60.0, 1.0, 0.9, -0.2), (2, 5.0, 5.0, 60.0, 1.0, 0.9, 0.2)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = terrain.first_hits(rays, v, 10.0)
    assert plan(got).count("Join ") == 2  # tiles of 256 and of 16 cells in width
    assert [x.ray for x in got.collect()] == [1]


def test_few_points_that_become_many_rows_are_many_tasks(spark):
    p = spark.range(400).selectExpr("id % 40 as k", "id * 100 as frame", "0D as x1", "0D as y1", "1D as x2", "1D as y2", "1D as confidence", "0 as cls", "false as stop")
    for rows in (tracks.fill_gaps(p, ["k"]), tracks.between_keyframes(p, "k")):
        n = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(n) > 4 and sum(x.n for x in n) == 40 * (9 * 4000 + 1)


@pytest.mark.parametrize("name", ["w1_fill_gaps", "w2_keyframe_boxes", "e11_labels_csv"])
def test_rows_of_a_track_are_shuffled_once(spark, name):
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


@pytest.mark.parametrize("name", ["w1_fill_gaps", "w2_keyframe_boxes", "e11_labels_csv"])
def test_events_are_shuffled_as_two_numbers(spark, name):
    # boxes and classes are derived behind the shuffle, from event_id and user_id
    text = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    behind = text[text.index("Exchange ") :]
    assert "Project" not in behind and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in behind


def test_numbers_with_two_digits(spark):
    r = random.Random(2)
    values = [r.uniform(0, 900) for _ in range(500)] + [k / 200 for k in range(400)] + [8.345, 1.005, 0.285, 0.995, 99.995, -0.001, -3.337, 1e7, 12345678.125, 1e17, float("inf"), float("nan"), None, 0.0]
    v = spark.createDataFrame([(x,) for x in values], "v double").select(exports.two_digits(F.col("v")).alias("got"), F.format_string("%.2f", F.bround("v", 2)).alias("want"))
    assert all(x.got == x.want for x in v.collect())


def test_numbers_are_rounded_as_in_sql(spark):
    r = random.Random(4)
    values = [264 + k / 640 for k in range(640)] + [k / 128 - 20 for k in range(4000)] + [r.uniform(-900, 900) for _ in range(4000)] + [0.0, -0.0, 1e15 + 0.3, 1e300, float("inf"), -float("inf"), None]
    v = spark.createDataFrame([(x,) for x in values], "v double").select("v", domain.rounded(F.col("v"), 6).alias("got"), F.round("v", 6).alias("other"))
    rows = v.collect()
    want = dict(duckdb.sql("select v, round(v, 6) from (select unnest($1::double[]) as v)", params=[values]).fetchall())
    assert all(x.got == want[x.v] for x in rows if x.v != 1e300) and any(x.other != want[x.v] for x in rows)


def test_a_label_line_is_put_together_at_once(spark):
    r = random.Random(3)
    values = [r.uniform(0, 1200) for _ in range(400)] + [k / 200 for k in range(400)] + [8.345, 0.995, 99.995, 999.994, 999.996, -0.001, -3.337, 1e7, 12345678.125, 1e17, float("inf"), float("nan"), None, -0.0]
    rows = [(r.choice([7, 123456789, None]), r.choice([0, 4711, None]), *[r.choice(values) for _ in range(4)], r.random() < 0.5) for _ in range(3000)]
    rows += [(1, 2, v, 1.25, v, 3.5, True) for v in values]
    b = spark.createDataFrame(rows, "label_track_id long, frame long, x1 double, y1 double, x2 double, y2 double, is_key boolean")
    want = F.concat_ws(",", "label_track_id", "frame", *[F.format_string("%.2f", F.bround(c, 2)) for c in ("x1", "y1", "x2", "y2")], F.col("is_key").cast("int"))
    got = exports.labels_csv(b)
    assert plan(got).count("format_string(") == 1 and "lpad(" not in plan(got)
    assert sorted(x.value for x in got.collect()) == sorted(x.v for x in b.select(want.alias("v")).collect())


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a=1/00000001.tiff", "a=1/00000007.tif", "a=2/deep/00000005.tiff", "a=2/00000004.txt", "a=2/_00000006.tiff", "b/00000008.tiff", "00000009.tiff"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"II*")
    found = lambda path: sorted(x.frame for x in legacy.frame_images(spark, path, 0, 100).collect())
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert found(f"{root}/a=*") == [1, 5, 7] and found(root) == [1, 5, 7, 8, 9] and found(f"{root}/*/*.tif*") == [1, 7, 8]
        assert found(f"{root}/a=1/00000001.tiff") == [1] and found(f"{root}/none*") == []
    assert "binaryFile" not in plan(legacy.frame_images(spark, str(tmp_path), 0, 9))
    (tmp_path / "b/1.jpg").write_bytes(photos.tagged_jpeg(photos.tagged_tiff("2024:05:06 07:08:09", True)))
    (tmp_path / "b/2.png").write_bytes(b"no photo")
    got = photos.photo_times(spark, f"{tmp_path}/b")
    assert "binaryFile" not in plan(got) and {x.file[-5:]: x.taken for x in got.collect()} == {"1.jpg": "2024:05:06 07:08:09", "2.png": None, ".tiff": None}


def test_a_partition_of_a_store_is_one_file(spark, tmp_path):
    x = spark.range(0, 4000, 1, 8).selectExpr("id as detection_id", "id as frame", "0D as x1", "0D as y1", "1D as x2", "1D as y2", "1D as confidence", "1L as source_id", "'c' as source_class", "'{}' as attributes", "id % 10 as flight_id", "'t' as modality")
    stores.write_table(x, str(tmp_path), "detections")
    assert len(list(tmp_path.glob("detections/*/*/*.parquet"))) == 10 and stores.read_table(spark, str(tmp_path), "detections").count() == 4000


def test_a_ring_of_an_outline_is_no_python_group(spark):
    box = F.expr("array(named_struct('x', x, 'y', 0D), named_struct('x', x + 30, 'y', 0D), named_struct('x', x + 30, 'y', 30D), named_struct('x', x, 'y', 30D))")
    f = spark.sql("select 1L as g, 0D as x union all select 1L, 10D union all select 1L, 50D union all select 2L, 0D")
    got = outlines.union_outlines(f, "g", box)
    assert "FlatMapGroups" not in plan(got)
    assert sorted((x.g, round(x.area, 6), x.hole) for x in got.collect()) == [(1, 900.0, False), (1, 1200.0, False), (2, 900.0, False)]
