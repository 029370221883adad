import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.sources import exports, legacy, stores
from fieldtally.streaming import tracking, windows


def test_legacy_text_blocks(spark, tmp_path):
    (tmp_path / "detections.txt").write_text("# frame x1 y1 x2 y2 conf cls\n0 1 1 2 2 .9 1\n1 bad\n2 1 1 2 2\n# LABELS\n3 1 1 2 2 .5 7\n")
    r = legacy.detections_text(spark, str(tmp_path / "detections.txt")).orderBy("frame").collect()
    assert [(x.frame, x.confidence, x.source_class, x.block) for x in r] == [(0, 0.9, "1", "detector"), (2, 1.0, "0", "detector"), (3, 0.5, "7", "label")]
    (tmp_path / "geo.txt").write_text("0 5 1 1 0 2 2 0 .9 1\n1 5 -1 1 0 2 2 0 .9 1\n")
    assert [x.failed for x in legacy.georeferenced_text(spark, str(tmp_path / "geo.txt")).orderBy("idx").collect()] == [False, True]
    (tmp_path / "fov.txt").write_text("0 3 0 0 1 1 0 1 1 1 1\n4 0\n")
    assert [len(x.ring) for x in legacy.fov_text(spark, str(tmp_path / "fov.txt")).orderBy("frame").collect()] == [3, 0]


def test_json_files(spark, tmp_path):
    (tmp_path / "poses.json").write_text(json.dumps({"images": [{"imagefile": "a.jpg", "location": [1, 2, 3], "rotation": [0, 0, 9], "fovy": [50], "timestamp": "2024-05-29T16:26:40Z"}, {"imagefile": "b.jpg", "timestamp": "1717000000"}]}))
    p = legacy.poses_json(spark, str(tmp_path / "poses.json")).orderBy("frame").collect()
    assert (p[0].x, p[0].fovy, p[1].x) == (1.0, 50.0, None) and p[0].ts == p[1].ts
    (tmp_path / "route.json").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [0, 0]}}, {"geometry": {"type": "LineString", "coordinates": [[1, 2, 3], [4, 5, 6]]}}]}))
    assert [(x.seq, x.x, x.y) for x in legacy.route_geojson(spark, str(tmp_path / "route.json")).collect()] == [(0, 1.0, 2.0), (1, 4.0, 5.0)]
    (tmp_path / "log.csv").write_text("datetime(utc),latitude,longitude,isVideo\n2024-05-01 10:30:00,48.1,14.2,1\n2024-05-01 10:31:00,0,0,1\n,48.3,14.1,0\n")
    log = legacy.flight_log(spark, str(tmp_path / "log.csv"))
    assert log.count() == 2 and tuple(legacy.gps_bounds(log).first()) == (48.1, 48.3, 14.1, 14.2)


def test_npz_vectors(spark, tmp_path):
    np.savez(tmp_path / "f.npz", det_5=np.ones(4, "float32"), det_9=np.zeros(4, "float32"))
    assert {x.detection_id: sum(x.embedding) for x in legacy.vectors_npz(spark, str(tmp_path)).collect()} == {5: 4.0, 9: 0.0}


def test_sqlite_store(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.gpkg") as c:
        c.execute("CREATE TABLE detections (detection_id INTEGER PRIMARY KEY, frame INTEGER, x1 REAL, source_class TEXT)")
        c.executemany("INSERT INTO detections VALUES (?, ?, ?, ?)", [(i, i // 3, i / 2, "a") for i in range(1, 101)])
    df = stores.read_sqlite(spark, str(tmp_path / "s.gpkg"), "detections")
    assert df.rdd.getNumPartitions() == 8 and df.agg(F.count("*"), F.sum("x1")).first()[:] == (100, 2525.0)


def test_parquet_store_replaces_only_its_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1, "t"), (2, 0, 1, "w")], "detection_id long, frame long, flight_id long, modality string")
    root = str(tmp_path / "store")
    stores.write_table(rows, root, "detections")
    stores.write_table(rows.where("modality = 'w'").withColumn("detection_id", F.lit(9).cast("long")), root, "detections")
    assert sorted(x.detection_id for x in stores.read_table(spark, root, "detections").collect()) == [1, 9]
    with pytest.raises(ValueError):
        stores.write_table(rows.withColumn("extra", F.lit(1)), root, "detections")
    with pytest.raises(Exception, match="repeated"):
        stores.assert_unique(rows.union(rows), "detection_id").count()


def test_exports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.0, 1.0, 3.0, 5.0, 0.9, 1, 7, 10.0, 10.0, 12.0, 12.0), (2, 1, 1.0, 1.0, 3.0, 5.0, 0.8, -2, None, None, None, None, None)], "detection_id long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, species_id long, track_id long, gx1 double, gy1 double, gx2 double, gy2 double")
    classes = spark.createDataFrame([(1, 0, "roe deer")], "species_id long, class_index long, name string")
    exports.export("coco", rows, str(tmp_path / "c"), classes, 640, 512)
    a = spark.read.json(str(tmp_path / "c/annotations")).collect()
    assert len(a) == 1 and a[0].area == 8.0
    exports.export("mot", rows, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m/mot")).first().value == "1,7,1.00,1.00,2.00,4.00,0.9000,-1,-1,-1"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = windows.append_once(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    w = windows.windowed_counts(stream)
    w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == 1000


def test_streamed_tracks(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "t", f, f * 2 + k, 10.0 * k, 0.0, 10.0 * k + 8, 8.0, 1) for f in range(4) for k in range(2)]
    spark.createDataFrame(rows, "flight_id long, modality string, frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, cls long").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    tracking.track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(x) for x in spark.sql("select track_id, count(*) from tracked group by 1").collect()} == {(1, 4), (2, 4)}
