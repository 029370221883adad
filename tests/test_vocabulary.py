import math

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import correction, planning, vocabulary


def test_species_edits(spark):
    s = spark.createDataFrame([(0, "animal", True), (1, "roe deer", False), (2, "fox", False)], "species_id long, name string, protected boolean")
    rows = {"detections": spark.createDataFrame([(1,)], "species_id long")}
    assert vocabulary.add_species(s, "lynx").where("name = 'lynx'").first().species_id == 3
    with pytest.raises(ValueError):
        vocabulary.rename_species(s, 1, "FOX")
    with pytest.raises(vocabulary.InUse):
        vocabulary.delete_species(s, 1, rows)
    with pytest.raises(vocabulary.InUse):
        vocabulary.delete_species(s, 0, rows)
    assert vocabulary.delete_species(s, 2, rows).count() == 2


def test_fields_of_one_scope_only(spark):
    f = spark.createDataFrame([("collar", "detection", "string", None), ("collar", "track", "string", None)], "name string, scope string, type string, enum_id long")
    t = spark.createDataFrame([('{"collar":"R-1","old":"x"}',)], "attributes string")
    fields, tables = vocabulary.rename_field(f, {"detection": t, "track": t}, "collar", "detection", "tag")
    assert {(r.name, r.scope) for r in fields.collect()} == {("tag", "detection"), ("collar", "track")}
    assert "tag" in tables["detection"].first()[0] and "collar" in tables["track"].first()[0]
    assert vocabulary.prune(t, f, "track").first()[0] == '{"collar":"R-1"}'
    with pytest.raises(ValueError):
        vocabulary.add_field(f, "sex", "track", "enum")


def test_enum_values_keep_their_ids(spark):
    v = spark.createDataFrame([(1, 0, "unknown", 0), (1, 1, "female", 1)], "enum_id long, value_id long, label string, ordinal long")
    w = vocabulary.reorder(vocabulary.add_value(v, 1, "male"), 1, [2, 1, 0])
    assert [(r.value_id, r.label) for r in w.orderBy("ordinal").collect()] == [(2, "male"), (1, "female"), (0, "unknown")]


def test_height_and_yaw(spark):
    k, yaw = 1.1, 0.3
    pts = [("a", x, y, k * (math.cos(yaw) * x - math.sin(yaw) * y), k * (math.sin(yaw) * x + math.cos(yaw) * y)) for x, y in ((10.0, 4.0), (-6.0, 9.0), (3.0, -12.0))]
    pts += [("far", 1.0, 0.0, 50.0, 0.0), ("none", 0.0, 0.0, 1.0, 1.0)]
    r = {x.g: x for x in correction.height_and_yaw(spark.createDataFrame(pts, "g string, dx double, dy double, tx double, ty double"), "g", 80.0).collect()}
    assert r["a"].tz == pytest.approx(8.0, abs=1e-6) and r["a"].rz == pytest.approx(0.3, abs=1e-9) and r["a"].residual < 1e-5
    assert r["far"].tz is None and r["none"].tz is None


def test_routes_are_repeatable_and_loops_close(spark):
    a = spark.createDataFrame([(1, 3, 0.0, 0.0, 500.0, 500.0)], "area_id long, routes long, lx double, ly double, hx double, hy double")
    one = planning.random_routes(a, 50.0, 40, 7, loop=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, planning.random_routes(a.repartition(3), 50.0, 40, 7, loop=True).collect()))
    ends = one.groupBy("route").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b")).collect()
    assert len(ends) == 3 and all(r.a == r.b for r in ends)
