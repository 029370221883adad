"""Survey tables derived from the benchmark tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One detection for each event: 20 to a frame, two modalities, 15 objects to a flight.
_DET = {
    "detection_id": ("event_id", None), "frame": ("event_id div 20", "event_id // 20"),
    "modality": ("case when event_id % 2 = 0 then 't' else 'w' end", None),
    "flight_id": ("user_id div 15", "user_id // 15"), "obj": ("user_id % 15", None),
    "x1": ("cast((user_id % 15) * 40 + (event_id div 20) % 200 as double)", "cast((user_id % 15) * 40 + (event_id // 20) % 200 as double)"),
    "y1": ("cast((user_id % 15) * 30 + (event_id div 20) % 7 as double)", "cast((user_id % 15) * 30 + (event_id // 20) % 7 as double)"),
    "x2": ("cast((user_id % 15) * 40 + (event_id div 20) % 200 + 20 + event_id % 3 as double)", "cast((user_id % 15) * 40 + (event_id // 20) % 200 + 20 + event_id % 3 as double)"),
    "y2": ("cast((user_id % 15) * 30 + (event_id div 20) % 7 + 20 + event_id % 3 as double)", "cast((user_id % 15) * 30 + (event_id // 20) % 7 + 20 + event_id % 3 as double)"),
    "confidence": ("cast(event_id % 100 as double) / 100D", "cast(event_id % 100 as double) / 100.0::double"),
    "source_id": ("cast(1 + event_id % 2 as long)", "cast(1 + event_id % 2 as bigint)"), "source_class": ("event_type", None),
    "attributes": ("props", None),
    "t_us": ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
}


def detections(spark: SparkSession, sf: str, deal=lambda rows, *by: rows, by: tuple[str, ...] = ()) -> DataFrame:
    """One row an event. ``deal`` deals the events by expressions over their own columns, while a row is a few numbers yet."""
    events = deal(spark.read.parquet(f"{sf}/events.parquet"), *map(F.expr, by))
    return events.selectExpr(*[f"{v[0]} as {k}" for k, v in _DET.items()])


def class_mapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(s, c, k) for s in (1, 2) for c, k in (("click", 1), ("view", 5), ("error", -2), ("signup", -1))]
    return spark.createDataFrame(rows, "source_id long, source_class string, species_id long")


def species(spark: SparkSession, sf: str) -> DataFrame:
    from ..schema import SPECIES

    return spark.createDataFrame(list(SPECIES.items()), "species_id long, name string")


def geo(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf).where("detection_id % 10 <> 0 and detection_id % 97 <> 0")
    return d.selectExpr("detection_id", "500000 + x1 / 10D as gx1", "5300000 + y1 / 10D as gy1", "500000 + x2 / 10D as gx2", "5300000 + y2 / 10D as gy2")


def failures(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf).where("detection_id % 10 = 0 and detection_id % 97 <> 0")
    return d.selectExpr("detection_id", "case detection_id % 3 when 0 then 'above_horizon' when 1 then 'beyond_mesh' else 'no_pose' end as reason")


def track_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "builtin", 1, False), (2, "boxmot", 2, True), (3, "manual", 1, False)]
    return spark.createDataFrame(rows, "run_id long, kind string, generation long, is_active boolean")


def members(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf)
    track = "(flight_id * 15 + obj) * 10 + {} as track_id"
    picks = [(1, "detection_id % 3 <> 2"), (2, "detection_id % 3 <> 1"), (3, "detection_id % 15 = 1")]
    parts = [d.where(w).selectExpr(track.format(r), "detection_id", "false as interpolated") for r, w in picks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).select("track_id").distinct().selectExpr(
        "track_id", "track_id % 10 as run_id", "case when track_id div 10 % 4 = 3 then -2L else track_id div 10 % 4 end as species_id"
    )


def label_tracks(spark: SparkSession, sf: str) -> DataFrame:
    t = tracks(spark, sf).where("run_id = 2 and track_id div 10 % 5 = 0")
    return t.selectExpr("track_id div 10 as label_track_id", "track_id as origin_track_id", "case when track_id div 10 % 10 = 0 then null else track_id + 1 end as track_id", "4L as species_id")


def keyframes(spark: SparkSession, sf: str, deal=lambda rows, *by: rows) -> DataFrame:
    """One key frame for each track and frame; the detections are dealt by track before."""
    d = detections(spark, sf, deal, ("user_id div 15 * 15 + user_id % 15",)).where("detection_id % 7 = 0").selectExpr(
        "flight_id * 15 + obj as label_track_id", "frame", "detection_id", "x1", "y1", "x2", "y2", "detection_id % 5 = 0 as stop"
    )
    one = d.groupBy("label_track_id", "frame").agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "stop"), "detection_id").alias("k"))
    return one.select("label_track_id", "frame", "k.*")


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """One pose for each flight and frame."""
    return detections(spark, sf).selectExpr("flight_id", "frame as id").distinct().selectExpr(
        "flight_id", "id as frame",
        "case when id % 37 = 0 then null when (id div 20) % 2 = 0 then cast((id % 20) * 10 as double) else cast(190 - (id % 20) * 10 as double) end as x",
        "case when id % 37 = 0 then null else cast((id div 20) * 50 as double) end as y", "100D as z",
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Centre lines: one segment for every twenty frames of the survey, the third one reversed."""
    return detections(spark, sf).selectExpr("frame div 20 + 1 as id").distinct().selectExpr(
        "id as transect_id", "0 as seq", "case when id = 3 then 190D else 0D end as ax", "cast((id - 1) * 50 as double) as ay",
        "case when id = 3 then 0D else 190D end as bx", "cast((id - 1) * 50 as double) as by_",
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).selectExpr(
        "detection_id", "flight_id * 15 + obj as track_id", "(detection_id + obj) % 3 as class_index",
        "element_at(array('roe deer', 'red deer', 'chamois'), cast((detection_id + obj) % 3 + 1 as int)) as label",
    )


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(0, 10, 100, 1.0, 2.0), (1, 50, 300, None, 5.0), (2, 200, 210, 7.0, 7.0)]
    return spark.createDataFrame(rows, "pos int, start_frame long, end_frame long, tx double, rz double")


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as the queries' SQL does: whole numbers of its product with a power of ten, halves away from 0.

    ``F.round`` goes by the decimal text of a number, which is another half now and then, and takes several times as long.
    """
    v = c * 10.0**digits
    off = v - F.rint(v)
    away = F.when((v > 0) & (off == 0.5), 1.0).when((v < 0) & (off == -0.5), -1.0).otherwise(0.0)
    return (F.rint(v) + away) / 10.0**digits


def _sql_det() -> str:
    return "det as (select " + ", ".join(f"{v[1] or v[0]} as {k}" for k, v in _DET.items()) + " from events)"


CTE = ",\n".join([
    _sql_det(),
    "class_mapping as (select * from (values (1::bigint,'click',1::bigint),(1,'view',5),(1,'error',-2),(1,'signup',-1),(2,'click',1),(2,'view',5),(2,'error',-2),(2,'signup',-1)) v(source_id,source_class,species_id))",
    "species as (select * from (values (0::bigint,'animal'),(-1,'unknown'),(-2,'not-an-animal'),(1,'roe deer'),(2,'red deer'),(3,'fallow deer'),(4,'wild boar'),(5,'chamois'),(6,'fox'),(7,'hare'),(8,'bird'),(9,'other')) v(species_id,name))",
    "geo as (select detection_id, 500000 + x1/10.0::double as gx1, 5300000 + y1/10.0::double as gy1, 500000 + x2/10.0::double as gx2, 5300000 + y2/10.0::double as gy2 from det where detection_id % 10 <> 0 and detection_id % 97 <> 0)",
    "failures as (select detection_id, case detection_id % 3 when 0 then 'above_horizon' when 1 then 'beyond_mesh' else 'no_pose' end as reason from det where detection_id % 10 = 0 and detection_id % 97 <> 0)",
    "track_runs as (select * from (values (1::bigint,'builtin',1::bigint,false),(2,'boxmot',2,true),(3,'manual',1,false)) v(run_id,kind,generation,is_active))",
    "members as (select (flight_id*15+obj)*10+1 as track_id, detection_id from det where detection_id % 3 <> 2 union all select (flight_id*15+obj)*10+2, detection_id from det where detection_id % 3 <> 1 union all select (flight_id*15+obj)*10+3, detection_id from det where detection_id % 15 = 1)",
    "tracks as (select distinct track_id, track_id % 10 as run_id, case when track_id // 10 % 4 = 3 then -2 else track_id // 10 % 4 end as species_id from members)",
    "label_tracks as (select track_id // 10 as label_track_id, track_id as origin_track_id, case when track_id // 10 % 10 = 0 then null else track_id + 1 end as track_id, 4::bigint as species_id from tracks where run_id = 2 and track_id // 10 % 5 = 0)",
    "keyframes as (select label_track_id, frame, x1, y1, x2, y2, stop from (select flight_id*15+obj as label_track_id, frame, x1, y1, x2, y2, detection_id % 5 = 0 as stop, row_number() over (partition by flight_id*15+obj, frame order by detection_id) as r from det where detection_id % 7 = 0) where r = 1)",
    "poses as (select flight_id, i as frame, case when i % 37 = 0 then null when (i // 20) % 2 = 0 then ((i % 20) * 10)::double else (190 - (i % 20) * 10)::double end as x, case when i % 37 = 0 then null else ((i // 20) * 50)::double end as y, 100::double as z from (select distinct flight_id, frame as i from det))",
    "lines as (select i as transect_id, 0 as seq, case when i = 3 then 190::double else 0::double end as ax, ((i-1)*50)::double as ay, case when i = 3 then 0::double else 190::double end as bx, ((i-1)*50)::double as by_ from (select distinct frame // 20 + 1 as i from det))",
    "predictions as (select detection_id, flight_id*15+obj as track_id, (detection_id+obj) % 3 as class_index, (['roe deer','red deer','chamois'])[((detection_id+obj) % 3 + 1)::int] as label from det)",
    "corrections as (select * from (values (0,10::bigint,100::bigint,1.0::double,2.0::double),(1,50,300,null,5.0),(2,200,210,7.0,7.0)) v(pos,start_frame,end_frame,tx,rz))",
])


def sql(body: str) -> str:
    """A query over the tables above."""
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {CTE},\n" + body[15:]
    return f"with {CTE}" + (",\n" + body[5:] if body.lower().startswith("with ") else "\n" + body)
