"""Times of photos against files made byte by byte, broken ones included, and another reader where there is one."""

import io

import pytest
from pyspark.sql import functions as F

from fieldtally.sources import photos


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("wrap", [bytes, photos.tagged_jpeg, photos.tagged_png])
def test_times_in_both_byte_orders(big, wrap):
    data = wrap(photos.tagged_tiff("2024:05:06 07:08:09", big))
    assert photos.time_original(data) == "2024:05:06 07:08:09"
    assert photos.time_original(wrap(photos.tagged_tiff(None, big))) is None
    for n in range(len(data)):  # cut off anywhere: the time or nothing, and no error
        assert photos.time_original(data[:n]) in (None, "2024:05:06 07:08:09")


def test_other_bytes_have_no_time():
    for data in (b"", b"II*\0", b"MM\0*\xff\xff\xff\xff", b"\xff\xd8\xff\xe1\x00\x02", b"\xff\xd8\xff\xda", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\xff" * 99):
        assert photos.time_original(data) is None


def test_another_reader_sees_the_same_time():
    image = pytest.importorskip("PIL.Image")
    exif = image.Exif()
    exif[0x8769] = {0x9003: "2020:01:02 03:04:05"}
    for kind in ("JPEG", "TIFF", "PNG"):
        out = io.BytesIO()
        image.new("L", (2, 2)).save(out, kind, exif=exif)
        assert photos.time_original(out.getvalue()) == "2020:01:02 03:04:05"


def test_hours(spark):
    rows = [("2024:05:06 07:30:36", 7.51), ("2024:05:06 24:00:00", None), ("2024:13:06 01:00:00", None), ("yesterday", None), (None, None), ("", None)]
    got = spark.createDataFrame(rows, "taken string, want double").withColumn("h", photos.hours(F.col("taken"))).collect()
    assert all(x.h == pytest.approx(x.want) if x.want else x.h is None for x in got)
