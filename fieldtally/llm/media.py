"""Media columns: lossless image files in archives, and a data source that reads them by byte ranges.

A payload becomes an 8-bit greyscale PNG of 192 samples a row, and the images of a partition go into archives of
bounded size (stored ZIP members; the images are compressed already). The data source plans byte ranges over the
archives of a folder: a range owns the members whose header begins inside it, so that ranges need no coordination,
and a lost task reads its range again. Members stream out in Arrow batches of bounded size. A member that can't be
read is tried again alone, from its offset; one that stays unreadable gives a row with its error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_path, stored

WIDTH = 192
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
#: Fixed value: the first bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, header_offset long, member string, media binary, error string"


def padded(data: bytes) -> bytes:
    """The data with blanks up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b" ")


def to_image(data: bytes) -> bytes:
    """PNG of the padded data; the unpadded length is kept in a text chunk."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    rows[:, 1:] = samples

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    parts = [(b"IHDR", head), (b"tEXt", b"length\x00%d" % len(data)), (b"IDAT", zlib.compress(rows.tobytes(), 4)), (b"IEND", b"")]
    return SIGNATURE + b"".join(chunk(k, b) for k, b in parts)


def from_image(media: bytes) -> tuple[bytes, int]:
    """Samples of such an image, as stored, and the unpadded length. ValueError if it is broken."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, length, shape = 8, [], -1, (0, 0)
    while at + 12 <= len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"tEXt" and data.startswith(b"length\x00"):
            length = int(data[7:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:].tobytes(), length


def feature(samples: bytes) -> str:
    """Shape, mean and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float((counts * np.arange(256)).sum() / len(samples))
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.3f};bits={abs(float((share * np.log2(share)).sum())):.3f}"


def write_archives(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """Write ``text`` (null: empty) of each row as a member named ``place/key``, or ``place`` where the key is null.

    One row an archive: archive, members. An empty table makes no archive, and a text of any length is one member.
    Of ``docs``, only key and text are read.

    An archive's name comes from its partition and number alone and it is renamed into place when complete, so a task
    that runs again replaces its own files. Rows that repeat, and null keys, make members of their own.
    """

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part, made = TaskContext.get().partitionId(), []
        rows = ((k, t) for b in batches for k, t in zip(b.column(0), b.column(1)))
        row = next(rows, None)
        place = 0
        while row is not None:
            name = f"{base}/part-{part:06d}-{len(made):05d}.zip"
            hidden = f"{base}/_{uuid.uuid4().hex}"
            size = members = 0
            with files.open_output_stream(hidden) as out, zipfile.ZipFile(out, "w") as archive:
                while row is not None and size < ARCHIVE_BYTES:
                    media = to_image((row[1].as_py() or "").encode())
                    named = f"{place}/{row[0].as_py()}" if row[0].is_valid else str(place)
                    archive.writestr(zipfile.ZipInfo(named), media)
                    size, members, place = size + len(media) + 200, members + 1, place + 1
                    row = next(rows, None)
            files.move(hidden, name)
            made.append((name, members))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([n for n, _ in made], pa.string()), "members": pa.array([m for _, m in made], pa.int64())})

    sent = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return stored(sent.mapInArrow(run, "archive string, members long"), "archives")


class Range(InputPartition):
    """Bytes ``start`` to ``end`` of an archive."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, size: int, names: list[str] | None):
        self.folder, self.size, self.names = folder, size, names

    def partitions(self) -> list[Range]:
        files, base = fs.FileSystem.from_uri(self.folder)
        if self.names is None:
            found = [f for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.path.endswith(".zip")]
        else:
            found = files.get_file_info([f"{base}/{n}" for n in self.names])
        found.sort(key=lambda f: f.path)
        return [Range(f.path, at, at + self.size) for f in found for at in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        source = files.open_input_file(partition.path)
        archive = zipfile.ZipFile(source)
        own = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, size = [], 0
        for m in sorted(own, key=lambda m: m.header_offset):
            media, error = None, None
            for attempt in range(ATTEMPTS):
                try:
                    media, error = archive.read(m), None  # seeks to the member's offset and checks its CRC
                    break
                except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as x:
                    error = f"{type(x).__name__}: {x}"
                    if attempt + 1 < ATTEMPTS:
                        source = files.open_input_file(partition.path)
                        archive.fp = source
            rows.append((partition.path, m.header_offset, m.filename, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"archive": pa.string(), "header_offset": pa.int64(), "member": pa.string(), "media": pa.binary(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options rangeBytes, and names: a JSON list of the archives to read."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        names = json.loads(self.options["names"]) if "names" in self.options else None
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), names)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, names: list[str] | None = None) -> DataFrame:
    """All members of the named archives in a folder, or of all archives there; see SCHEMA. No archive, no members."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archives").option("rangeBytes", str(range_bytes))
    return (reader if names is None else reader.option("names", json.dumps(names))).load(folder)


def measured(members: DataFrame) -> DataFrame:
    """Members with their payload (samples read back), n_bytes (unpadded) and feature; an unreadable image adds to ``error``.

    Needs columns media and error; payload, n_bytes and feature are replaced, others pass through. Null media give nulls,
    an empty table an empty one.
    """
    members = members.drop("payload", "n_bytes", "feature")
    names = members.columns

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows = []
                for media, error in zip(b.column(names.index("media")), b.column(names.index("error"))):
                    try:
                        samples, length = from_image(media.as_py()) if media.is_valid else (None, None)
                        rows.append((samples, length, feature(samples) if samples else None, error.as_py()))
                    except (ValueError, zlib.error, struct.error) as x:
                        rows.append((None, None, None, f"{type(x).__name__}: {x}"))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))]
                others = [c for c in names if c != "error"]
                yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in others] + made, others + ["payload", "n_bytes", "feature", "error"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in members.dtypes if c != "error")
    return members.mapInArrow(run, f"{kinds}, payload binary, n_bytes long, feature string, error string")


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows written to archives in the shared folder and read back: key (string), media, payload, n_bytes, feature, error.

    One row for each row of ``docs``, repeated ones and null keys included; a null text is an empty one. Further
    columns of ``docs`` are not written: join them by key. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    # archives that a task which was lost has left behind are not among those that were committed
    made = write_archives(docs, key, text, folder)
    names = sorted(r.name for r in made.select(F.substring_index("archive", "/", -1).alias("name")).collect())
    members = read_archives(spark, folder, names=names)
    at = F.instr("member", "/")
    key_of = F.when(at > 0, F.substring(F.col("member"), at + 1, F.length("member")))
    return measured(members.select(key_of.alias("key"), "media", "error"))
