"""Times of photos: DateTimeOriginal from JPEG, TIFF and PNG files, read by a walk over their segments and directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import listed_files, spread

# Tags of the directory pointer and of the time, and the text type.
EXIF_DIRECTORY, TIME_ORIGINAL, ASCII, LONG = 0x8769, 0x9003, 2, 4
SUFFIXES = tuple(f"*.{s}" for s in ("jpg", "jpeg", "tif", "tiff", "png", "JPG", "JPEG", "TIF", "TIFF", "PNG"))
#: Entries that a directory is read up to; a file that claims more is broken.
ENTRIES = 4096


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure that holds a photo's tags: the file itself, or a segment of a JPEG, or a chunk of a PNG."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF or 0xD0 <= kind <= 0xD7 or kind == 1:  # padding and markers without a length
                at += 1 if kind == 0xFF else 2
                continue
            if kind in (0xDA, 0xD9):  # picture data, or the end
                return None
            size = struct.unpack_from(">H", data, at + 2)[0]
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack_from(">I", data, at)[0]
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _entries(block: bytes, at: int, order: str) -> dict[int, tuple[int, int, int]]:
    """Entries of a directory: tag to (type, count, place of the value)."""
    n = struct.unpack_from(order + "H", block, at)[0]
    out = {}
    for i in range(min(n, ENTRIES)):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        out.setdefault(tag, (kind, count, at + 10 + 12 * i))
    return out


def time_original(data: bytes) -> str | None:
    """The text of a photo's DateTimeOriginal; None without one, or where the file is broken."""
    try:
        block = tiff_block(data)
        if block is None or block[:4] not in (b"II*\0", b"MM\0*"):
            return None
        order = "<" if block[:2] == b"II" else ">"
        first = _entries(block, struct.unpack_from(order + "I", block, 4)[0], order)
        if EXIF_DIRECTORY not in first:
            return None
        entry = _entries(block, struct.unpack_from(order + "I", block, first[EXIF_DIRECTORY][2])[0], order).get(TIME_ORIGINAL)
        if entry is None or entry[0] != ASCII:
            return None
        _, count, at = entry
        if count > 4:
            at = struct.unpack_from(order + "I", block, at)[0]
        text = block[at : at + count]
        return text.split(b"\0")[0].decode("ascii") if len(text) == count else None
    except (struct.error, UnicodeDecodeError):
        return None


def photo_times(spark: SparkSession, path: str) -> DataFrame:
    """(file, taken) of the photos in a folder, ``taken`` as the file has it: null without a time, or where a file is broken."""
    files = listed_files(spark, path, SUFFIXES).repartition(spread(spark))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            taken = []
            for path in f["path"]:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as file:
                    taken.append(time_original(file.read()))
            yield pd.DataFrame({"file": f["path"], "taken": pd.Series(taken, dtype=object)})

    return files.mapInPandas(read, "file string, taken string")


def hours(taken: Column) -> Column:
    """Hour of day of a photo's time, with its fraction; null for a text of another form."""
    parts = [F.regexp_extract(taken, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})$", i) for i in range(1, 7)]
    valid = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", *parts[:3]), F.concat_ws(":", *parts[3:]))).isNotNull()
    h, m, s = (F.try_to_number(p, F.lit("99")).cast("double") for p in parts[3:])
    return F.when(valid, h + m / 60.0 + s / 3600.0)


def _directory(order: str, entries: list[tuple[int, int, int, bytes]]) -> bytes:
    return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + bytes(4)


def tagged_tiff(taken: str | None, big: bool) -> bytes:
    """A TIFF structure that holds nothing but a photo's time, in either byte order."""
    order = ">" if big else "<"
    word = lambda n: struct.pack(order + "I", n)
    head = (b"MM\0*" if big else b"II*\0") + word(8)
    text = b"" if taken is None else taken.encode("ascii") + b"\0"
    second = [] if taken is None else [(TIME_ORIGINAL, ASCII, len(text), word(26 + 18))]
    return head + _directory(order, [(EXIF_DIRECTORY, LONG, 1, word(26))]) + _directory(order, second) + text


def tagged_jpeg(block: bytes) -> bytes:
    """A JPEG's segments around a TIFF structure, without a picture."""
    exif = b"Exif\0\0" + block
    other = b"JFIF\0\x01\x01" + bytes(7)
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, other) + b"\xff" + segment(0xE1, exif) + b"\xff\xd9"


def tagged_png(block: bytes) -> bytes:
    """A PNG's chunks around a TIFF structure, without a picture."""
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")
