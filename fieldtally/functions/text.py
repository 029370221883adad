"""String, date and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Letters and digits of a name, all else as single hyphens; ``species`` if nothing is left."""
    s = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("species"))


def epsg(text: Column) -> Column:
    """Number of ``EPSG:n`` or ``n``; null for anything else."""
    return F.regexp_replace(F.upper(F.trim(text)), "^EPSG:", "").try_cast("int")


def iso_utc(epoch: Column) -> Column:
    """ISO 8601 text of seconds since 1970, or an empty text."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def epoch(iso: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 text with or without offset (UTC), null for other texts."""
    return F.try_to_timestamp(iso).cast("double")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0


def mean_hour(hour: Column) -> Column:
    """Mean of hours of day on the clock's circle, from -12 to 12: hours around midnight have a mean around midnight."""
    angle = F.radians(15 * hour)
    return F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))) / 15


def zone_offset(ts: Column, zone: str) -> Column:
    """Hours that a time zone is ahead of UTC at a moment."""
    return (F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(ts)) / 3600.0


def resolved(attributes: Column, enums: dict[str, tuple[str, ...]]) -> Column:
    """JSON attributes as a map with enum ids replaced by labels; broken JSON gives an empty map."""
    m = F.coalesce(F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def label(k: Column, v: Column) -> Column:
        out = v
        for name, labels in enums.items():
            listed = F.array(*[F.lit(x) for x in labels])
            out = F.when(k == name, F.coalesce(F.get(listed, v.try_cast("int")), v)).otherwise(out)
        return out

    return F.transform_values(m, label)


def value_id(label: Column, labels: tuple[str, ...], configured: dict[str, int]) -> Column:
    """Id of a label: the configured one, else its place among the labels without regard to case."""
    own = F.create_map(*[F.lit(x) for kv in configured.items() for x in kv]) if configured else F.create_map().cast("map<string,int>")
    place = F.array_position(F.array(*[F.lit(x.lower()) for x in labels]), F.lower(label)) - 1
    return F.coalesce(F.try_element_at(own, label).cast("long"), F.when(place >= 0, place))


def fingerprint(pairs: list[tuple[str, Column]]) -> Column:
    """First 16 hex digits of the SHA-256 of a config, written as JSON with sorted keys and no blanks."""
    parts = [F.concat(F.lit(f'"{k}":"'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"')) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def closed_ring(ring: Column) -> Column:
    """A ring of at least three points with its first point repeated at the end; null for fewer."""
    ends = (F.element_at(ring, 1)["x"] == F.element_at(ring, -1)["x"]) & (F.element_at(ring, 1)["y"] == F.element_at(ring, -1)["y"])
    return F.when(F.size(ring) >= 3, F.when(ends, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))


def remarks(m: Column) -> Column:
    """``key=value`` pairs of a map, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def taxon_url(key: Column) -> Column:
    return F.when(key.isNotNull(), F.format_string("https://www.gbif.org/species/%d", key))


def vector_key(detection_id: Column) -> Column:
    return F.concat(F.lit("det_"), detection_id.cast("string"))


def vector_id(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^det_(-?\d+)$", 1), F.lit("")).try_cast("long")


def repository(text: Column) -> Column:
    """Struct (repo, revision) of ``repo@revision``; revision null if not given."""
    return F.struct(F.split_part(text, F.lit("@"), F.lit(1)).alias("repo"), F.nullif(F.split_part(text, F.lit("@"), F.lit(2)), F.lit("")).alias("revision"))


def truthy(text: Column, rule: str) -> Column:
    """Stored booleans: ``eq1`` is true for 1 alone, ``ne0`` for anything but 0 and an empty text."""
    return F.coalesce(text == "1", F.lit(False)) if rule == "eq1" else F.coalesce(~text.isin("0", ""), F.lit(False))


def parse_any(text: Column, formats: list[str]) -> Column:
    """Timestamp by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
