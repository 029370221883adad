"""Tables of a survey project, seeds and fixed values."""

from __future__ import annotations

# Protected and seeded species, enum values, failure reasons.
FALLBACK_SPECIES, UNKNOWN_SPECIES, NOT_AN_ANIMAL = 0, -1, -2
SPECIES = {
    0: "animal", -1: "unknown", -2: "not-an-animal", 1: "roe deer", 2: "red deer", 3: "fallow deer", 4: "wild boar",
    5: "chamois", 6: "fox", 7: "hare", 8: "bird", 9: "other",
}
ENUMS = {"sex": ("unknown", "female", "male"), "age": ("unknown", "adult", "juvenile"), "occlusion": ("clear", "occluded")}
REASONS = ("above_horizon", "beyond_mesh", "no_pose", "projection_error", "legacy_invalid", "other")
VERSION = 3

TABLES = {
    "species": "species_id long, name string, protected boolean, scientific_name string, taxon_rank string, gbif_taxon_key long",
    "class_mapping": "source_id long, source_class string, species_id long",
    "detection_sources": "source_id long, kind string, model string, version string, generation long, config_hash string",
    "detections": "detection_id long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, species_id long, "
    "source_id long, source_class string, label_track_id long, attributes string",
    "detections_geo": "detection_id long, gx1 double, gy1 double, gz1 double, gx2 double, gy2 double, gz2 double",
    "georef_failures": "detection_id long, reason string",
    "track_runs": "run_id long, kind string, tracker string, generation long, created_at timestamp, is_active boolean",
    "tracks": "track_id long, run_id long, species_id long, attributes string",
    "track_members": "track_id long, detection_id long, interpolated boolean",
    "label_tracks": "label_track_id long, species_id long, origin_track_id long, track_id long, attributes string",
    "label_keyframes": "label_track_id long, frame long, x1 double, y1 double, x2 double, y2 double, stop boolean",
    "frame_predictions": "detection_id long, task string, label string, class_index long, confidence double",
    "stages": "stage string, modality string, state string, row_count long, generation long, input_fingerprint string",
}
