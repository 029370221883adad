"""The stage graph of a survey: states, staleness, fingerprints. A small control table, kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Stages and what each needs.
NEEDS = {
    "frames": (), "detections": ("frames",), "georeferenced": ("detections",), "tracks": ("georeferenced",), "fov": ("frames",),
    "matches": ("tracks",), "embeddings": ("detections",), "classification": ("embeddings", "tracks"), "life_stage": ("classification",),
    "perpendicular": ("tracks", "fov"), "density": ("tracks",), "coverage": ("fov",), "population": ("tracks", "fov"),
    "flight_route": ("frames",), "export": ("classification",),
}
STATES = ("pending", "running", "complete", "failed", "stale")
#: A stage over both cameras goes stale with either one.
BOTH = "tw"


def dependents(stage: str) -> list[str]:
    """All stages that need a stage, directly or not, in graph order."""
    found = {stage}
    for name, needs in NEEDS.items():  # NEEDS lists a stage after what it needs
        if found & set(needs):
            found.add(name)
    return [n for n in NEEDS if n in found and n != stage]


@dataclass
class Stages:
    """States by (stage, modality). ``complete`` makes dependents of the same camera, or of both, stale."""

    rows: dict[tuple[str, str], dict] = field(default_factory=dict)

    def set(self, stage: str, modality: str, state: str, row_count: int | None = None, fingerprint: str | None = None) -> None:
        if stage not in NEEDS or state not in STATES:
            raise ValueError(f"{stage}: {state}")
        old = self.rows.get((stage, modality), {"generation": 0})
        generation = old["generation"] + (state == "complete")
        self.rows[stage, modality] = {"state": state, "row_count": row_count, "generation": generation, "fingerprint": fingerprint}

    def _stale(self, stage: str, modality: str) -> list[tuple[str, str]]:
        hit = [k for k in self.rows if k[0] in dependents(stage) and (k[1] in (modality, BOTH) or modality == BOTH) and self.rows[k]["state"] == "complete"]
        for k in hit:
            self.rows[k]["state"] = "stale"
        return hit

    def complete(self, stage: str, modality: str, row_count: int | None = None, fingerprint: str | None = None) -> list[tuple[str, str]]:
        """Record a run; returns what became stale."""
        self.set(stage, modality, "complete", row_count, fingerprint)
        return self._stale(stage, modality)

    def reconcile(self, exists) -> list[tuple[str, str]]:
        """Complete stages whose output is gone become pending, their dependents stale."""
        gone = [k for k, r in self.rows.items() if r["state"] == "complete" and not exists(*k)]
        for k in gone:
            self.rows[k]["state"] = "pending"
            self._stale(*k)
        return gone

    def reset(self, stage: str, modality: str, cascade: bool = False) -> list[tuple[str, str]]:
        """Forget a stage (and with ``cascade`` all that need it); returns what is to be deleted."""
        names = [stage, *(dependents(stage) if cascade else [])]
        hit = [k for k in self.rows if k[0] in names and k[1] in (modality, BOTH)]
        for k in hit:
            del self.rows[k]
        return hit

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, m, r["state"], r["row_count"], r["generation"], r["fingerprint"]) for (s, m), r in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "stage string, modality string, state string, row_count long, generation long, input_fingerprint string")


@dataclass
class Flights:
    """Registry of flights: unique names and folders, one of them active."""

    rows: list[dict] = field(default_factory=list)
    active: int | None = None

    def _check(self, name: str, folder: str, other: int | None = None) -> None:
        for i, r in enumerate(self.rows):
            if i != other and (r["name"].lower() == name.lower() or r["folder"].rstrip("/") == folder.rstrip("/")):
                raise ValueError(f"{name} or {folder} is taken")

    def add(self, name: str, folder: str, **settings) -> int:
        self._check(name, folder)
        self.rows.append({"name": name, "folder": folder, "settings": settings})
        self.active = len(self.rows) - 1
        return self.active

    def change(self, i: int, name: str | None = None, folder: str | None = None) -> None:
        r = self.rows[i]
        self._check(name or r["name"], folder or r["folder"], i)
        r.update(name=name or r["name"], folder=folder or r["folder"])

    def remove(self, i: int) -> None:
        del self.rows[i]
        if self.active is not None:
            self.active = None if not self.rows else min(self.active - (i < self.active), len(self.rows) - 1)

    def defaults(self, recording: tuple[str, ...] = ("video", "srt", "poses", "log")) -> dict:
        """Settings for a new flight: those of the active one, without its recording's inputs."""
        own = self.rows[self.active]["settings"] if self.active is not None else {}
        return {k: v for k, v in own.items() if k not in recording}
