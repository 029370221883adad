"""Random transect routes on a planning grid: one seeded walk for each route, routes in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(rows: int, cols: int, steps: int, seed: int, loop: bool) -> list[tuple[int, int]]:
    """Grid nodes of a walk that prefers unvisited neighbours; a loop keeps enough steps to come back."""
    rng = np.random.default_rng(seed)
    at = home = (int(rng.integers(rows)), int(rng.integers(cols)))
    path, seen = [at], {at}
    for left in range(steps, 0, -1):
        near = [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        near = [n for n in near if 0 <= n[0] < rows and 0 <= n[1] < cols]
        if loop:
            near = [n for n in near if abs(n[0] - home[0]) + abs(n[1] - home[1]) <= left - 1]
        if not near:
            break
        fresh = [n for n in near if n not in seen] or near
        at = fresh[int(rng.integers(len(fresh)))]
        path.append(at)
        seen.add(at)
    return path


def random_routes(areas: DataFrame, spacing: float, steps: int, seed: int, loop: bool = False) -> DataFrame:
    """Routes over areas (area_id, routes, lx, ly, hx, hy): area_id, route, seq, x, y. Equal seeds give equal routes."""
    each = areas.withColumn("route", F.explode(F.sequence(F.lit(1).cast("long"), F.col("routes").cast("long"))))

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                n, m = int((r.hy - r.ly) // spacing) + 1, int((r.hx - r.lx) // spacing) + 1
                path = _walk(n, m, steps, seed * 1_000_003 + int(r.area_id) * 1009 + int(r.route), loop)
                out += [(r.area_id, r.route, i, r.lx + c * spacing, r.ly + w * spacing) for i, (w, c) in enumerate(path)]
            yield pd.DataFrame(out, columns=["area_id", "route", "seq", "x", "y"])

    return each.mapInPandas(run, "area_id long, route long, seq long, x double, y double")
