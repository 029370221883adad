"""Cross-modal matching and tracking: registration, candidate pairs, one-to-one assignment, frame-by-frame tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import cut, merge_groups
from .numerics import assign, sparse_pairs

BLOCKED = 1e9
#: Gates of a match.
MIN_SHARED, GATE_PX, MIN_CONFIDENCE = 8, 28.0, 0.20


def fit_affine(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Least-squares affine (3 x 2) from points p to q; None for fewer than three or collinear points."""
    return fit_affine_rows(np.column_stack([p, np.ones(len(p))]), q, len(p)) if len(p) else None


def fit_affine_rows(a: np.ndarray, q: np.ndarray, n: int) -> np.ndarray | None:
    """The same of n rows (x, y, 1), or of their triangle."""
    if n < 3:
        return None
    if np.linalg.matrix_rank(a, tol=1e-6) < 3:
        return None
    m = np.linalg.lstsq(a, q, rcond=None)[0]
    return m if np.isfinite(m).all() else None


def _apply(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.column_stack([p, np.ones(len(p))]) @ m


def _assigned(m: np.ndarray, by_frame) -> tuple[np.ndarray, np.ndarray]:
    """Points of the boxes that are assigned one to one within each frame."""
    ps, qs = [], []
    for _, g in by_frame:
        w = g.drop_duplicates("id_w").sort_values("id_w")[["xw", "yw"]].to_numpy(float)
        t = g.drop_duplicates("id_t").sort_values("id_t")[["xt", "yt"]].to_numpy(float)
        d = np.hypot(*(_apply(m, w)[:, None, :] - t[None, :, :]).transpose(2, 0, 1))
        for i, j in assign(d):
            ps.append(w[i])
            qs.append(t[j])
    return np.asarray(ps), np.asarray(qs)


def _lone(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Points of the frames with one box on either side."""
    counts = pairs.groupby("frame_t").agg(nt=("id_t", "nunique"), nw=("id_w", "nunique"))
    lone = pairs[pairs["frame_t"].map((counts.nt == 1) & (counts.nw == 1))]
    return lone[["xw", "yw"]].to_numpy(float), lone[["xt", "yt"]].to_numpy(float)


def register(pairs: pd.DataFrame, size_t=(1.0, 1.0), size_w=(1.0, 1.0), rounds: int = 5) -> tuple[np.ndarray, float, int]:
    """Affine from colour to thermal pixels, its RMSE and pairs.

    pairs: all pairs of boxes on mapped frames (frame_t, id_t, id_w, xt, yt, xw, yw). Frames with one box on either
    side start the fit; without such frames, the ratio of the frame sizes does. Then one-to-one assignment within
    frames and refitting take turns while the error falls.
    """
    by_frame = pairs.groupby("frame_t")
    p, q = _lone(pairs)
    m, used = fit_affine(p, q), len(p)
    error = np.sqrt(((_apply(m, p) - q) ** 2).sum(axis=1).mean()) if m is not None else np.inf
    if m is None:
        m, used = np.asarray([[size_t[0] / size_w[0], 0], [0, size_t[1] / size_w[1]], [0, 0]], float), 0
    for _ in range(rounds):
        p, q = _assigned(m, by_frame)
        new = fit_affine(p, q) if len(p) else None
        if new is None:
            break
        e = np.sqrt(((_apply(new, p) - q) ** 2).sum(axis=1).mean())
        if not e < error - 1e-6:
            break
        m, error, used = new, e, len(p)
    return m, float(error), used


def triangle(rows: np.ndarray) -> np.ndarray:
    """The 5 x 5 triangle of rows (x, y, 1, x', y'): those of parts, one below the other, give that of the whole."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, 5))
    return np.vstack([r, np.zeros((5 - len(r), 5))])


def fit_triangle(r: np.ndarray, n: int) -> tuple[np.ndarray | None, float]:
    """``fit_affine`` of n pairs and its RMSE from their triangle."""
    m = fit_affine_rows(r[:, :3], r[:, 3:], n)
    return m, float(np.sqrt((r[3:, 3:] ** 2).sum() / n)) if m is not None else np.inf


AFFINE = "a double, b double, tx double, c double, d double, ty double, rmse double, pairs long"
#: Frames of a flight in a group; groups are merged, none is dropped.
FRAMES = 2000


def registrations(pairs: DataFrame, by: str, size_t=(1.0, 1.0), size_w=(1.0, 1.0), rounds: int = 5) -> DataFrame:
    """One affine for each flight, from the pairs on all its mapped frames: ``register`` with the frames in groups.

    A group of FRAMES frames is reduced to the triangle of its assigned pairs and a flight's triangles are merged, which
    is the least-squares fit of all its pairs. The affines so far are a table by flight that each round joins.
    """
    kind = f"{by} {dict(pairs.dtypes)[by]}"
    state = ["a", "b", "tx", "c", "d", "ty", "rmse", "pairs", "live"]
    part = f"{kind}, {AFFINE}, live boolean, r array<double>, n long"
    start = [size_t[0] / size_w[0], 0.0, 0.0, 0.0, size_t[1] / size_w[1], 0.0]
    columns = [by, "frame_t", "id_t", "id_w", "xt", "yt", "xw", "yw"]
    frames = cut(pairs.select(*columns, F.floor(F.col("frame_t") / FRAMES).alias("_part")))

    def matrix(row) -> np.ndarray:
        return np.asarray(row[state[:6]].tolist(), float).reshape(2, 3).T

    def flat(m: np.ndarray) -> list[float]:
        return m.T.ravel().tolist()

    def reduced(g: pd.DataFrame, p: np.ndarray, q: np.ndarray, now: list) -> pd.DataFrame:
        r = triangle(np.column_stack([p, np.ones(len(p)), q])) if len(p) else triangle(p)
        return pd.DataFrame([[g[by].iloc[0], *now, r.ravel().tolist(), len(p)]], columns=[by, *state, "r", "n"])

    def seeds(g: pd.DataFrame) -> pd.DataFrame:
        return reduced(g, *_lone(g), [*start, np.inf, 0, True])

    def assigned(g: pd.DataFrame) -> pd.DataFrame:
        return reduced(g, *_assigned(matrix(g.iloc[0]), g.groupby("frame_t")), g[state].iloc[0].tolist())

    def merged(g: pd.DataFrame, first: bool) -> pd.DataFrame:
        now, n = g[state].iloc[0].tolist(), int(g["n"].sum())
        m, e = fit_triangle(triangle(np.vstack([np.asarray(r, float).reshape(5, 5) for r in g["r"]])), n)
        if m is not None and (first or e < now[6] - 1e-6):
            now = [*flat(m), e, n, True]
        elif not first:
            now[-1] = False
        return pd.DataFrame([[g[by].iloc[0], *now]], columns=[by, *state])

    def settled(parts: DataFrame, first: bool) -> DataFrame:
        return cut(parts.groupBy(by).applyInPandas(lambda g: merged(g, first), f"{kind}, {AFFINE}, live boolean"))

    now = settled(frames.groupBy(by, "_part").applyInPandas(seeds, part), True)
    done = []
    for _ in range(rounds):
        parts = frames.join(now, by).groupBy(by, "_part").applyInPandas(assigned, part)
        now = settled(parts, False)
        done.append(now.where("not live"))
        now = now.where("live")
        if now.isEmpty():
            break
    for x in done:
        now = now.unionByName(x)
    return now.drop("live")


def rmse(pairs: DataFrame, m: tuple[float, ...], by: str) -> DataFrame:
    """Root mean square error and number of pairs of an affine (a, b, tx, c, d, ty) in each group."""
    dx = m[0] * F.col("xw") + m[1] * F.col("yw") + m[2] - F.col("xt")
    dy = m[3] * F.col("xw") + m[4] * F.col("yw") + m[5] - F.col("yt")
    return pairs.groupBy(by).agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"), F.count(F.lit(1)).alias("pairs"))


def inverse_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (x, y): how much larger a box is on the other side of an affine, by the norms of its columns."""
    return F.struct((1 / F.sqrt(a * a + c * c)).alias("x"), (1 / F.sqrt(b * b + d * d)).alias("y"))


def candidates(pairs: DataFrame, affines: DataFrame, by: str) -> DataFrame:
    """Track pairs with shared frames, exact median distance after registration and mean confidences."""
    p = pairs.join(affines, by)
    dx = F.col("a") * F.col("xw") + F.col("b") * F.col("yw") + F.col("tx") - F.col("xt")
    dy = F.col("c") * F.col("xw") + F.col("d") * F.col("yw") + F.col("ty") - F.col("yt")
    p = p.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return p.groupBy(by, "track_t", "track_w").agg(
        F.count_distinct("frame_t").alias("shared"), F.expr("percentile(dist, 0.5)").alias("median_dist"),
        F.avg("conf_t").alias("conf_t"), F.avg("conf_w").alias("conf_w"),
    )


def gate(found: DataFrame, shared: int = MIN_SHARED, px: float = GATE_PX, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Candidates with ``reason``: null if they pass all gates, else the first gate that fails."""
    weak = (F.col("conf_t") < confidence) | (F.col("conf_w") < confidence)
    reason = F.when(F.col("shared") < shared, "too_few_frames").when(F.col("median_dist") >= px, "too_far").when(weak, "low_confidence")
    return found.withColumn("reason", reason)


def one_to_one(admitted: DataFrame, by: str) -> DataFrame:
    """Assignment of least total distance within each flight; pairs that aren't candidates are never matched.

    As many pairs as can be, and of these the ones of least distance. Tracks that no chain of candidates connects don't
    bear on each other, so each connected group is solved on its own, on its candidates alone; a group is one task.
    """
    name = lambda side: F.concat_ws(":", F.col(by).cast("string"), F.lit(side), F.col(f"track_{side}").cast("string"))
    pairs = admitted.select(by, "track_t", "track_w", "median_dist").withColumns({"a": name("t"), "b": name("w")})
    groups = merge_groups(pairs.select("a", "b"))
    dealt = pairs.join(groups.hint("merge"), F.col("a") == F.col("node"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        least = g.groupby(["track_t", "track_w"], sort=True)["median_dist"].min()
        rows = [(g[by].iloc[0], t, w, least[t, w]) for t, w in sparse_pairs([(t, w, c) for (t, w), c in least.items()], BLOCKED)]
        return pd.DataFrame(rows, columns=[by, "track_t", "track_w", "median_dist"])

    return dealt.groupBy("root").applyInPandas(solve, f"{by} {dict(admitted.dtypes)[by]}, track_t long, track_w long, median_dist double")


def match_summary(found: DataFrame, matched: DataFrame, by: str) -> DataFrame:
    """Tracks of either camera, confirmed pairs and unmatched tracks of each flight."""
    n = found.groupBy(by).agg(F.count_distinct("track_t").alias("tracks_t"), F.count_distinct("track_w").alias("tracks_w"))
    m = matched.groupBy(by).agg(F.count(F.lit(1)).alias("confirmed"))
    out = n.join(m, by, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(0)))
    return out.withColumn("unmatched", F.col("tracks_t") + F.col("tracks_w") - 2 * F.col("confirmed"))


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    common = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    total = area(a)[:, None] + area(b)[None, :] - common
    return np.where((common > 0) & (total > 0), common / np.where(total > 0, total, 1), 0.0)


def best_pairs(overlap: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one pairs of the most and then the largest overlaps, among those of ``least`` or more.

    Boxes that nothing connects do not bear on each other, so only connected groups of them are solved together.
    """
    rows, cols = np.nonzero(overlap >= least)
    if not len(rows):
        return []
    by_row, by_col = np.bincount(rows, minlength=overlap.shape[0]), np.bincount(cols, minlength=overlap.shape[1])
    alone = (by_row[rows] == 1) & (by_col[cols] == 1)
    out = list(zip(rows[alone].tolist(), cols[alone].tolist()))
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    left = list(zip(rows[~alone].tolist(), cols[~alone].tolist()))
    for i, j in left:
        group[root(~j)] = root(i)
    members: dict[int, tuple[set, set]] = {}
    for i, j in left:
        r, c = members.setdefault(root(i), (set(), set()))
        r.add(i)
        c.add(j)
    for r, c in members.values():
        r, c = sorted(r), sorted(c)
        part = overlap[np.ix_(r, c)]
        out += [(r[i], c[j]) for i, j in assign(np.where(part < least, 1e6, 1 - part)) if part[i, j] >= least]
    return out


class Tracker:
    """Tracks by overlap from frame to frame; ``max_age`` counts frames with detections that a track missed (-1: for ever)."""

    def __init__(self, least_iou: float = 0.3, max_age: int = 5, class_aware: bool = True):
        self.least, self.max_age, self.aware = least_iou, max_age, class_aware
        self.boxes, self.classes = np.empty((0, 4)), np.empty(0, np.int64)
        self.ids, self.ages, self.next = np.empty(0, np.int64), np.empty(0, np.int64), 1

    def step(self, boxes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Track ids of one frame's detections."""
        out = np.zeros(len(boxes), np.int64)
        missed = np.ones(len(self.ids), bool)
        if len(boxes) and len(self.ids):
            overlap = _iou(boxes, self.boxes)
            if self.aware:
                overlap[classes[:, None] != self.classes[None, :]] = 0.0
            for i, j in best_pairs(overlap, self.least):
                out[i], missed[j] = self.ids[j], False
                self.boxes[j], self.ages[j] = boxes[i], 0
        fresh = np.flatnonzero(out == 0)
        out[fresh] = self.next + np.arange(len(fresh))
        self.next += len(fresh)
        self.ages[missed] += 1
        keep = np.ones(len(self.ids), bool) if self.max_age < 0 else self.ages <= self.max_age
        self.boxes = np.concatenate([self.boxes[keep], boxes[fresh]])
        self.classes = np.concatenate([self.classes[keep], classes[fresh]])
        self.ids = np.concatenate([self.ids[keep], out[fresh]])
        self.ages = np.concatenate([self.ages[keep], np.zeros(len(fresh), np.int64)])
        return out


def track(detections: DataFrame, by: list[str], **settings) -> DataFrame:
    """Members of each flight and camera's own tracker run: by, track_id, detection_id, frame.

    detections: by, frame, detection_id, x1..y2, cls. Sequential along frames, parallel over ``by``.
    """
    kinds = dict(detections.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, g = Tracker(**settings), g.sort_values(["frame", "detection_id"])
        frames, boxes, classes = g["frame"].to_numpy(), g[["x1", "y1", "x2", "y2"]].to_numpy(float), g["cls"].to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(frames)) + 1
        ids = [t.step(b, c) for b, c in zip(np.split(boxes, cuts), np.split(classes, cuts))]
        return g.assign(track_id=np.concatenate(ids))[[*by, "track_id", "detection_id", "frame"]]

    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", track_id long, detection_id long, frame long"
    # by number of groups, not by bytes: a short run of boxes is long work
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return detections.repartition(parts, *by).groupBy(*by).applyInPandas(run, schema)
