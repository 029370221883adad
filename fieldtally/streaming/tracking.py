"""The frame-by-frame tracker over a stream: its state is carried from batch to batch for each flight and camera."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matching import Tracker

OUT = "flight_id long, modality string, track_id long, detection_id long, frame long"


def track_stream(detections: DataFrame, **settings) -> DataFrame:
    """Members of running tracks; frames must arrive in order within a flight and camera."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(**settings)
        rows = pd.concat(list(frames))
        parts = []
        for _, f in rows.sort_values(["frame", "detection_id"]).groupby("frame", sort=True):
            ids = tracker.step(f[["x1", "y1", "x2", "y2"]].to_numpy(float), f["cls"].to_numpy(np.int64))
            parts.append(f[["flight_id", "modality", "detection_id", "frame"]].assign(track_id=ids))
        state.update((pickle.dumps(tracker),))
        yield pd.concat(parts)[["flight_id", "modality", "track_id", "detection_id", "frame"]]

    return detections.groupBy("flight_id", "modality").applyInPandasWithState(step, OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)
