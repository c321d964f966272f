"""Places for a user's models (U1 to U3): a factory builds one for each task, batches of rows go through it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def embed_crops(df: DataFrame, model_factory: Callable, mean: float = 127.5, std: float = 127.5, batch_rows: int = 256) -> DataFrame:
    """Id, embedding. Rows are id, pixels (h * w * 3 numbers, blue first), h, w. The model gets (n, 3, h, w), red
    first, scaled, of one size at a time, and must return one vector for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            for (h, w), part in frame.groupby(["h", "w"], sort=True):
                for k in range(0, len(part), batch_rows):
                    rows = part.iloc[k : k + batch_rows]
                    x = np.stack(rows["pixels"].to_numpy()).reshape(-1, int(h), int(w), 3)[..., ::-1].transpose(0, 3, 1, 2)
                    out = np.asarray(model((x - mean) / std))
                    if len(out) != len(rows):
                        raise ValueError(f"{len(out)} vectors for {len(rows)} images")
                    yield pd.DataFrame({"id": rows["id"].to_numpy(), "embedding": list(out.astype(float))})

    return df.select("id", "pixels", "h", "w").mapInPandas(run, "id long, embedding array<double>")


def detect_frames(df: DataFrame, model_factory: Callable) -> DataFrame:
    """Rows x1, y1, x2, y2, score, cls for each frame, none or many. Rows are camera_id, frame, pixels, h, w."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            found = [np.asarray(model(np.asarray(p).reshape(int(h), int(w), -1)), dtype=float).reshape(-1, 6) for p, h, w in zip(frame["pixels"], frame["h"], frame["w"], strict=True)]
            out = pd.DataFrame(np.concatenate([np.zeros((0, 6)), *found]), columns=["x1", "y1", "x2", "y2", "score", "cls"]).astype({"cls": "int32"})
            rows = np.repeat(np.arange(len(frame)), [len(b) for b in found])
            out.insert(0, "frame", frame["frame"].to_numpy()[rows])
            out.insert(0, "camera_id", frame["camera_id"].to_numpy()[rows])
            yield out

    return df.select("camera_id", "frame", "pixels", "h", "w").mapInPandas(run, "camera_id int, frame int, x1 double, y1 double, x2 double, y2 double, score double, cls int")


def estimate_poses(df: DataFrame, model_factory: Callable) -> DataFrame:
    """det_id, xs, ys, scores of each box's points. Rows are det_id, pixels (of the crop), h, w."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                points = np.asarray(model(np.asarray(r.pixels).reshape(int(r.h), int(r.w), -1)), dtype=float).reshape(-1, 3)
                rows.append((r.det_id, *points.T.tolist()))
            yield pd.DataFrame(rows, columns=["det_id", "xs", "ys", "scores"])

    return df.select("det_id", "pixels", "h", "w").mapInPandas(run, "det_id long, xs array<double>, ys array<double>, scores array<double>")
