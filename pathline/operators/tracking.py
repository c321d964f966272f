"""Multi-object tracking of boxes (T1 to T7): a fold over the frames of each camera.

A constant-velocity filter whose x, y and area each go with their own speed, and whose
ratio stands alone: as all noise is diagonal, the 7-state filter falls into three filters
of two states and one of one, computed for all tracks of a frame at once.

A camera's frames fall into segments at gaps so long that no track outlives them; segments
are folded side by side, and track numbers are put in order afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathline.functions.order import in_ranges
from pathline.operators.assignment import associate
from pathline.sources.shared import settle

# Noise of the filter. First of position, then of speed, for x, y and area.
Q_POSITION, Q_SPEED = np.array([1.0, 1.0, 1.0]), np.array([0.01, 0.01, 0.0001])
R_POSITION, R_RATIO = np.array([1.0, 1.0, 10.0]), 10.0
P_POSITION, P_SPEED = 10.0, 10000.0


@dataclass(frozen=True)
class Tracking:
    max_age: int = 30
    min_hits: int = 3
    iou: float = 0.3


def _empty(*shape):
    return field(default_factory=lambda: np.zeros(shape))


@dataclass
class Tracks:
    """State of a camera (T1, T2, T4). Rows are live tracks in order of birth."""

    p: Tracking
    frame: int = 0  # the last one seen
    born: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    pos: np.ndarray = _empty(0, 3)
    vel: np.ndarray = _empty(0, 3)
    cov: np.ndarray = _empty(0, 3, 3)  # of each pair: position, both, speed
    ratio: np.ndarray = _empty(0, 2)  # value and variance
    count: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), dtype=np.int64))  # frames since a match, matches in a row

    #: Schema of a row of `save`.
    STATE = "id long, pos array<double>, vel array<double>, cov array<double>, ratio array<double>, age long, hits long"

    def save(self) -> list[tuple]:
        """A row for each live track."""
        parts = (self.ids, self.pos, self.vel, self.cov.reshape(-1, 9), self.ratio, self.count[:, 0], self.count[:, 1])
        return list(zip(*(x.tolist() for x in parts), strict=True))

    def restore(self, frame: int, born: int, rows: list[tuple]) -> None:
        self.frame, self.born = frame, born
        if rows:
            ids, pos, vel, cov, ratio, age, hits = zip(*rows, strict=True)
            self.ids, self.count = np.array(ids, dtype=np.int64), np.stack([age, hits], axis=1).astype(np.int64)
            self.pos, self.vel, self.ratio = (np.array([list(r) for r in x], dtype=float) for x in (pos, vel, ratio))
            self.cov = np.array([list(r) for r in cov], dtype=float).reshape(-1, 3, 3)

    def _keep(self, rows) -> None:
        for name in ("ids", "pos", "vel", "cov", "ratio", "count"):
            setattr(self, name, getattr(self, name)[rows])

    def boxes(self) -> np.ndarray:
        x, y, s = self.pos.T
        w = np.sqrt(np.maximum(s * self.ratio[:, 0], 0.0))
        h = np.divide(s, w, out=np.zeros_like(w), where=w != 0)
        return np.stack([x - w / 2, y - h / 2, x + w / 2, y + h / 2], axis=1)

    def _predict(self) -> None:
        self.vel[self.pos[:, 2] + self.vel[:, 2] <= 0, 2] = 0.0
        self.pos += self.vel
        a, b, c = self.cov[..., 0], self.cov[..., 1], self.cov[..., 2]
        self.cov = np.stack([a + 2 * b + c + Q_POSITION, b + c, c + Q_SPEED], axis=-1)
        self.ratio[:, 1] += 1.0
        self.count[self.count[:, 0] > 0, 1] = 0
        self.count[:, 0] += 1

    def _correct(self, rows: np.ndarray, z: np.ndarray) -> None:
        cov = self.cov[rows]
        gain = cov[..., :2] / (cov[..., 0] + R_POSITION)[..., None]
        off = z[:, :3] - self.pos[rows]
        self.pos[rows] += gain[..., 0] * off
        self.vel[rows] += gain[..., 1] * off
        left = 1 - gain[..., 0]
        self.cov[rows] = np.stack([left * cov[..., 0], left * cov[..., 1], cov[..., 2] - gain[..., 1] * cov[..., 1]], axis=-1)
        k = self.ratio[rows, 1] / (self.ratio[rows, 1] + R_RATIO)
        self.ratio[rows, 0] += k * (z[:, 3] - self.ratio[rows, 0])
        self.ratio[rows, 1] *= 1 - k
        self.count[rows, 0] = 0
        self.count[rows, 1] += 1

    def _add(self, z: np.ndarray) -> None:
        n = len(z)
        start = np.broadcast_to([P_POSITION, 0.0, P_SPEED], (n, 3, 3))
        self.ids = np.append(self.ids, self.born + 1 + np.arange(n))
        self.pos, self.vel = np.concatenate([self.pos, z[:, :3]]), np.concatenate([self.vel, np.zeros((n, 3))])
        self.cov = np.concatenate([self.cov, start])
        self.ratio = np.concatenate([self.ratio, np.stack([z[:, 3], np.full(n, P_POSITION)], axis=1)])
        self.count = np.concatenate([self.count, np.zeros((n, 2), dtype=np.int64)])
        self.born += n

    def step(self, frame: int, dets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and boxes reported for a frame; frames without detections since the last one pass as empty ones."""
        while self.frame < frame - 1 and len(self.ids):
            self.frame += 1
            self._predict()
            self._keep(self.count[:, 0] <= self.p.max_age)
        self.frame = frame
        self._predict()
        w, h = dets[:, 2] - dets[:, 0], dets[:, 3] - dets[:, 1]
        z = np.stack([dets[:, 0] + w / 2, dets[:, 1] + h / 2, w * h, np.divide(w, h, out=np.zeros_like(w), where=h != 0)], axis=1)
        found = associate(dets, self.boxes(), self.p.iou)
        if found:
            d, t = (np.array(x) for x in zip(*found, strict=True))
            self._correct(t, z[d])
        self._add(np.delete(z, [d for d, _ in found], axis=0))
        shown = (self.count[:, 0] < 1) & ((self.count[:, 1] >= self.p.min_hits) | (frame <= self.p.min_hits))
        out = self.ids[shown].copy(), self.boxes()[shown]
        self._keep(self.count[:, 0] <= self.p.max_age)
        return out


class Tracker(Protocol):
    """U4: what folds a camera's frames, here and in the stream. frame: the last one folded; born: tracks so far. The
    stream keeps both, and the rows of `save`, whose schema is STATE."""

    STATE: str
    frame: int
    born: int

    def save(self) -> list[tuple]: ...

    def restore(self, frame: int, born: int, rows: list[tuple]) -> None: ...

    def step(self, frame: int, dets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Track numbers and boxes reported for a frame and its boxes (n x 4)."""
        ...


def fold(frames: Iterable[tuple[int, np.ndarray]], state: Tracker) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """U4: frame, numbers and boxes for each frame in order."""
    for frame, boxes in frames:
        yield frame, *state.step(frame, boxes)


TRACK = "camera_id int, frame int, track_id long, x1 double, y1 double, x2 double, y2 double"


def is_sound() -> Column:
    """Whether a row has a camera, a frame from 1 on, and a box without a null or NaN side."""
    ok = F.col("camera_id").isNotNull() & F.coalesce(F.col("frame") >= 1, F.lit(False))
    for c in ("x1", "y1", "x2", "y2"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def sound(dets: DataFrame) -> DataFrame:
    """Boxes with a null or NaN side, rows without keys, and frames below 1 are rejected."""
    return dets.filter(is_sound())


def segments(dets: DataFrame, max_age: int = 30) -> DataFrame:
    """`segment` counts up where a camera has no detection for so long that no track is left.

    The distinct frames alone are looked at. They are dealt by range of camera and frame: gaps are
    found within a range, and the last frame and the number of gaps so far go over from
    range to range, so a camera of very many frames is in many tasks. Detections are joined by camera and frame.
    """
    frames = in_ranges(dets.select(F.col("camera_id").alias("_camera"), F.col("frame").alias("_frame")).distinct(), "_camera", "_frame")
    here = Window.partitionBy("_part", "_camera").orderBy("_frame")
    wide = lambda a, b: F.coalesce((a - b >= max_age + 2).cast("long"), F.lit(0))
    gaps = frames.withColumn("_gap", wide(F.col("_frame"), F.lag("_frame").over(here)))
    ends = gaps.groupBy("_camera", "_part").agg(F.min("_frame").alias("first"), F.max("_frame").alias("last"), F.sum("_gap").alias("gaps"))
    line = Window.partitionBy("_camera").orderBy("_part")  # a row for each range
    ends = ends.withColumn("_enter", wide(F.col("first"), F.lag("last").over(line)))
    so_far = F.sum(F.col("gaps") + F.col("_enter")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("_camera").alias("_of"), F.col("_part").alias("_in"), (F.coalesce(so_far, F.lit(0)) + F.col("_enter")).alias("_before"))
    placed = gaps.join(ends, (F.col("_part") == F.col("_in")) & F.col("_camera").eqNullSafe(F.col("_of")))
    placed = placed.select("_camera", "_frame", (F.col("_before") + F.sum("_gap").over(here)).alias("segment"))
    return dets.join(placed, dets.camera_id.eqNullSafe(placed._camera) & dets.frame.eqNullSafe(placed._frame)).drop("_camera", "_frame")


def track(dets: DataFrame, p: Tracking = Tracking(), cut: bool = True, tracker: Callable[[Tracking], Tracker] = Tracks) -> DataFrame:
    """T5: camera_id, frame, track_id, box. track_id counts from 1 in each camera, in order of birth; detections of a
    frame are taken in order of det_id (null first), then of the box. `cut` folds segments on their own; the result is the same without.

    Frames count from 1, as all do from the start of the video: the warm-up is the first
    min_hits of them, whether a camera has detections there or not; rows of frames below 1
    are left out, here and in the stream. A task reads sorted frames and holds one at a time;
    what it reports is written to the shared folder, and read for the numbers.
    """
    rows = sound(dets).select("camera_id", "frame", "det_id", "x1", "y1", "x2", "y2")
    rows = segments(rows, p.max_age) if cut else rows.withColumn("segment", F.lit(0).cast("long"))

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4, pa.bool_()]

    def run(batches):
        key, state, held, out = None, None, None, []

        def folded(frames):
            """Frames of whole detections, in order of camera, segment and frame."""
            nonlocal key, state
            for camera, segment, frame, box in frames:
                if (camera, segment) != key:
                    births()
                    key, state = (camera, segment), tracker(p)
                for f, ids, shown in fold([(frame, box)], state):
                    out.extend((*key, f, i, *b, False) for i, b in zip(ids.tolist(), shown.tolist(), strict=True))

        def births():
            if key is not None:
                out.append((*key, 0, state.born, 0.0, 0.0, 0.0, 0.0, True))

        def said():
            rows = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("camera_id", "segment", "frame")]
            part.append(np.stack([batch.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1))
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in part[:3]], axis=0)) + 1
            *whole, last = np.split(np.arange(len(part[0])), cuts)  # the last frame may go on in the next batch
            folded((int(part[0][k[0]]), int(part[1][k[0]]), int(part[2][k[0]]), part[3][k]) for k in whole)
            held = [x[last] for x in part]
            yield said()
        if held is not None:
            folded([(int(held[0][0]), int(held[1][0]), int(held[2][0]), held[3])])
            births()
            yield said()

    names = ["camera_id", "segment", "frame", "track_id", "x1", "y1", "x2", "y2", "births"]
    schema = "camera_id int, segment long, frame int, track_id long, x1 double, y1 double, x2 double, y2 double, births boolean"
    ordered = rows.repartition("camera_id", "segment").sortWithinPartitions("camera_id", "segment", "frame", "det_id", "x1", "y1", "x2", "y2")
    out = settle(ordered.mapInArrow(run, schema), "folded")
    # births of the segments before: a row for each segment is summed, so that no camera's tracks meet in one task
    w = Window.partitionBy("camera_id").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    before = out.filter("births").select("camera_id", "segment", F.coalesce(F.sum("track_id").over(w), F.lit(0)).alias("before"))
    numbered = out.filter("NOT births").join(before, ["camera_id", "segment"]).withColumn("track_id", F.col("track_id") + F.col("before"))
    return numbered.select("camera_id", "frame", "track_id", "x1", "y1", "x2", "y2")


def assign_table(dets: DataFrame, tracks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """T3 as a table: camera_id, frame, det_id, track_id; unmatched rows have a null on the other side."""
    box = ["x1", "y1", "x2", "y2"]

    def run(key, x, y):
        d, t = (np.stack([z.column(c).to_numpy() for c in box], axis=1) if len(z) else np.zeros((0, 4)) for z in (x, y))
        found = associate(d, t, threshold)
        det, trk = x.column("det_id").to_pylist(), y.column("track_id").to_pylist()
        pairs = [(det[a], trk[b]) for a, b in found]
        met = {a for a, _ in found}, {b for _, b in found}
        pairs += [(v, None) for k, v in enumerate(det) if k not in met[0]]
        pairs += [(None, v) for k, v in enumerate(trk) if k not in met[1]]
        n = len(pairs)
        return pa.table({"camera_id": pa.array([key[0].as_py()] * n, pa.int32()), "frame": pa.array([key[1].as_py()] * n, pa.int32()), "det_id": pa.array([a for a, _ in pairs], pa.int64()), "track_id": pa.array([b for _, b in pairs], pa.int64())})

    a = sound(dets).select("camera_id", "frame", "det_id", *box)
    b = sound(tracks).select("camera_id", "frame", "track_id", *box)
    return a.groupBy("camera_id", "frame").cogroup(b.groupBy("camera_id", "frame")).applyInArrow(run, "camera_id int, frame int, det_id long, track_id long")


def summaries(tracks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Of each track the first and last frame and time, the boxes and, if given (camera_id, track_id, frame,
    embedding), the embeddings in order of frames."""
    box = F.struct("frame", "x1", "y1", "x2", "y2", "score")
    out = tracks.groupBy("camera_id", "track_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.array_sort(F.collect_list(box)).alias("bboxes")
    )
    if embeddings is None:
        return out
    e = embeddings.groupBy("camera_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "embedding"))).alias("e"))
    return out.join(e.select("camera_id", "track_id", F.transform("e", lambda x: x["embedding"]).alias("embeddings")), ["camera_id", "track_id"], "left")
