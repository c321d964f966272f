"""Cleaning of detection tables (P1 to P8) and pairs of boxes of a frame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathline.functions.boxes import iou

BOX = ("x1", "y1", "x2", "y2")
#: Boxes of a frame up to which all its pairs are compared at once.
FEW = 64


@dataclass(frozen=True)
class Cleaning:
    conf: float = 0.3
    classes: tuple[int, ...] = (0,)
    nms_iou: float = 0.3
    max_det: int = 32
    min_w: float = 0.0
    min_h: float = 0.0


def confident(df: DataFrame, p: Cleaning = Cleaning()) -> DataFrame:
    """A score above the threshold and a wanted class. Boxes with a null or NaN side are rejected."""
    sound = [F.col(c).isNotNull() & ~F.isnan(c) for c in BOX]
    return df.filter((F.col("score") > p.conf) & F.col("cls").isin(*p.classes) & sound[0] & sound[1] & sound[2] & sound[3])


def _greedy(box: np.ndarray, cls: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each box of a frame, best first, is kept."""
    x1, y1, x2, y2 = box
    area, kept, left = (x2 - x1) * (y2 - y1), np.zeros(len(x1), dtype=bool), np.arange(len(x1))
    while len(left):
        k, left = left[0], left[1:]
        kept[k] = True
        w = np.maximum(0.0, np.minimum(x2[k], x2[left]) - np.maximum(x1[k], x1[left]))
        h = np.maximum(0.0, np.minimum(y2[k], y2[left]) - np.maximum(y1[k], y1[left]))
        over = w * h / (area[k] + area[left] - w * h + 1e-12)
        left = left[~((over > threshold) & (cls[left] == cls[k]))]
    return kept


def _side_by_side(box: np.ndarray, cls: np.ndarray, first: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The same for many frames of few boxes at once: first and size of each frame; place by place, boxes that stay
    take out those after them that they overlap."""
    n = size.sum()
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(first, size) + place
    after = np.repeat(size, size) - place - 1
    a = np.repeat(row, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    x1, y1, x2, y2 = box
    w = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b]))
    h = np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
    area = (x2 - x1) * (y2 - y1)
    met = (w * h / (area[a] + area[b] - w * h + 1e-12) > threshold) & (cls[a] == cls[b])
    at, a, b = np.repeat(place, after)[met], a[met], b[met]
    order = np.argsort(at, kind="stable")
    at, a, b = at[order], a[order], b[order]
    kept = np.zeros(box.shape[1], dtype=bool)
    kept[row] = True
    for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
        kept[b[k][kept[a[k]]]] = False
    return kept


def _kept(table: pa.Table, cuts: np.ndarray, threshold: float) -> pa.Table:
    """The rows of whole frames, whose first rows are cuts, that stay, in order of the table."""
    box = np.stack([table.column(c).to_numpy() for c in BOX])
    score, cls = (table.column(c).to_numpy() for c in ("score", "cls"))
    det, unknown = pc.fill_null(table.column("det_id"), 0).to_numpy(), pc.is_null(table.column("det_id")).to_numpy()
    size = np.diff(np.append(cuts, len(table)))
    order = np.lexsort((det, unknown, -score, np.repeat(np.arange(len(cuts)), size)))
    box, cls = box[:, order], cls[order]
    few, kept = size <= FEW, np.zeros(len(table), dtype=bool)
    kept |= _side_by_side(box, cls, cuts[few], size[few], threshold)
    for at, n in zip(cuts[~few].tolist(), size[~few].tolist(), strict=True):
        kept[at : at + n] = _greedy(box[:, at : at + n], cls[at : at + n], threshold)
    return table.filter(pa.array(np.isin(np.arange(len(table)), order[kept])))


def suppress(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy suppression in each frame, best score first, ties by det_id: a box goes if a kept one of its class overlaps it more than the threshold.

    A task reads whole frames in order, and takes those of a batch together, as one call for each would cost more than its boxes."""

    def run(batches):
        held = []  # a frame that may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            starts = np.zeros(len(t), dtype=bool)
            for c in ("camera_id", "frame"):
                starts[1:] |= np.diff(batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
                starts[0] |= not held or t.column(c)[0] != held[-1].column(c)[-1]
            cuts = np.flatnonzero(starts)
            if not len(cuts):
                held.append(t)
                continue
            before = sum(map(len, held))
            whole = pa.concat_tables([*held, t.slice(0, cuts[-1])])
            if len(whole):
                yield from _kept(whole, np.append([0] if held else cuts[:0], cuts[:-1] + before), threshold).to_batches()
            held = [t.slice(cuts[-1])]
        if held:
            yield from _kept(pa.concat_tables(held), np.zeros(1, dtype=np.int64), threshold).to_batches()

    return df.repartition("camera_id", "frame").sortWithinPartitions("camera_id", "frame").mapInArrow(run, df.schema)


def best_of_frame(df: DataFrame, most: int = 32) -> DataFrame:
    """At most so many boxes of a frame, best first, ties by det_id."""
    w = Window.partitionBy("camera_id", "frame").orderBy(F.desc("score"), "det_id")
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def large_enough(df: DataFrame, p: Cleaning = Cleaning()) -> DataFrame:
    """P5: boxes of the least width and height or more."""
    return df.filter((F.col("x2") - F.col("x1") >= p.min_w) & (F.col("y2") - F.col("y1") >= p.min_h))


def to_frame(df: DataFrame, rois: DataFrame) -> DataFrame:
    """From a region's coordinates to the frame's. There is one region for a camera, so the table has a row
    for each camera; a camera without one is not shifted."""
    shift = rois.select("camera_id", F.col("rx1").alias("_dx"), F.col("ry1").alias("_dy"))
    moved = df.join(shift, "camera_id", "left")
    dx, dy = F.coalesce("_dx", F.lit(0.0)), F.coalesce("_dy", F.lit(0.0))
    return moved.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy}).drop("_dx", "_dy")


def boxes(df: DataFrame, scores: bool = True) -> DataFrame:
    """Keys and box, with the score or without."""
    return df.select("det_id", "camera_id", "frame", *BOX, *(["score"] if scores else []))


def clean(df: DataFrame, rois: DataFrame, p: Cleaning = Cleaning(), nms: bool = True) -> DataFrame:
    """The whole chain. Suppression and the cut to the best share one shuffle on camera and frame."""
    df = confident(df, p)
    if nms:
        df = suppress(df, p.nms_iou)
    return boxes(to_frame(large_enough(best_of_frame(df, p.max_det), p), rois))


def overlapping(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of boxes of one frame that overlap more than the threshold, smaller det_id first."""
    a = df.select("camera_id", "frame", F.col("det_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = df.select("camera_id", "frame", F.col("det_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    pair = a.join(b, ["camera_id", "frame"]).filter("a_id < b_id")
    pair = pair.withColumn("iou", iou([f"a_{c}" for c in BOX], [f"b_{c}" for c in BOX]))
    return pair.filter(F.col("iou") > threshold).select("camera_id", "frame", "a_id", "b_id", "iou")
