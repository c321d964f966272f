"""Pose points from crops to frames (K1 to K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 640.0  # crops are scaled to this many pixels each way


def crops(df: DataFrame) -> DataFrame:
    """K1: whole-number crop of each box, cut at 0; empty ones are left out."""
    whole = {f"{c}i": F.greatest(F.col(c), F.lit(0.0)).cast("int") for c in ("x1", "y1", "x2", "y2")}
    return df.withColumns(whole).filter("x2i > x1i AND y2i > y1i")


def points_in_frame(points: DataFrame) -> DataFrame:
    """K2: points (kx, ky of the scaled crop) in pixels of the frame; the score stays."""
    return points.withColumns(
        {"px": F.col("kx") * (F.col("x2") - F.col("x1")) / SIDE + F.col("x1"), "py": F.col("ky") * (F.col("y2") - F.col("y1")) / SIDE + F.col("y1")}
    )


def with_scores(poses: DataFrame) -> DataFrame:
    """K3: xs, ys and scores of a pose zipped to points; poses of unequal lengths get null points and ok = false."""
    same = (F.size("xs") == F.size("ys")) & (F.size("xs") == F.size("scores"))
    zipped = F.transform("xs", lambda x, i: F.struct(x.alias("x"), F.get("ys", i).alias("y"), F.get("scores", i).alias("score")))
    return poses.withColumn("ok", same).withColumn("points", F.when(same, zipped)).drop("xs", "ys", "scores")
