"""Frames that read the frame before: copies inside a canvas, warps, residuals.

Only a group with a copy or a warp needs its predecessor, so a stream falls into segments that are folded apart from each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(groups: DataFrame) -> DataFrame:
    """Adds segment: a frame that reads no earlier one (chained = false) begins a new one."""
    order = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumn("segment", F.count(F.when(~F.col("chained"), 1)).over(order))


def copy_rect(canvas: np.ndarray, sx: int, sy: int, w: int, h: int, dx: int, dy: int) -> np.ndarray:
    """The canvas after a copy; both ends are clipped, the source is read before anything is written and is not erased."""
    rows, cols = canvas.shape
    left, top = max(0, -sx, -dx), max(0, -sy, -dy)
    right, bottom = min(w, cols - sx, cols - dx), min(h, rows - sy, rows - dy)
    out = canvas.copy()
    if left < right and top < bottom:
        out[dy + top : dy + bottom, dx + left : dx + right] = canvas[sy + top : sy + bottom, sx + left : sx + right]
    return out


def scroll(frame0: DataFrame, steps: int, step: int) -> DataFrame:
    """Frames 0..steps of each stream (stream_id, samples: packed rows, w, h): each turns the one before left by `step`, as two copies."""

    def fold(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                canvas = np.frombuffer(r.samples, np.uint8).reshape(r.h, r.w)
                for t in range(steps + 1):
                    if t:
                        base = canvas
                        canvas = copy_rect(base, step, 0, r.w - step, r.h, 0, 0)
                        canvas[:, r.w - step :] = copy_rect(base, 0, 0, step, r.h, r.w - step, 0)[:, r.w - step :]
                    out.append((r.stream_id, t, canvas.tobytes(), r.w, r.h))
            yield pd.DataFrame(out, columns=["stream_id", "frame", "samples", "w", "h"])

    return frame0.mapInPandas(fold, "stream_id int, frame long, samples binary, w int, h int")


def predicted(frames: DataFrame, a: int, b: int, c: int, d: int, e: int, f: int, shift: int = 8) -> DataFrame:
    """Adds pred: the sample of the frame before at the mapped place, or the frame's own where the map leaves the canvas."""
    sx = F.shiftright((a * F.col("x") + b * F.col("y") + c).cast("long"), shift).cast("int")
    sy = F.shiftright((d * F.col("x") + e * F.col("y") + f).cast("long"), shift).cast("int")
    before = frames.select("stream_id", (F.col("frame") + 1).alias("frame"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v").alias("prev"))
    return frames.withColumns({"sx": sx, "sy": sy}).join(before, ["stream_id", "frame", "sx", "sy"], "left").withColumn("pred", F.coalesce("prev", "v")).drop("sx", "sy", "prev")


def residual(base: DataFrame, points: DataFrame) -> DataFrame:
    """Points (stream_id, frame, x, y, v) overwrite samples of their frame."""
    return base.join(points.withColumnRenamed("v", "new"), ["stream_id", "frame", "y", "x"], "left").withColumn("v", F.coalesce("new", "v")).drop("new")


def transform_residual(base: DataFrame, deltas: DataFrame, top: int = 255) -> DataFrame:
    """Deltas are added; a sum outside 0..top is an error (column error)."""
    out = base.join(deltas.withColumnRenamed("v", "delta"), ["stream_id", "frame", "y", "x"], "left").withColumn("sum", F.col("v") + F.coalesce("delta", F.lit(0)))
    return out.withColumn("error", (F.col("sum") < 0) | (F.col("sum") > top))
