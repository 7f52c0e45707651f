"""Regions as half-open spans of rows, and what a view needs of earlier frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of spans (keys, x0, x1): those that overlap or touch become one."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)
    islands = spans.filter("x0 < x1").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def intersected(spans: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The part of spans (y, x0, x1) inside a rectangle."""
    cut = spans.filter((F.col("y") >= y0) & (F.col("y") < y1))
    return cut.withColumns({"x0": F.greatest("x0", F.lit(x0)), "x1": F.least("x1", F.lit(x1))}).filter("x0 < x1")


def subtracted(spans: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The part of spans (y, x0, x1) outside a rectangle: up to two pieces of each."""
    inside = (F.col("y") >= y0) & (F.col("y") < y1)
    whole = F.array(F.struct("x0", "x1"))
    pieces = F.array(F.struct(F.col("x0"), F.least("x1", F.lit(x0)).alias("x1")), F.struct(F.greatest("x0", F.lit(x1)).alias("x0"), F.col("x1")))
    keys = [c for c in spans.columns if c not in ("x0", "x1")]
    return spans.select(*keys, F.explode(F.when(inside, pieces).otherwise(whole)).alias("p")).select(*keys, "p.x0", "p.x1").filter("x0 < x1")


class Region:
    """Samples of a canvas: a box and which of its samples belong."""

    def __init__(self, x: int, y: int, mask: np.ndarray):
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if len(rows):
            self.x, self.y = x + int(columns[0]), y + int(rows[0])
            self.mask = mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
        else:
            self.x, self.y, self.mask = x, y, np.zeros((0, 0), bool)

    @classmethod
    def box(cls, x0: int, y0: int, x1: int, y1: int) -> Region:
        return cls(x0, y0, np.ones((max(0, y1 - y0), max(0, x1 - x0)), bool))

    def __len__(self) -> int:
        return int(self.mask.sum())

    @property
    def ends(self) -> tuple[int, int]:
        return self.x + self.mask.shape[1], self.y + self.mask.shape[0]

    def spans(self) -> int:
        """Runs of samples, row by row."""
        return int((np.diff(self.mask.astype(np.int8), axis=1, prepend=0) > 0).sum()) if self.mask.size else 0

    def rows(self) -> list[tuple[int, int, int]]:
        """The runs themselves: y, x0, x1."""
        if not self.mask.size:
            return []
        edges = np.diff(self.mask.astype(np.int8), axis=1, prepend=0, append=0)
        ys, starts = np.nonzero(edges > 0)
        return [(int(y) + self.y, int(a) + self.x, int(b) + self.x) for y, a, b in zip(ys, starts, np.nonzero(edges < 0)[1])]

    def within(self, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        """The mask over a box."""
        out = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), bool)
        a, b, (e, f) = max(x0, self.x), max(y0, self.y), self.ends
        e, f = min(x1, e), min(y1, f)
        if a < e and b < f:
            out[b - y0 : f - y0, a - x0 : e - x0] = self.mask[b - self.y : f - self.y, a - self.x : e - self.x]
        return out

    def cut(self, x0: int, y0: int, x1: int, y1: int) -> Region:
        return Region(x0, y0, self.within(x0, y0, x1, y1))

    def without(self, x0: int, y0: int, x1: int, y1: int) -> Region:
        mask = self.mask.copy()
        mask[max(0, y0 - self.y) : max(0, y1 - self.y), max(0, x0 - self.x) : max(0, x1 - self.x)] = False
        return Region(self.x, self.y, mask)

    def moved(self, dx: int, dy: int) -> Region:
        return Region(self.x + dx, self.y + dy, self.mask)

    def union(self, other: Region) -> Region:
        if not len(self) or not len(other):
            return self if len(self) else other
        x0, y0 = min(self.x, other.x), min(self.y, other.y)
        x1, y1 = (max(a, b) for a, b in zip(self.ends, other.ends))
        return Region(x0, y0, self.within(x0, y0, x1, y1) | other.within(x0, y0, x1, y1))


def target_of(args: list[int], width: int, height: int) -> tuple[int, int, int, int]:
    """The box that a copy writes: both ends are clipped to the canvas."""
    sx, sy, w, h, dx, dy = args
    left, top = max(0, -sx, -dx), max(0, -sy, -dy)
    right, bottom = min(w, width - sx, width - dx), min(h, height - sy, height - dy)
    return dx + left, dy + top, dx + max(left, right), dy + max(top, bottom)


def demands(copies: DataFrame, view: tuple[int, int, int, int], at: int, width: int, height: int) -> DataFrame:
    """Spans of each frame t <= at that the view of frame `at` reads, through copies (stream_id, t, sx, sy, w, h, dx, dy): stream_id, t,
    y, x0, x1.

    It goes back one frame at a time: what a frame needs of the one before is the part of its copies' targets that is needed, moved
    to their sources. What is needed of a frame is a union, so overlapping copies don't add up. A stream is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = {t: rows[["sx", "sy", "w", "h", "dx", "dy"]].astype(int).values.tolist() for t, rows in pdf[pdf["t"] <= at].groupby("t")}
        need, out = Region.box(*view).cut(0, 0, width, height), []
        for t in range(at, -1, -1):
            out += [(t, y, x0, x1) for y, x0, x1 in need.rows()]
            before = Region.box(0, 0, 0, 0)
            for c in steps.get(t, ()):
                before = before.union(need.cut(*target_of(c, width, height)).moved(c[0] - c[4], c[1] - c[5]))
            need = before
        got = pd.DataFrame(out, columns=["t", "y", "x0", "x1"])
        got.insert(0, "stream_id", pdf["stream_id"].iloc[0])
        return got

    return copies.select("stream_id", "t", "sx", "sy", "w", "h", "dx", "dy").groupBy("stream_id").applyInPandas(run, "stream_id long, t long, y long, x0 long, x1 long")
