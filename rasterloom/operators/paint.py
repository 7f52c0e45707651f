"""Painting: layered instances become samples. The topmost write of a sample wins, so painting is one grouped maximum.

Boxes are clipped before they are exploded, so work is in proportion to the painted area, and a view prunes what it does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped(boxes: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Boxes (x, y, w, h) cut to a half-open view; those outside it go."""
    lo = lambda c, a: F.greatest(F.col(c), F.lit(a))
    hi = lambda c, n, b: F.least(F.col(c) + F.col(n), F.lit(b))
    out = boxes.withColumns({"cx0": lo("x", x0), "cx1": hi("x", "w", x1), "cy0": lo("y", y0), "cy1": hi("y", "h", y1)})
    return out.filter("cx0 < cx1 AND cy0 < cy1")


def exploded(boxes: DataFrame) -> DataFrame:
    """A row for each sample (py, px) of clipped boxes."""
    rows = boxes.withColumn("py", F.explode(F.sequence(F.col("cy0"), F.col("cy1") - 1)))
    return rows.withColumn("px", F.explode(F.sequence(F.col("cx0"), F.col("cx1") - 1)))


def topmost(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The sample (v) of the highest write in each place."""
    return writes.groupBy(*keys).agg(F.max_by("v", F.struct(*order)).alias("v"))


def fill_paint(boxes: DataFrame, view: tuple[int, int, int, int], keys: list[str]) -> DataFrame:
    return topmost(exploded(clipped(boxes, *view)), [*keys, "py", "px"], ["z"])


def raster_paint(placed: DataFrame, rasters: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """placed (keys, object, x, y, z) with rasters (object, oy, ox, v): samples at shifted coordinates, clipped to the canvas."""
    hits = placed.join(rasters, "object").withColumns({"py": F.col("y") + F.col("oy"), "px": F.col("x") + F.col("ox")})
    inside = hits.filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    return topmost(inside, [*keys, "py", "px"], ["z"])


def shaded(boxes: DataFrame, view: tuple[int, int, int, int], sample: Column, keys: list[str]) -> DataFrame:
    """Boxes whose sample is an expression of the local coordinate (lx, ly)."""
    rows = exploded(clipped(boxes, *view)).withColumns({"lx": F.col("px") - F.col("x"), "ly": F.col("py") - F.col("y")})
    return topmost(rows.withColumn("v", sample), [*keys, "py", "px"], ["z"])


def affine_paint(placed: DataFrame, rasters: DataFrame, keys: list[str], width: int, height: int, side: int) -> DataFrame:
    """placed (keys, object, z, a..f): every canvas sample looks up floor((a x + b y + c) / 256), floor((d x + e y + f) / 256)."""
    canvas = placed.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    ox = F.shiftright(F.col("a") * F.col("px") + F.col("b") * F.col("py") + F.col("c"), 8)
    oy = F.shiftright(F.col("d") * F.col("px") + F.col("e") * F.col("py") + F.col("f"), 8)
    hits = canvas.withColumns({"ox": ox.cast("int"), "oy": oy.cast("int")}).filter(f"ox >= 0 AND ox < {side} AND oy >= 0 AND oy < {side}")
    return topmost(hits.join(rasters, ["object", "ox", "oy"]), [*keys, "py", "px"], ["z"])


def checksum(frames: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Number of samples and a sum that weighs each sample by its place."""
    place = F.col("py").cast("long") * width + F.col("px") + 1
    return frames.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("v") * place).cast("long").alias("weighted"))
