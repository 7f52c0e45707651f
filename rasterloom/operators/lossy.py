"""Quantisation, distortion and the choice of a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quantize
from .compare import FRAME


def box3(frames: DataFrame) -> DataFrame:
    """Each sample becomes (left + 2 own + right + 2) >> 2 along its row; the edges repeat."""
    order = Window.partitionBy(*FRAME, "y").orderBy("x")
    left, right = F.coalesce(F.lag("v").over(order), "v"), F.coalesce(F.lead("v").over(order), "v")
    return frames.withColumn("v", F.shiftright(left + 2 * F.col("v") + right + 2, 2))


def distortion(pairs: DataFrame, keys: list[str], a: str = "v", b: str = "q") -> DataFrame:
    """Mean absolute (thousandths) and mean square error, floored, and the largest error."""
    d = (F.col(a) - F.col(b)).cast("long")
    n = F.count("*")
    return pairs.groupBy(*keys).agg(F.expr(f"sum(abs(cast({a} - {b} as long))) * 1000 div count(*)").alias("mae_x1000"), F.expr(f"sum(cast({a} - {b} as long) * cast({a} - {b} as long)) div count(*)").alias("mse"), F.max(F.abs(d)).alias("peak"), n.alias("n"))


def ladder(frames: DataFrame, shifts: list[int], half_up: bool = True) -> DataFrame:
    """Distortion of each stream at each shift, with the number of distinct neighbouring changes as its size."""
    rows = frames.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("q", quantize(F.col("v"), F.col("shift"), half_up))
    order = Window.partitionBy("shift", *FRAME, "y").orderBy("x")
    change = F.when(F.col("q") != F.coalesce(F.lag("q").over(order), F.lit(-1)), 1).otherwise(0)
    sizes = rows.withColumn("c", change).groupBy("stream_id", "shift").agg((18 + 9 * F.sum("c")).cast("long").alias("bytes"))
    return distortion(rows, ["stream_id", "shift"]).join(sizes, ["stream_id", "shift"])


def chosen(rows: DataFrame, budget: Column | None) -> DataFrame:
    """The rate of each stream. With a budget the least distorted that fits (if none fits, the first, marked); else the smallest."""
    key = F.struct("bytes", "mse", "mae_x1000", "peak", "shift")
    if budget is None:
        return rows.groupBy("stream_id").agg(F.min(key).alias("b")).select("stream_id", "b.shift", "b.bytes", F.lit(True).alias("met"))
    fits = F.min(F.when(F.col("bytes") <= budget, F.struct("mse", "mae_x1000", "peak", "bytes", "shift")))
    first = F.min(F.struct("shift", "bytes"))
    out = rows.groupBy("stream_id").agg(fits.alias("f"), first.alias("z"))
    return out.select("stream_id", F.coalesce("f.shift", "z.shift").alias("shift"), F.coalesce("f.bytes", "z.bytes").alias("bytes"), F.col("f").isNotNull().alias("met"))
