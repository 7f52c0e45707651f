"""The choice among representations: every family prices its complete program, only exact ones count, the cheapest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compare import FRAME, with_previous

# Bytes of a group, of a raster or fill declaration, of the operations of a group.
GROUP, DECLARATION = 13, 13
FAMILIES = ("unchanged", "fill", "sparse", "residual", "prev_diff", "raw")


def candidates(frames: DataFrame, samples: int) -> DataFrame:
    """One row for each frame after the first and family: payload bytes, and whether it is exact there.

    k changed samples cost 9 bytes each as points; a raw frame is always exact, so there is always a winner.
    """
    facts = with_previous(frames).filter("frame > 0").groupBy(*FRAME).agg(F.count(F.when(F.col("v") != F.col("prev"), 1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    k = F.col("k")
    prices = {
        "unchanged": (F.lit(GROUP), k == 0),
        "fill": (F.lit(15 + DECLARATION), F.col("lo") == F.col("hi")),
        "sparse": (18 + 9 * k, k > 0),
        "residual": (18 + 9 + 9 * k, k > 0),
        "prev_diff": (F.lit(38) + F.when(k > 0, 5 + 9 + 9 * k).otherwise(0), F.lit(True)),
        "raw": (F.lit(32 + DECLARATION + samples), F.lit(True)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("family"), F.lit(i).alias("ord"), p.cast("long").alias("payload"), ok.alias("valid")) for i, (name, (p, ok)) in enumerate(prices.items())]))
    return facts.select(*FRAME, rows.alias("c")).select(*FRAME, "c.*")


def winners(candidates: DataFrame) -> DataFrame:
    """The cheapest valid candidate; of equals the first family."""
    return candidates.filter("valid").groupBy(*FRAME).agg(F.min_by("family", F.struct("payload", "ord")).alias("family"), F.min("payload").alias("payload"))


def family_stats(candidates: DataFrame) -> DataFrame:
    best = F.coalesce(F.min(F.when(F.col("valid"), F.col("payload"))), F.lit(0))
    return candidates.groupBy("family").agg(F.count("*").alias("evaluated"), F.count_if("valid").alias("valid"), best.alias("best"))


def cost_buckets(records: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """Bytes of records (stream_id, bucket, bytes) by exclusive bucket; they sum to the total."""
    return records.groupBy("stream_id").agg(*[F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("bytes"))), F.lit(0)).alias(b) for b in buckets], F.sum("bytes").alias("total"))
