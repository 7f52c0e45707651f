"""Search governance: what the last winners say about where to search next. It never has a say in a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Length of the ring of winners, least filled ring and factor of a payload jump, frames between sweeps.
RING, SLEW_RING, SLEW, SWEEP = 12, 5, 3.0, 6


def observed(wins: DataFrame) -> DataFrame:
    """Adds to wins (stream_id, frame, family, payload): share of the winner in the ring, the ring's upper median payload,
    alpha (the winner is new to the ring before it, or its payload jumps), and the frames since the last alpha."""
    order = Window.partitionBy("stream_id").orderBy("frame")
    ring, before = order.rowsBetween(1 - RING, 0), order.rowsBetween(-RING, -1)
    n = F.count("*").over(ring)
    out = wins.withColumn("families", F.collect_list("family").over(ring)).withColumn("payloads", F.array_sort(F.collect_list("payload").over(ring))).withColumn("earlier", F.collect_list("family").over(before)).withColumn("n", n)
    out = out.withColumn("phi", F.size(F.filter("families", lambda f: f == F.col("family"))) / F.col("n"))
    out = out.withColumn("median", F.get("payloads", F.expr("cast(n div 2 as int)")))
    novel = (F.size("earlier") > 0) & ~F.array_contains("earlier", F.col("family"))
    slew = (F.col("median") > 0) & (F.col("n") >= SLEW_RING) & (F.col("payload") > SLEW * F.col("median"))
    out = out.withColumn("alpha", novel | slew)
    regime = F.count(F.when(F.col("alpha"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("regime", regime)
    in_regime = Window.partitionBy("stream_id", "regime").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("since", F.count(F.when(~F.col("alpha"), 1)).over(in_regime)).drop("payloads", "earlier", "regime")


def drift(wins: DataFrame) -> DataFrame:
    """Adds omega, the running mean (halves) of the change of the shares of the families in the ring."""
    seen = observed(wins)
    share = lambda c, n: F.transform(F.array_sort(F.array_distinct(c)), lambda f: F.struct(f.alias("f"), (F.size(F.filter(c, lambda g: g == f)) / n).alias("p")))
    seen = seen.withColumn("shares", share(F.col("families"), F.col("n")))
    before = F.lag("shares").over(Window.partitionBy("stream_id").orderBy("frame"))
    seen = seen.withColumn("before", F.coalesce(before, F.expr("array()").cast(seen.schema["shares"].dataType)))
    old = lambda s: F.coalesce(F.get(F.filter("before", lambda b: b["f"] == s["f"]), F.lit(0))["p"], F.lit(0.0))
    seen = seen.withColumn("delta", F.aggregate("shares", F.lit(0.0), lambda acc, s: acc + F.abs(s["p"] - old(s))))
    upto = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(-60, 0)
    # beyond 60 halvings nothing of an older change is left in a double
    folded = F.aggregate("deltas", F.lit(None).cast("double"), lambda acc, d: F.when(acc.isNull(), d).otherwise(0.5 * d + 0.5 * acc))
    return seen.withColumn("deltas", F.collect_list("delta").over(upto)).withColumn("omega", folded).select("stream_id", "frame", "family", "omega")


def plans(wins: DataFrame) -> DataFrame:
    """For the frame after each one: broaden (search everything), trusted families, or trusted families with a sweep."""
    seen = observed(wins)
    frames_seen = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame"))
    plan = F.when(F.col("alpha"), "broaden").when(frames_seen % SWEEP == 0, "sweep").otherwise("trusted")
    return seen.withColumn("plan", plan).withColumn("trusted", F.array_join(F.array_sort(F.array_distinct("families")), ",")).select("stream_id", "frame", "plan", "trusted")


# Families that a plan searches, those that make them trusted and how far, and how far a sweep probes them.
MODES = ("clears", "translation", "copies", "regions", "transform", "generators")
TRUSTED_BY = {"translation": (("translation",), "full"), "copies": (("copy_rect", "copy_residual"), "probe"), "regions": (("regions",), "full"), "transform": (("transform_residual",), "full"), "generators": (("generator", "generator_residual"), "full")}
SWEPT = {"translation": "full", "copies": "probe", "regions": "probe", "transform": "probe", "generators": "probe"}
#: The plan of a fixed heuristic, whatever has won.
FIXED = {"clears": "off", "translation": "full", "copies": "probe", "regions": "probe", "transform": "probe", "generators": "probe"}


def family_plans(wins: DataFrame) -> DataFrame:
    """plans() with a column for each of MODES: off, probe or full. Broadening searches all in full; a family that has won
    within the ring is searched as far as TRUSTED_BY says; a sweep probes the others; clears are only tried when broadening."""
    out = plans(wins)
    active = F.split("trusted", ",")
    for mode in MODES:
        families, how = TRUSTED_BY.get(mode, ((), "off"))
        won = F.arrays_overlap(active, F.array(*[F.lit(f) for f in families])) if families else F.lit(False)
        swept = F.lit(SWEPT.get(mode, "off"))
        out = out.withColumn(mode, F.when(F.col("plan") == "broaden", "full").when(won, how).when(F.col("plan") == "sweep", swept).otherwise("off"))
    return out
