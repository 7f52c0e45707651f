"""Motion programs: what a log attaches and advances, and which program replaces a run of placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a program without segments, of a linear and of an accelerated segment; of a placement's group, and of
# the group that advances a program instead.
PROGRAM, LINEAR, ACCELERATED = 9, 17, 25
PLACED, ADVANCED = 26, 14
#: Placements of a run, at least.
LEAST_RUN = 3


def step_of(segments: Column, n: Column) -> Column:
    """(x, y) that a program's n-th advance (from 1) moves by; null beyond its end. In segment step j the move is v + j a."""
    start = F.struct((n - 1).cast("long").alias("left"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"))

    def go(acc: Column, s: Column) -> Column:
        here = (acc["left"] >= 0) & (acc["left"] < s["steps"])
        at = lambda v, a, old: F.when(here, s[v] + s[a] * acc["left"]).otherwise(acc[old]).alias(old)
        return F.struct(F.when(here, F.lit(-1).cast("long")).otherwise(acc["left"] - F.when(acc["left"] < 0, 0).otherwise(s["steps"])).alias("left"), at("vx", "ax", "x"), at("vy", "ay", "y"))

    out = F.aggregate(segments, start, go)
    return F.when(out["x"].isNotNull(), F.struct(out["x"].alias("x"), out["y"].alias("y")))


def positions(log: DataFrame) -> DataFrame:
    """Adds x and y after each event of a log (stream_id, t, kind, px, py, segments): kind `place` sets the position, `attach`
    gives a program (an empty one detaches), `advance` moves by the program's next step. A placement does not stop a program."""
    order = Window.partitionBy("stream_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("program", F.count(F.when(F.col("kind") == "attach", 1)).over(order)).withColumn("placed", F.count(F.when(F.col("kind") == "place", 1)).over(order))
    log = log.withColumn("attached", F.last(F.when(F.col("kind") == "attach", F.col("segments")), ignorenulls=True).over(order))
    inside = Window.partitionBy("stream_id", "program").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.count(F.when(F.col("kind") == "advance", 1)).over(inside)
    move = F.when((F.col("kind") == "advance") & (F.size("attached") > 0), step_of(F.col("attached"), nth))
    log = log.withColumn("move", move)
    since = Window.partitionBy("stream_id", "placed").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c, p: (F.coalesce(F.first(F.when(F.col("kind") == "place", F.col(p)), ignorenulls=True).over(since), F.lit(0)) + F.coalesce(F.sum(F.col(f"move.{c}")).over(since), F.lit(0))).cast("long")
    return log.withColumns({"x": at("x", "px"), "y": at("y", "py")}).drop("program", "placed", "attached", "move")


def fitted(runs: DataFrame) -> DataFrame:
    """For each run (run columns, k from 0, x, y; k = 0 is the position before the run): its segments of equal steps, and the
    cheapest exact program in the order linear, accelerated, piecewise, with its bytes and whether it is worth it."""
    keys = [c for c in runs.columns if c not in ("k", "x", "y")]
    order = Window.partitionBy(*keys).orderBy("k")
    step = lambda c: F.col(c) - F.lag(c).over(order)
    steps = runs.withColumns({"dx": step("x"), "dy": step("y")}).filter("k > 0")
    step2 = lambda c: F.col(c) - F.lag(c).over(order)
    steps = steps.withColumns({"ax": step2("dx"), "ay": step2("dy")})
    turn = F.when((F.col("ax") != 0) | (F.col("ay") != 0), 1).otherwise(0)
    steps = steps.withColumn("turn", turn)
    facts = steps.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum("turn") + 1).alias("segments"), F.min("ax").alias("ax"), F.min("ay").alias("ay"),
        ((F.min("ax") == F.max("ax")) & (F.min("ay") == F.max("ay"))).alias("even"), F.min_by("dx", "k").alias("vx"), F.min_by("dy", "k").alias("vy"),
    )
    linear = F.when(F.col("segments") == 1, F.lit(PROGRAM + LINEAR))
    accelerated = F.when((F.col("n") >= 2) & F.col("even") & ((F.col("ax") != 0) | (F.col("ay") != 0)), F.lit(PROGRAM + ACCELERATED))
    piecewise = F.when(F.col("segments") >= 2, PROGRAM + LINEAR * F.col("segments"))
    names = (("linear", linear), ("accelerated", accelerated), ("piecewise", piecewise))
    tries = F.filter(F.array(*[F.struct(b.cast("long").alias("bytes"), F.lit(i).alias("ord"), F.lit(name).alias("program")) for i, (name, b) in enumerate(names)]), lambda s: s["bytes"].isNotNull())
    best = facts.withColumn("best", F.array_min(tries))
    worth = (F.col("n") >= LEAST_RUN) & (ADVANCED * F.col("n") + F.col("best.bytes") + 1 < PLACED * F.col("n"))
    return best.select(*keys, "n", "segments", "vx", "vy", F.col("best.program").alias("program"), F.col("best.bytes").alias("bytes"), worth.alias("worth"))
