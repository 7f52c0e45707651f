"""State as of any time, by windows over the transition log instead of replay.

Every function takes a log DataFrame: stream_id, t (order within the stream), op and the op's operands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(*keys: str, order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def latest(value: Column, when: Column, keys: list[str]) -> Column:
    """The operand of the last row up to this one that sets it."""
    return F.last(F.when(when, value), ignorenulls=True).over(upto(*keys))


def lives(log: DataFrame, is_clear: Column) -> DataFrame:
    """Adds life: how many clears came up to this row. Ids may be used again in another life."""
    return log.withColumn("life", F.count(F.when(is_clear, 1)).over(upto("stream_id")))


def positions(log: DataFrame) -> DataFrame:
    """Adds x, y, vx, vy after each row, for ops place (px, py), velocity (pvx, pvy; 0, 0 stops) and advance.

    A velocity outlives a placement. Placements start groups; within a group the position is a running sum.
    """
    keys = ["stream_id"]
    log = log.withColumn("vx", F.coalesce(latest(F.col("pvx"), F.col("op") == "velocity", keys), F.lit(0)))
    log = log.withColumn("vy", F.coalesce(latest(F.col("pvy"), F.col("op") == "velocity", keys), F.lit(0)))
    log = log.withColumn("placed", F.count(F.when(F.col("op") == "place", 1)).over(upto(*keys)))
    group = ["stream_id", "placed"]
    for axis in "xy":
        step = F.sum(F.when(F.col("op") == "advance", F.col(f"v{axis}")).otherwise(0)).over(upto(*group))
        base = F.coalesce(F.first(F.when(F.col("op") == "place", F.col(f"p{axis}")), ignorenulls=True).over(upto(*group)), F.lit(0))
        log = log.withColumn(axis, base + step)
    return log.drop("placed")


def motion(log: DataFrame) -> DataFrame:
    """Adds x, y and mode after each row: the last motion-setter wins.

    Ops: place (px, py), velocity (pvx, pvy), program (pvx, pvy, pax, pay, steps: velocity grows by the acceleration after each
    step; steps 0 ends a program and nothing else), affine (identity: detaches), advance (moves velocities), advance_program.
    Setting velocity 0, 0 or the identity ends what was active; each setter removes the other two.
    """
    keys = ["stream_id"]
    setter = (F.col("op") == "velocity") | ((F.col("op") == "program") & (F.col("steps") > 0)) | (F.col("op") == "affine")
    log = log.withColumn("set_no", F.count(F.when(setter, 1)).over(upto(*keys)))
    log = log.withColumn("kind", latest(F.col("op"), setter, keys))
    for c in ("pvx", "pvy", "pax", "pay", "steps", "identity"):
        log = log.withColumn(f"s_{c}", latest(F.col(c), setter, keys))
    since = ["stream_id", "set_no"]
    ended = F.max(F.when((F.col("op") == "program") & (F.col("steps") == 0), 1).otherwise(0)).over(upto(*since))
    log = log.withColumn("n", F.count(F.when(F.col("op") == "advance_program", 1)).over(upto(*since))).withColumn("ended", ended)
    running = (F.col("kind") == "program") & (F.col("ended") == 0)
    log = log.withColumn("placed", F.count(F.when(F.col("op") == "place", 1)).over(upto(*keys)))
    group = ["stream_id", "placed"]
    for axis in "xy":
        v, a = F.col(f"s_pv{axis}"), F.col(f"s_pa{axis}")
        step = F.when((F.col("op") == "advance") & (F.col("kind") == "velocity"), v)
        step = step.when((F.col("op") == "advance_program") & running & (F.col("n") <= F.col("s_steps")), v + a * (F.col("n") - 1)).otherwise(0)
        moved = F.sum(step).over(upto(*group))
        base = F.coalesce(F.first(F.when(F.col("op") == "place", F.col(f"p{axis}")), ignorenulls=True).over(upto(*group)), F.lit(0))
        log = log.withColumn(axis, (base + moved).cast("long"))
    mode = F.when((F.col("kind") == "velocity") & ((F.col("s_pvx") != 0) | (F.col("s_pvy") != 0)), "velocity")
    mode = mode.when(running & (F.col("n") < F.col("s_steps")), "program").when((F.col("kind") == "affine") & (F.col("s_identity") == 0), "affine").otherwise("still")
    return log.withColumn("mode", mode).drop("set_no", "kind", "ended", "n", "placed", *[f"s_{c}" for c in ("pvx", "pvy", "pax", "pay", "steps", "identity")])


def overlay(log: DataFrame) -> DataFrame:
    """Points (stream_id, x, y, v) that patches since the last clear left; the latest wins. Ops patch (x, y, v), clear."""
    epochs = log.withColumn("epoch", F.count(F.when(F.col("op") == "clear", 1)).over(upto("stream_id")))
    last = epochs.groupBy("stream_id").agg(F.max("epoch").alias("epoch"))
    live = epochs.filter("op = 'patch'").join(last, ["stream_id", "epoch"])
    return live.groupBy("stream_id", "x", "y").agg(F.max_by("v", "t").alias("v"))


def palette(log: DataFrame) -> DataFrame:
    """Entries (stream_id, idx, v) after the whole log. Ops set (entries), patch (idx, v); a set replaces all entries."""
    sets = log.withColumn("version", F.count(F.when(F.col("op") == "set", 1)).over(upto("stream_id")))
    last = sets.groupBy("stream_id").agg(F.max("version").alias("version"))
    live = sets.filter("op IN ('set', 'patch')").join(last, ["stream_id", "version"]).filter("version > 0")
    whole = live.filter("op = 'set'").select("stream_id", "t", F.posexplode("entries").alias("idx", "v"))
    size = live.filter("op = 'set'").select("stream_id", F.size("entries").alias("size"))
    patched = live.filter("op = 'patch'").join(size, "stream_id").filter("idx < size").select("stream_id", "t", "idx", "v")
    return whole.unionByName(patched).groupBy("stream_id", "idx").agg(F.max_by("v", "t").alias("v"))


def instances(log: DataFrame) -> DataFrame:
    """Lives of instances. Ops create (id), clear. z is the paint order; a second create of a live id is marked."""
    rows = lives(log, F.col("op") == "clear").filter("op = 'create'")
    nth = F.row_number().over(Window.partitionBy("stream_id", "life", "id").orderBy("t"))
    z = F.row_number().over(Window.partitionBy("stream_id").orderBy("t")) - 1
    return rows.select("stream_id", "life", "id", "t", z.cast("long").alias("z"), (nth > 1).alias("duplicate"))


def bindings(log: DataFrame) -> DataFrame:
    """Palette of each instance after the log: ops bind (id, palette; 0 unbinds), clear."""
    rows = lives(log, F.col("op") == "clear")
    last = rows.groupBy("stream_id").agg(F.max("life").alias("life"))
    bound = rows.filter("op = 'bind'").join(last, ["stream_id", "life"]).groupBy("stream_id", "id").agg(F.max_by("palette", "t").alias("palette"))
    return bound.filter("palette <> 0")


def first_error(log: DataFrame) -> DataFrame:
    """First row of each stream whose time does not allow it: t must be at least 1 and never fall."""
    before = F.lag("at").over(Window.partitionBy("stream_id").orderBy("t"))
    bad = log.withColumn("error", F.when(F.col("at") < 1, "time below one").when(F.col("at") < before, "time goes back"))
    return bad.filter("error IS NOT NULL").groupBy("stream_id").agg(F.min(F.struct("t", "error")).alias("e")).select("stream_id", "e.t", "e.error")
