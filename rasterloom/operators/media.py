"""Media geometry, rational time and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar

# Layouts with their planes, and how often width and height of the second and third plane are halved.
LAYOUTS = {
    "gray": (1, 0, 0), "gray_alpha": (2, 0, 0), "yuv420": (3, 1, 1), "yuv422": (3, 1, 0), "yuv444": (3, 0, 0), "yuv440": (3, 0, 1), "yuv411": (3, 2, 0), "yuv410": (3, 2, 2),
    "yuva420": (4, 1, 1), "yuva422": (4, 1, 0), "yuva444": (4, 0, 0), "gbr": (3, 0, 0), "gbra": (4, 0, 0), "rgb": (3, 0, 0), "rgba": (4, 0, 0), "palette": (1, 0, 0),
}


def layouts(spark: SparkSession) -> DataFrame:
    """(layout, plane, sub_w, sub_h): chroma planes are the second and third of three or more."""
    rows = [(name, p, sw if p in (1, 2) and n >= 3 else 0, sh if p in (1, 2) and n >= 3 else 0) for name, (n, sw, sh) in LAYOUTS.items() for p in range(n)]
    return spark.createDataFrame(rows, "layout string, plane int, sub_w int, sub_h int")


def planes(pictures: DataFrame, layout_table: DataFrame) -> DataFrame:
    """Planes of pictures (layout, width, height, depth) with their sizes and bytes (two for more than 8 bits)."""
    out = pictures.join(F.broadcast(layout_table), "layout")
    out = out.withColumns({"w": scalar.plane_length(F.col("width"), F.col("sub_w")), "h": scalar.plane_length(F.col("height"), F.col("sub_h"))})
    return out.withColumn("bytes", F.col("w") * F.col("h") * F.when(F.col("depth") > 8, 2).otherwise(1))


def plane_errors(planes: DataFrame) -> DataFrame:
    """What a plane (w, h, depth, n_samples, top) breaks, if anything: depth 1..16, no empty side, all samples there and in range."""
    error = F.when(~F.col("depth").between(1, 16), "depth").when((F.col("w") < 1) | (F.col("h") < 1), "empty").when(F.col("n_samples") != F.col("w") * F.col("h"), "length").when(F.col("top") > scalar.depth_top(F.col("depth")), "sample out of range")
    return planes.withColumn("error", error)


def unpacked_pairs(rows: DataFrame) -> DataFrame:
    """Semi-planar rows (y, data: array of u v u v ...) as planes u and v: (plane, y, x, v)."""
    dense = rows.select("id", "y", F.posexplode("data").alias("p", "v"))
    return dense.select("id", (F.col("p") % 2 + 1).cast("int").alias("plane"), "y", F.expr("p div 2").cast("int").alias("x"), "v")


def packed_pairs(samples: DataFrame) -> DataFrame:
    """The inverse: two planes woven into one row."""
    place = F.col("x") * 2 + F.col("plane") - 1
    return samples.groupBy("id", "y").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "v"))).alias("s")).select("id", "y", F.transform("s", lambda s: s["v"]).alias("data"))


def unpacked_422(rows: DataFrame, luma_first: bool = True) -> DataFrame:
    """Packed 4:2:2 rows (y0 u y1 v, or u y0 v y1) as planes; a row whose length is no multiple of four is an error and left out."""
    dense = rows.filter(F.size("data") % 4 == 0).select("id", "y", F.posexplode("data").alias("p", "v"))
    luma = F.col("p") % 2 == (0 if luma_first else 1)
    plane = F.when(luma, 0).when(F.col("p") % 4 == (1 if luma_first else 0), 1).otherwise(2)
    return dense.select("id", plane.alias("plane"), "y", F.when(luma, F.expr("p div 2")).otherwise(F.expr("p div 4")).cast("int").alias("x"), "v")


def durations(observations: DataFrame) -> DataFrame:
    """Span to the next observation in ticks; the last has none. Times that do not rise are marked."""
    order = Window.partitionBy("stream_id").orderBy("obs")
    after = F.lead("pts").over(order)
    return observations.withColumns({"duration": after - F.col("pts"), "error": F.coalesce(after <= F.col("pts"), F.lit(False))})


def display_aspect(width: Column, height: Column, sar_w: Column, sar_h: Column) -> tuple[Column, Column]:
    """Exact ratio of the displayed picture, in lowest terms."""
    a, b = width.cast("long") * sar_w, height.cast("long") * sar_h
    # the greatest common divisor by a fold over a fixed number of steps (enough for 64 bits)
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, s["a"]).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    return (a / gcd).cast("long"), (b / gcd).cast("long")


def epoch_of(observations: DataFrame, epochs: DataFrame) -> DataFrame:
    """Each observation with the epoch that holds at its time: the last that begins at or before it."""
    marks = epochs.select("stream_id", F.col("begin").alias("pts"), "epoch_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("obs"))
    rows = observations.select("stream_id", "pts", F.lit(None).cast("long").alias("epoch_id"), F.lit(1).alias("kind"), "obs")
    upto = Window.partitionBy("stream_id").orderBy("pts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(rows).withColumn("epoch_id", F.last("epoch_id", ignorenulls=True).over(upto)).filter("kind = 1").select("stream_id", "obs", "pts", "epoch_id")


def feature_bits(programs: DataFrame) -> DataFrame:
    """Least feature bits of a stream from what its groups use (1 external objects, 2 quantised, 4 motion, 8 warps)."""
    has = lambda c, bit: F.when(F.bool_or(c), bit).otherwise(0)
    return programs.groupBy("stream_id").agg((has("external", 1) + has("quantized", 2) + has("moving", 4) + has("warped", 8)).cast("int").alias("bits"))


def program_errors(programs: DataFrame) -> DataFrame:
    """Trajectory programs (segments: array of struct vx, vy, ax, ay, steps): steps of at least one, and no two linear
    segments of one velocity side by side."""
    short = F.exists("segments", lambda s: s["steps"] < 1)
    linear = lambda s: (s["ax"] == 0) & (s["ay"] == 0)
    n = F.size("segments")
    pairs = F.zip_with(F.slice("segments", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("segments", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: linear(a) & linear(b) & (a["vx"] == b["vx"]) & (a["vy"] == b["vy"]))
    return programs.withColumn("error", F.when(short, "steps").when(F.exists(pairs, lambda p: p), "unmerged"))


def observation_errors(observed: DataFrame, epochs: DataFrame) -> DataFrame:
    """What observations break of their epochs: (obs, error), an empty list for one that holds.

    epochs: epoch_id, width, height, layout, depths (one for all planes, or one each), known: the layout's planes in order as an array
    of struct (sub_w, sub_h). observed: obs, epoch_id, planes (array of struct w, h, depth, bytes)."""
    wide = lambda n, k: F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1), k) - 1, k)
    depth = lambda i: F.when(F.size("depths") == 1, F.get("depths", F.lit(0))).otherwise(F.get("depths", i))
    want = F.transform("known", lambda p, i: F.struct(wide(F.col("width"), p["sub_w"]).alias("w"), wide(F.col("height"), p["sub_h"]).alias("h"), depth(i).alias("depth")))
    rows = observed.join(epochs.withColumn("want", want), "epoch_id", "left")
    fits = F.zip_with("planes", "want", lambda a, b: (a["w"] == b["w"]) & (a["h"] == b["h"]) & (a["depth"] == b["depth"]))
    whole = F.transform("planes", lambda a: a["bytes"] == a["w"] * a["h"] * F.when(a["depth"] > 8, 2).otherwise(1))
    error = F.when(F.col("want").isNull(), "unknown epoch").when(~F.size("depths").isin(1) & (F.size("depths") != F.size("known")), "depths").when(F.size("planes") != F.size("want"), "plane count")
    error = error.when(~F.forall(fits, lambda x: F.coalesce(x, F.lit(False))), "geometry").when(~F.forall(whole, lambda x: x), "payload length")
    return rows.select("obs", error.alias("error"))


def work_within(instances: DataFrame, cap: int) -> DataFrame:
    """Streams whose affine instances (stream_id, width, height of the canvas) ask for no more samples than the cap: stream_id, work, ok.
    The sum is taken before anything is painted."""
    work = instances.groupBy("stream_id").agg(F.sum(F.col("width").cast("decimal(20,0)") * F.col("height")).alias("work"))
    return work.select("stream_id", F.col("work").cast("long").alias("work"), (F.col("work") <= cap).alias("ok"))
