"""Raw frames and text manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw_frames(files: DataFrame, width: int, height: int) -> DataFrame:
    """Frames of `binaryFile` rows that hold frames back to back: path, frame, samples; a length that does not divide is an error."""
    size = width * height
    n = F.expr(f"octet_length(content) div {size}")
    rest = F.octet_length("content") % size
    rows = files.select("path", "content", F.when((rest != 0) | (n == 0), "length").alias("error"), F.explode_outer(F.when((rest == 0) & (n > 0), F.sequence(F.lit(0).cast("long"), n - 1))).alias("frame"))
    return rows.select("path", "frame", F.expr(f"substring(content, cast(frame * {size} + 1 as int), {size})").alias("samples"), "error")


def dense(frames: DataFrame, width: int) -> DataFrame:
    """Rows y, x, v of packed frames (small canvases only)."""
    rows = frames.withColumn("p", F.explode(F.sequence(F.lit(0), F.octet_length("samples") - 1)))
    return rows.withColumns({"y": F.expr(f"p div {width}").cast("int"), "x": (F.col("p") % width).cast("int"), "v": F.conv(F.hex(F.expr("substring(samples, p + 1, 1)")), 16, 10).cast("int")}).drop("p", "samples")


def framehash(lines: DataFrame) -> DataFrame:
    """Rows of a frame hash listing (value: a text line): frame, dts, pts, duration, size, hash. `#` lines are comments; N/A is null."""
    parts = F.split(F.col("value"), r"\s*,\s*")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))
    n = lambda i: F.when(F.trim(F.get("p", F.lit(i))) != "N/A", F.trim(F.get("p", F.lit(i))).cast("long"))
    order = rows.select(F.monotonically_increasing_id().alias("ord"), n(1).alias("dts"), n(2).alias("pts"), n(3).alias("duration"), n(4).alias("size"), F.lower(F.trim(F.get("p", F.lit(5)))).alias("hash"))
    # numbered within each partition, then by how many rows the partitions before have (one row a partition)
    order = order.withColumn("part", F.shiftright("ord", 33))
    sizes = order.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    return order.withColumn("own", own).join(F.broadcast(before), "part").withColumn("frame", (F.col("before") + F.col("own")).cast("long")).drop("ord", "part", "own", "before")


def time_base(lines: DataFrame) -> DataFrame:
    """num and den of the `#tb 0: num/den` line."""
    m = F.regexp_extract("value", r"^#tb 0:\s*(\d+)/(\d+)", 1), F.regexp_extract("value", r"^#tb 0:\s*(\d+)/(\d+)", 2)
    return lines.filter(F.col("value").rlike(r"^#tb 0:")).select(m[0].cast("long").alias("num"), m[1].cast("long").alias("den"))


def probe(lines: DataFrame) -> DataFrame:
    """Streams of key=value lines (section, value): one row for each section with its pairs as a map."""
    pairs = lines.filter(F.col("value").contains("=")).select("section", F.substring_index("value", "=", 1).alias("k"), F.expr("substring(value, locate('=', value) + 1)").alias("v"))
    return pairs.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("pairs"))


def chosen_stream(streams: DataFrame) -> DataFrame:
    """The default stream, else the one of lowest index."""
    rows = streams.select((F.col("pairs")["disposition.default"] != "1").alias("other"), F.col("pairs")["index"].cast("int").alias("index"), "pairs")
    return rows.agg(F.min_by("pairs", F.struct("other", "index")).alias("pairs"))


def verified_import(frames: DataFrame, hashes: DataFrame) -> DataFrame:
    """Frames (frame, pts, size, digest) against a listing, one row for each frame that differs."""
    both = frames.join(hashes.select("frame", F.col("pts").alias("want_pts"), F.col("size").alias("want_size"), F.col("hash").alias("want_hash")), "frame", "full_outer")
    error = F.when(F.col("digest").isNull(), "missing").when(F.col("want_hash").isNull(), "unexpected").when(F.col("size") != F.col("want_size"), "size").when(F.col("digest") != F.col("want_hash"), "hash").when(~F.col("pts").eqNullSafe(F.col("want_pts")), "time")
    return both.withColumn("error", error).filter("error IS NOT NULL").select("frame", "error")


def write_frames(frames: DataFrame, path: str) -> None:
    """Packed frames as Parquet, a stream a folder. A long stream spreads over tasks by runs of frames."""
    frames.repartition("stream_id", F.expr("frame div 4096")).sortWithinPartitions("stream_id", "frame").write.mode("overwrite").partitionBy("stream_id").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
