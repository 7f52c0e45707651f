"""Content identity, sharing, collection and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: bytes of framing of a stored record.
FRAMING = 40


def content_id(kind: Column, width: Column, height: Column, payload: Column) -> Column:
    """Digest of the canonical record: kind, sizes, payload. Equal ids are equal contents."""
    head = F.concat_ws(":", kind.cast("string"), width.cast("string"), height.cast("string"), F.lit(""))
    return F.sha2(F.concat(head.cast("binary"), payload), 256)


def contents(blobs: DataFrame) -> DataFrame:
    """Distinct contents with how often each is declared and who has it first."""
    return blobs.groupBy("cid").agg(F.count("*").alias("declared"), F.min("seq").alias("first"), F.max("bytes").alias("bytes"))


def published(blobs: DataFrame) -> DataFrame:
    """New and reused objects of each root, in publishing order: the first to publish a content stores it."""
    first = blobs.groupBy("cid").agg(F.min_by(F.struct("root", "bytes"), "seq").alias("b")).select("b.root", "b.bytes")
    new = first.groupBy("root").agg(F.count("*").alias("new"), F.sum("bytes").alias("stored"))
    every = blobs.groupBy("root").agg(F.count("*").alias("n"))  # no content, however frequent, meets its copies in a join
    fresh = F.coalesce("new", F.lit(0))
    return every.join(new, "root", "left").select("root", fresh.alias("new"), (F.col("n") - fresh).alias("reused"), F.coalesce("stored", F.lit(0)).alias("stored"))


def accounting(blobs: DataFrame) -> DataFrame:
    """declared, unique and physical bytes, and what sharing saves."""
    unique = contents(blobs).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("unique_bytes"), F.count("*").alias("objects"))
    declared = blobs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("declared_bytes"))
    out = declared.crossJoin(unique)  # one row each
    return out.withColumns({"physical_bytes": F.col("unique_bytes") + FRAMING * F.col("objects"), "saved_bytes": F.greatest(F.lit(0), F.col("declared_bytes") - F.col("unique_bytes"))})


def collected(blobs: DataFrame, live_roots: DataFrame) -> DataFrame:
    """Each stored content and whether a live root holds it."""
    held = blobs.join(live_roots, "root", "left_semi").select("cid").distinct().withColumn("live", F.lit(True))
    return blobs.groupBy("cid").agg(F.max("bytes").alias("bytes")).join(held, "cid", "left").withColumn("live", F.coalesce("live", F.lit(False)))


def missing(blobs: DataFrame, store: DataFrame) -> DataFrame:
    """References whose content the store lacks."""
    return blobs.join(store.select("cid").distinct(), "cid", "left_anti")


def record_index(records: DataFrame) -> DataFrame:
    """Adds offset, the running sum of the lengths before a record of its stream."""
    before = Window.partitionBy("stream_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def merged(objects: DataFrame) -> DataFrame:
    """Maps each object to the first of its stream with equal content."""
    return objects.withColumn("keeps", F.min("seq").over(Window.partitionBy("root", "cid")))


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """First differing or absent record of each stream, or complete."""
    both = expected.select("stream_id", "ord", F.col("digest").alias("want")).join(actual.select("stream_id", "ord", F.col("digest").alias("got")), ["stream_id", "ord"], "full_outer")
    bad = ~F.col("want").eqNullSafe(F.col("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").otherwise("different")
    first = F.min(F.when(bad, F.struct("ord", status.alias("status"))))
    return both.groupBy("stream_id").agg(first.alias("f")).select("stream_id", F.col("f.ord").alias("first_bad"), F.coalesce("f.status", F.lit("complete")).alias("status"))


def promoted(residuals: DataFrame, least: int = 2) -> DataFrame:
    """Runs of frames with one identical residual (stream_id, t, digest, bytes): what one lasting patch in its place saves."""
    order = Window.partitionBy("stream_id").orderBy("t")
    islands = residuals.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy("stream_id", "digest").orderBy("t")))
    runs = islands.groupBy("stream_id", "digest", "island").agg(F.min("t").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    # a run of n residual groups (18 + bytes each) becomes one patch (18 + bytes) and n - 1 empty groups
    return runs.filter(F.col("n") >= least).withColumn("saved", (F.col("n") - 1) * (18 + F.col("bytes") - 13)).filter("saved > 0").drop("island", "digest")
