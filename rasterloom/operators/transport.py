"""Packets in sequence. A gap ends what can be played: nothing after it is applied, late packets are not waited for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of framing of a packet (length, kind, sequence), and packet kinds.
OVERHEAD = 13
KINDS = {0x00: "header", 0x01: "object", 0x02: "palette", 0x03: "checkpoint", 0x04: "interval", 0x7E: "integrity"}
# Wire tags of transitions and their labels.
EVENTS = {
    0x21: "create_instance", 0x22: "set_position", 0x23: "patch_sparse", 0x24: "copy_rect", 0x25: "move_rect", 0x26: "set_velocity", 0x27: "advance_translations", 0x28: "clear_instances", 0x29: "clear_overlay",
    0x2A: "residual", 0x2B: "set_trajectory", 0x2C: "advance_trajectories", 0x2D: "set_palette", 0x2E: "patch_palette", 0x2F: "bind_palette", 0x30: "set_affine", 0x31: "transform_residual", 0x32: "global_predict",
}


def label(tag: Column, names: dict[int, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[tag.cast("int")], F.lit("unknown"))


def frame(kind: Column, seq: Column, body: Column) -> Column:
    """A packet's bytes: length of what follows (4, little endian), kind (1), sequence (8), body."""
    size = F.octet_length(body).cast("long") + 9
    return F.concat(_little(size, 4), _little(kind.cast("long"), 1), _little(seq, 8), body)


def _little(n: Column, width: int) -> Column:
    big = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(width))]))


def _number(data: Column, at: int, width: int) -> Column:
    h = F.hex(F.substring(data, at, width))
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))]), 16, 10).cast("long")


def parsed(packets: DataFrame) -> DataFrame:
    """kind, seq and body of packets (frame binary); error names a length that does not fit."""
    data = F.col("frame")
    n = F.octet_length(data)
    ok = (n >= OVERHEAD) & (_number(data, 1, 4) == n - 4)
    error = F.when(n < OVERHEAD, "truncated").when(~ok, "bad frame length")
    return packets.withColumns({"error": error, "kind": F.when(ok, _number(data, 5, 1).cast("int")), "seq": F.when(ok, _number(data, 6, 8)), "body": F.when(ok, F.expr("substring(frame, 14)"))})


def playable(packets: DataFrame) -> DataFrame:
    """Marks packets (stream_id, seq) before the first gap of their stream; streams count from 0."""
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1
    return packets.withColumn("applied", F.col("seq") == nth)


def gaps(packets: DataFrame) -> DataFrame:
    """Each stream's playable packets and the first sequence number that is missing though later ones came."""
    rows = playable(packets).groupBy("stream_id").agg(F.count(F.when(F.col("applied"), 1)).alias("applied"), F.count("*").alias("received"))
    return rows.withColumn("gap_at", F.when(F.col("applied") < F.col("received"), F.col("applied")))


def profile(records: DataFrame) -> DataFrame:
    """Bytes, framed bytes, events and residual bytes of each interval (stream_id, t, label, bytes)."""
    return records.groupBy("stream_id", "t").agg(F.sum("bytes").alias("bytes"), (F.sum("bytes") + OVERHEAD).alias("framed"), F.count("*").alias("events"), F.coalesce(F.sum(F.when(F.col("label") == "residual", F.col("bytes"))), F.lit(0)).alias("residual"))


def order_errors(packets: DataFrame) -> DataFrame:
    """First breach of the order rules in each stream (stream_id, seq, kind): header first, declarations before the one
    checkpoint, intervals after it, nothing after the integrity packet."""
    order = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, 1)).over(order), F.lit(0)) == 1
    kind = F.col("kind")
    error = F.when((F.col("seq") == 0) != (kind == "header"), "header not first").when(kind.isin("object", "palette") & seen("checkpoint"), "declaration after checkpoint")
    error = error.when((kind == "checkpoint") & seen("checkpoint"), "second checkpoint").when((kind == "interval") & ~seen("checkpoint"), "interval before checkpoint").when(seen("integrity"), "packet after the end")
    return packets.withColumn("error", error).filter("error IS NOT NULL").groupBy("stream_id").agg(F.min(F.struct("seq", "error")).alias("e")).select("stream_id", "e.seq", "e.error")
