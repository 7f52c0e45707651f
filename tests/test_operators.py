"""Behaviour that the registered queries do not reach: round trips, hostile blocks, hot keys, clipping."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.functions import scalar
from rasterloom.operators import chain, codec, compare, court, media, paint, region, store, transport


def test_coder_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 1000, 5000):
        for pick in (b"a", b"abc", bytes(range(256))):
            data = bytes(rng.choice(pick) for _ in range(n))
            assert codec.unblock(codec.block(data)) == data
    skewed = bytes(min(255, int(rng.expovariate(0.3))) for _ in range(20000))
    assert codec.block(skewed)[0] == 1 and len(codec.block(skewed)) < len(skewed)
    assert int(codec.model_of(skewed).sum()) == codec.TOTAL


def test_blocks_that_are_wrong():
    good = codec.block(b"ab" * 4000)
    for bad in (b"", good[:8], good[:-1], good + b"x", b"\x05" + good[1:], good[:9] + b"\xff" + good[10:]):
        with pytest.raises(ValueError):
            codec.unblock(bad)


def test_coder_model_is_the_relational_one(spark):
    data = "the quick brown fox jumps over the lazy dog " * 7
    rows = codec.byte_model(codec.byte_counts(spark.createDataFrame([(1, data)], "k int, t string"), "k", "t"), "k").collect()
    model = codec.model_of(data.encode())
    assert {r.sym: r.freq for r in rows} == {s: int(model[s]) for s in range(256) if model[s]}


def test_copy_is_clipped_and_reads_before_it_writes():
    canvas = np.arange(20, dtype=np.uint8).reshape(4, 5)
    out = chain.copy_rect(canvas, 0, 0, 5, 4, 1, 1)
    assert (out[1:, 1:] == canvas[:3, :4]).all() and (out[0] == canvas[0]).all()
    assert (chain.copy_rect(canvas, -2, 0, 4, 2, 0, 3)[3, 2:4] == canvas[0, :2]).all()
    assert (chain.copy_rect(canvas, 9, 9, 3, 3, 0, 0) == canvas).all()


def test_view_is_a_crop_of_the_frame(spark):
    rng = random.Random(3)
    boxes = spark.createDataFrame([(1, z, rng.randint(-9, 60), rng.randint(-9, 50), rng.randint(1, 20), rng.randint(1, 20), rng.randint(0, 255)) for z in range(60)], "stream_id int, z long, x long, y long, w long, h long, v int")
    full = {(r.py, r.px): r.v for r in paint.fill_paint(boxes, (0, 0, 64, 48), ["stream_id"]).collect()}
    part = {(r.py, r.px): r.v for r in paint.fill_paint(boxes, (8, 7, 33, 30), ["stream_id"]).collect()}
    assert part == {k: v for k, v in full.items() if 7 <= k[0] < 30 and 8 <= k[1] < 33}


def test_view_filter_reaches_the_boxes(spark):
    boxes = spark.range(10).selectExpr("1 stream_id", "id z", "id x", "id y", "2 w", "2 h", "1 v")
    plan = paint.fill_paint(boxes, (0, 0, 4, 4), ["stream_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Filter")  # the tree prints the root first: boxes are cut before they are exploded


def test_numbers(spark):
    rows = spark.createDataFrame([(-5, 2), (5, 2), (-6, 3), (0, 7)], "a long, b long")
    assert [r[0] for r in rows.select(scalar.floor_div(F.col("a"), F.col("b"))).collect()] == [-3, 2, -2, 0]
    assert scalar.crc32_plain(b"123456789") == 0x89A1897F
    q = rows.select(scalar.quantize(F.lit(255), 1), scalar.quantize(F.lit(7), 0), scalar.quantize(F.lit(255), 7, False)).first()
    assert tuple(q) == (255, 7, 128)
    assert rows.select(compare.position_after(F.lit(4), F.lit(3), F.lit(2))).first()[0] == 3 + 5 + 7 + 9


def test_frames_of_packets(spark):
    rows = spark.createDataFrame([(4, 258, bytearray(b"xy"))], "kind int, seq long, body binary")
    got = transport.parsed(rows.select(transport.frame(F.col("kind"), F.col("seq"), F.col("body")).alias("frame"))).first()
    assert bytes(got.frame) == b"\x0b\0\0\0\x04\x02\x01\0\0\0\0\0\0xy" and (got.kind, got.seq, bytes(got.body)) == (4, 258, b"xy")
    assert [r.error for r in transport.parsed(spark.createDataFrame([(bytearray(b"x"),)], "frame binary")).collect()] == ["truncated"]
    names = spark.range(1).select(transport.label(F.lit(0x2A), transport.EVENTS).alias("a"), transport.label(F.lit(1), transport.KINDS).alias("b"), transport.label(F.lit(99), transport.KINDS).alias("c"))
    assert tuple(names.first()) == ("residual", "object", "unknown")


def test_regions_by_cells(spark):
    rng = random.Random(5)
    spans = [(rng.randint(0, 6), a, a + rng.randint(0, 6)) for a in (rng.randint(0, 40) for _ in range(80))]
    df = spark.createDataFrame(spans, "y int, x0 int, x1 int")
    cells = lambda rows: {(r.y, x) for r in rows for x in range(r.x0, r.x1)}
    merged = region.merged(df, ["y"])
    want = {(y, x) for y, a, b in spans for x in range(a, b)}
    rows = merged.collect()
    assert cells(rows) == want and sum(r.x1 - r.x0 for r in rows) == len(want)
    box = lambda c: 2 <= c[0] < 5 and 10 <= c[1] < 25
    assert cells(region.intersected(merged, 10, 2, 25, 5).collect()) == {c for c in want if box(c)}
    assert cells(region.subtracted(merged, 10, 2, 25, 5).collect()) == {c for c in want if not box(c)}


def test_content_ids_and_verification(spark):
    ids = spark.range(2).select(store.content_id(F.lit(1), F.lit(2), F.lit(3), F.lit("abc").cast("binary")).alias("i")).distinct().collect()
    assert [r.i for r in ids] == [hashlib.sha256(b"1:2:3:abc").hexdigest()]
    want = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "stream_id int, ord int, digest string")
    got = spark.createDataFrame([(1, 0, "a"), (2, 0, "c"), (2, 1, "d")], want.schema)
    assert {tuple(r) for r in store.verified(want, got).collect()} == {(1, 1, "missing"), (2, 1, "unexpected")}


def test_costs_sum_to_the_total(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "a", 1)], "stream_id int, bucket string, bytes long")
    assert tuple(court.cost_buckets(rows, ("a", "b", "c")).first()) == (1, 6, 6, 0, 12)


def test_layouts(spark):
    planes = media.planes(spark.createDataFrame([("yuv420", 5, 3, 10)], "layout string, width int, height int, depth int"), media.layouts(spark))
    assert sorted((r.plane, r.w, r.h, r.bytes) for r in planes.collect()) == [(0, 5, 3, 30), (1, 3, 2, 12), (2, 3, 2, 12)]
