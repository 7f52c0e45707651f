"""Queries of painting, views and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import chain, paint
from .adapters import BOXES, FRAMES, HEIGHT, WIDTH, boxes, frames, read

ALL = (0, 0, WIDTH, HEIGHT)
SUMS = "count(*) AS n, CAST(sum(v * (py * 64 + px + 1)) AS BIGINT) AS weighted"
#: Every write of every box, by a dense grid instead of by exploded boxes.
GRID = f"""{BOXES}, px AS (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS px), py AS (SELECT CAST(unnest(range(0, 48)) AS BIGINT) AS py),
wr AS (SELECT bx.*, px, py FROM bx JOIN px ON px.px >= bx.x AND px.px < bx.x + bx.w JOIN py ON py.py >= bx.y AND py.py < bx.y + bx.h),
top AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY stream_id, py, px ORDER BY z DESC) = 1)"""


def moving_rect(spark, sf_dir):
    """A 200 x 100 rectangle of 180 on 1920 x 1080, at x = 100 + 2 t: 101 frames as spans, never as two million samples."""
    t = spark.range(101).select(F.col("id").alias("frame"), (100 + 2 * F.col("id")).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(200).alias("w"), F.lit(100).alias("h"), F.lit(180).alias("v"))
    rows = paint.clipped(t, 0, 0, 1920, 1080).withColumn("py", F.explode(F.sequence("cy0", F.col("cy1") - 1)))
    first, last = F.col("py") * 1920 + F.col("cx0") + 1, F.col("py") * 1920 + F.col("cx1")
    n = F.col("cx1") - F.col("cx0")
    return rows.groupBy("frame").agg(F.sum(n).cast("long").alias("n"), F.sum(F.col("v") * F.expr("(cx1 - cx0)") * (first + last) / 2).cast("long").alias("weighted"))


MOVING_RECT = """WITH f AS (SELECT CAST(unnest(range(0, 101)) AS BIGINT) AS frame), c AS (SELECT unnest(range(0, 200)) AS i), r AS (SELECT unnest(range(0, 100)) AS j)
SELECT frame, count(*) AS n, CAST(sum(180 * (j * 1920 + 100 + 2 * frame + i + 1)) AS BIGINT) AS weighted FROM f, c, r GROUP BY frame"""


def fills(spark, sf_dir):
    return paint.checksum(paint.fill_paint(boxes(spark, sf_dir), ALL, ["stream_id"]), ["stream_id"], WIDTH)


FILLS = f"WITH {GRID} SELECT stream_id, {SUMS} FROM top GROUP BY stream_id"


def crop(spark, sf_dir):
    return paint.checksum(paint.fill_paint(boxes(spark, sf_dir), (10, 5, 42, 29), ["stream_id"]), ["stream_id"], WIDTH)


CROP = f"WITH {GRID} SELECT stream_id, {SUMS} FROM top WHERE px >= 10 AND px < 42 AND py >= 5 AND py < 29 GROUP BY stream_id"


def tiles(spark, sf_dir):
    """16 x 16 tiles of the whole canvas, painted once."""
    top = paint.fill_paint(boxes(spark, sf_dir), ALL, ["stream_id"])
    return paint.checksum(top.withColumns({"ty": F.shiftright("py", 4).cast("long"), "tx": F.shiftright("px", 4).cast("long")}), ["stream_id", "ty", "tx"], WIDTH)


TILES = f"WITH {GRID} SELECT stream_id, py // 16 AS ty, px // 16 AS tx, {SUMS} FROM top GROUP BY ALL"


def work(spark, sf_dir):
    """Writes, overpaint and boxes that the view touches, for each stream."""
    cut = paint.clipped(boxes(spark, sf_dir), 10, 5, 42, 29)
    area = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    shown = paint.fill_paint(boxes(spark, sf_dir), (10, 5, 42, 29), ["stream_id"]).groupBy("stream_id").agg(F.count("*").alias("shown"))
    return cut.groupBy("stream_id").agg(F.sum(area).cast("long").alias("writes"), F.count("*").alias("touched")).join(shown, "stream_id")


WORK = f"""WITH {GRID} SELECT stream_id, count(*) AS writes, count(DISTINCT z) AS touched, count(DISTINCT (py, px)) AS shown
FROM wr WHERE px >= 10 AND px < 42 AND py >= 5 AND py < 29 GROUP BY stream_id"""


def overlay(spark, sf_dir):
    """Boxes below, points of customers on top; points outside the canvas are dropped."""
    below = paint.exploded(paint.clipped(boxes(spark, sf_dir), *ALL)).select("stream_id", "py", "px", F.lit(0).alias("layer"), "z", "v")
    k = F.col("c_custkey")
    above = read(spark, sf_dir, "customer").select((k % 50 + 1).cast("int").alias("stream_id"), (k * 11 % 52).alias("py"), (k * 17 % 70).alias("px"), F.lit(1).alias("layer"), k.alias("z"), (k % 256).cast("int").alias("v"))
    both = below.unionByName(above.filter(f"px < {WIDTH} AND py < {HEIGHT}"))
    return paint.checksum(paint.topmost(both, ["stream_id", "py", "px"], ["layer", "z"]), ["stream_id"], WIDTH)


OVERLAY = f"""WITH {GRID}, pt AS (SELECT CAST(c_custkey % 50 + 1 AS INTEGER) AS stream_id, c_custkey * 11 % 52 AS py, c_custkey * 17 % 70 AS px, CAST(arg_max(c_custkey % 256, c_custkey) AS INTEGER) AS v
  FROM customer WHERE c_custkey * 17 % 70 < 64 AND c_custkey * 11 % 52 < 48 GROUP BY ALL),
al AS (SELECT coalesce(p.stream_id, t.stream_id) AS stream_id, coalesce(p.py, t.py) AS py, coalesce(p.px, t.px) AS px, coalesce(p.v, t.v) AS v
  FROM top t FULL JOIN pt p ON p.stream_id = t.stream_id AND p.py = t.py AND p.px = t.px)
SELECT stream_id, {SUMS} FROM al GROUP BY stream_id"""


def _tiles_of(spark, sf_dir):
    rasters = frames(spark, sf_dir).select(F.col("vec_id").alias("object"), F.col("y").alias("oy"), F.col("x").alias("ox"), "v", "stream_id")
    placed = read(spark, sf_dir, "embeddings").select(F.col("label").alias("stream_id"), F.col("vec_id").alias("object"), F.col("vec_id").alias("z"), (F.col("vec_id") * 5 % 68 - 4).alias("x"), (F.col("vec_id") * 3 % 52 - 4).alias("y"))
    return placed, rasters


PLACED = f"""{FRAMES}, hit AS (SELECT stream_id, vec_id AS z, vec_id * 5 % 68 - 4 + x AS px, vec_id * 3 % 52 - 4 + y AS py, v FROM fr)"""


def rasters(spark, sf_dir):
    placed, tiles_ = _tiles_of(spark, sf_dir)
    return paint.checksum(paint.raster_paint(placed, tiles_.drop("stream_id"), ["stream_id"], WIDTH, HEIGHT), ["stream_id"], WIDTH)


RASTERS = f"""WITH {PLACED} SELECT stream_id, {SUMS} FROM (SELECT * FROM hit WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47
  QUALIFY row_number() OVER (PARTITION BY stream_id, py, px ORDER BY z DESC) = 1) GROUP BY stream_id"""


def indexed(spark, sf_dir):
    """Tiles of indexes into a palette of nations; an index beyond the palette is an error, counted."""
    n = F.col("n_nationkey")
    entries = read(spark, sf_dir, "nation").filter("n_nationkey < 14").select(n.cast("int").alias("idx"), (n * 37 % 256).cast("int").alias("entry"))
    rows = frames(spark, sf_dir).withColumn("idx", F.shiftright("v", 4)).join(F.broadcast(entries), "idx", "left")
    return rows.groupBy("stream_id", "frame").agg(F.count(F.when(F.col("entry").isNull(), 1)).alias("errors"), F.sum(F.col("entry") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


INDEXED = f"""WITH {FRAMES}, p AS (SELECT list(n_nationkey * 37 % 256 ORDER BY n_nationkey) AS e FROM nation WHERE n_nationkey < 14)
SELECT stream_id, frame, count(*) FILTER (v // 16 >= 14) AS errors, CAST(sum(e[v // 16 + 1] * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM fr, p GROUP BY stream_id, frame"""


def generated(spark, sf_dir):
    z = F.col("z")
    kind = z % 3
    x, y = F.col("lx"), F.col("ly")
    sample = F.when(kind == 0, scalar.gradient(z % 256, z % 11 - 5, z % 7 - 3, x, y)).when(kind == 1, scalar.checker(z % 256, z * 3 % 256, 1 + z % 3, x, y)).otherwise(scalar.periodic(z % 256, z % 13 - 6, z % 5 - 2, 1 + z % 4, x, y))
    return paint.checksum(paint.shaded(boxes(spark, sf_dir), ALL, sample, ["stream_id"]), ["stream_id"], WIDTH)


GENERATED = f"""WITH {GRID}, s AS (SELECT stream_id, py, px, CASE z % 3 WHEN 0 THEN ((z % 256 + (z % 11 - 5) * (px - x) + (z % 7 - 3) * (py - y)) % 256 + 256) % 256
  WHEN 1 THEN CASE WHEN ((px - x) // (1 + z % 3) + (py - y) // (1 + z % 3)) % 2 = 0 THEN z % 256 ELSE z * 3 % 256 END
  ELSE ((z % 256 + (z % 13 - 6) * ((px - x) % (1 + z % 4)) + (z % 5 - 2) * ((py - y) % (1 + z % 4))) % 256 + 256) % 256 END AS v FROM top)
SELECT stream_id, {SUMS} FROM s GROUP BY stream_id"""


def noise(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", scalar.noise(k * 1000003, k - 1000, F.col("p_size").cast("long")).alias("v"), scalar.noise_deep(k * 1000003, k - 1000, F.col("p_size").cast("long"), 1023).alias("deep"))


NOISE = """WITH m AS (SELECT 18446744073709551616::UHUGEINT AS m), u AS (SELECT p_partkey, (p_partkey * 1000003)::UHUGEINT AS s, ((p_partkey - 1000)::HUGEINT + 18446744073709551616::HUGEINT)::UHUGEINT % m AS x, p_size::UHUGEINT AS y, m FROM part, m),
a AS (SELECT p_partkey, m, xor(xor(s::UBIGINT, (x * 11400714819323198485::UHUGEINT % m)::UBIGINT), (y * 13787848793156543929::UHUGEINT % m)::UBIGINT) AS h FROM u),
b AS (SELECT p_partkey, m, (xor(h, h >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % m)::UBIGINT AS h FROM a),
c AS (SELECT p_partkey, m, (xor(h, h >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % m)::UBIGINT AS h FROM b)
SELECT p_partkey, CAST(xor(h, h >> 31) >> 56 AS INTEGER) AS v, CAST(((xor(h, h >> 31) >> 56) * 1024) >> 8 AS INTEGER) AS deep FROM c"""


def affine(spark, sf_dir):
    """Tiles of 8 x 8 turned and scaled over the canvas, one for each nation."""
    k = F.col("n_nationkey").cast("long")
    placed = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("stream_id"), k.alias("object"), k.alias("z"), (F.when(k % 2 == 0, 64 + k).otherwise(0)).alias("a"), F.when(k % 2 == 1, 48 + k).otherwise(k - 12).alias("b"), (k * 100 - 1500).alias("c"), (12 - k).alias("d"), (F.when(k % 2 == 0, 64).otherwise(40)).cast("long").alias("e"), (k * 37 - 700).alias("f"))
    tiles_ = frames(spark, sf_dir).select(F.col("vec_id").alias("object"), F.col("y").alias("oy"), F.col("x").alias("ox"), "v")
    return paint.checksum(paint.affine_paint(placed, tiles_, ["stream_id"], WIDTH, HEIGHT, 8), ["stream_id"], WIDTH)


AFFINE = f"""WITH {FRAMES}, af AS (SELECT n_regionkey AS stream_id, CAST(n_nationkey AS BIGINT) AS k FROM nation),
g AS (SELECT stream_id, k, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, CAST(floor(((CASE WHEN k % 2 = 0 THEN 64 + k ELSE 0 END) * px + (CASE WHEN k % 2 = 1 THEN 48 + k ELSE k - 12 END) * py + k * 100 - 1500) / 256) AS BIGINT) AS ox,
  CAST(floor(((12 - k) * px + (CASE WHEN k % 2 = 0 THEN 64 ELSE 40 END) * py + k * 37 - 700) / 256) AS BIGINT) AS oy FROM af, range(64) a(px), range(48) b(py)),
h AS (SELECT g.stream_id, py, px, k, fr.v FROM g JOIN fr ON fr.vec_id = g.k AND fr.x = g.ox AND fr.y = g.oy QUALIFY row_number() OVER (PARTITION BY g.stream_id, py, px ORDER BY k DESC) = 1)
SELECT stream_id, {SUMS} FROM h GROUP BY stream_id"""


def scrolled(spark, sf_dir):
    first = frames(spark, sf_dir).filter("frame = 0").groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    hexed = F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")
    packed = first.select(F.col("stream_id").cast("int").alias("stream_id"), F.unhex(hexed).alias("samples"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    out = chain.scroll(packed, 12, 3)
    dense = out.select("stream_id", "frame", "samples", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    v = F.conv(F.hex(F.expr("substring(samples, p + 1, 1)")), 16, 10).cast("long")
    return dense.groupBy("stream_id", "frame").agg(F.sum(v * (F.col("p") + 1)).cast("long").alias("weighted"))


SCROLLED = f"""WITH {FRAMES} SELECT CAST(stream_id AS INTEGER) AS stream_id, CAST(t AS BIGINT) AS frame, CAST(sum(v * (y * 8 + ((x - 3 * t) % 8 + 8) % 8 + 1)) AS BIGINT) AS weighted
FROM fr, range(0, 13) r(t) WHERE frame = 0 GROUP BY ALL"""


def warped(spark, sf_dir):
    out = chain.predicted(frames(spark, sf_dir), 250, 20, -300, -15, 262, 140)
    return out.groupBy("stream_id", "frame").agg(F.sum(F.col("pred") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


WARPED = f"""WITH {FRAMES}, l AS (SELECT stream_id, frame, list(v ORDER BY y, x) AS s FROM fr GROUP BY ALL),
j AS (SELECT c.stream_id, c.frame, c.s, p.s AS q, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y FROM l c LEFT JOIN l p ON p.stream_id = c.stream_id AND p.frame = c.frame - 1, range(0, 64) r(i)),
m AS (SELECT *, CAST(floor((250 * x + 20 * y - 300) / 256) AS INTEGER) AS sx, CAST(floor((-15 * x + 262 * y + 140) / 256) AS INTEGER) AS sy FROM j)
SELECT stream_id, frame, CAST(sum((CASE WHEN q IS NOT NULL AND sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN q[sy * 8 + sx + 1] ELSE s[y * 8 + x + 1] END) * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM m GROUP BY ALL"""


def residual(spark, sf_dir):
    points = frames(spark, sf_dir).filter("(x + y * 3 + frame) % 7 = 0").select("stream_id", "frame", "y", "x", (255 - F.col("v")).alias("v"))
    out = chain.residual(frames(spark, sf_dir), points)
    return out.groupBy("stream_id", "frame").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


RESIDUAL = f"""WITH {FRAMES} SELECT stream_id, frame, CAST(sum((CASE WHEN (x + y * 3 + frame) % 7 = 0 THEN 255 - v ELSE v END) * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM fr GROUP BY ALL"""


def additive(spark, sf_dir):
    deltas = frames(spark, sf_dir).filter("(x + y) % 2 = 0").select("stream_id", "frame", "y", "x", (F.col("v") % 41 - 150).alias("v"))
    out = chain.transform_residual(frames(spark, sf_dir), deltas)
    return out.groupBy("stream_id", "frame").agg(F.max("error").alias("error"), F.sum("sum").cast("long").alias("total"))


ADDITIVE = f"""WITH {FRAMES}, s AS (SELECT stream_id, frame, CASE WHEN (x + y) % 2 = 0 THEN v + v % 41 - 150 ELSE v END AS s FROM fr)
SELECT stream_id, frame, min(s) < 0 OR max(s) > 255 AS error, CAST(sum(s) AS BIGINT) AS total FROM s GROUP BY ALL"""


def chain_segments(spark, sf_dir):
    groups = frames(spark, sf_dir).select("stream_id", "frame", "vec_id").distinct().withColumn("chained", F.col("vec_id") % 4 != 0)
    return chain.segments(groups).groupBy("stream_id", "segment").agg(F.min("frame").alias("first"), F.count("*").alias("frames"))


CHAIN_SEGMENTS = """WITH g AS (SELECT label AS stream_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
s AS (SELECT *, (SELECT count(*) FROM g b WHERE b.stream_id = a.stream_id AND b.frame <= a.frame AND b.vec_id % 4 = 0) AS segment FROM g a)
SELECT stream_id, segment, min(frame) AS first, count(*) AS frames FROM s GROUP BY ALL"""

_ALL = {
    "o3_1_paint_moving_rect": (moving_rect, MOVING_RECT),
    "o3_2_fill_paint": (fills, FILLS),
    "o3_3_raster_blit": (rasters, RASTERS),
    "o3_4_index_paint": (indexed, INDEXED),
    "o3_5_generator_paint": (generated, GENERATED),
    "o3_6_affine_sample": (affine, AFFINE),
    "o3_8_overlay_paint": (overlay, OVERLAY),
    "o3_9_global_predict": (warped, WARPED),
    "o3_12_chain_segments": (chain_segments, CHAIN_SEGMENTS),
    "o3_15_copy_prev_frame": (scrolled, SCROLLED),
    "o3_16_residual_overlay": (residual, RESIDUAL),
    "o3_17_transform_residual": (additive, ADDITIVE),
    "o4_7_noise_field": (noise, NOISE),
    "o13_1_view_rect_crop": (crop, CROP),
    "o13_1_tile_partition": (tiles, TILES),
    "o13_5_view_stats": (work, WORK),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
