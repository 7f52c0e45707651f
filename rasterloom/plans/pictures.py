"""Queries of pixel formats, pictures and global motion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import media, motion, pixels
from ..sources import planes
from .adapters import read, spread
from .archives import sha

WIDTH, HEIGHT = 8, 6


def _pictures(spark, sf_dir):
    """A picture of each format in turn for each supplier; sample i of the payload is (37 i + 11 s) modulo the range. Every 50th
    payload is a byte short."""

    def run(batches):
        for pdf in batches:
            rows = []
            for s in pdf["s_suppkey"]:
                name = pixels.FORMATS[s % len(pixels.FORMATS)]
                form = pixels.shape(name, WIDTH, HEIGHT)
                v = (np.arange(form.samples) * 37 + s * 11) % (1 << form.depth) << form.shift
                data = v.astype("u1" if form.depth <= 8 else "<u2").tobytes()
                rows.append((s, name, WIDTH, HEIGHT, data[: -1 if s % 50 == 0 else None]))
            yield pd.DataFrame(rows, columns=["id", "format", "width", "height", "payload"])

    return read(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "id long, format string, width int, height int, payload binary")


def unpack(spark, sf_dir):
    """Weighted sums of the canonical planes of all formats."""
    planes = pixels.canonical(_pictures(spark, sf_dir))
    wide = F.col("depth") > 8
    rows = planes.withColumn("p", F.explode_outer(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)))
    low = F.conv(F.hex(F.expr("substring(samples, IF(depth > 8, 2 * p, p) + 1, 1)")), 16, 10).cast("long")
    high = F.conv(F.hex(F.expr("substring(samples, 2 * p + 2, 1)")), 16, 10).cast("long")
    rows = rows.withColumn("v", low + F.when(wide, 256 * high).otherwise(0))
    return rows.groupBy("id", "plane", "w", "h", "error").agg(F.sum(F.col("v") * (F.col("p") + 1)).alias("weighted"))


def _spots() -> str:
    """(format, its number, plane, width, height, first, row, step, depth) of an 8 x 6 picture, said once more for SQL."""
    out, w, h = [], WIDTH, HEIGHT
    for n, f in enumerate(pixels.FORMATS):
        bits = int(f[-4:-2]) if f[-4:-2].isdigit() and f.endswith("le") else 8
        bits = {"gray16le": 16, "p010le": 10, "p016le": 16}.get(f, bits)
        if f.startswith(("nv", "p01")):
            u, v = (1, 0) if f == "nv21" else (0, 1)
            rows = [(0, w, h, 0, w, 1), (1, 4, 3, 48 + u, 8, 2), (2, 4, 3, 48 + v, 8, 2)]
        elif f.endswith("422") and f[0] in "yu":
            y = 0 if f.startswith("yuyv") else 1
            rows = [(0, w, h, y, 16, 2), (1, 4, h, 1 - y, 16, 4), (2, 4, h, 3 - y, 16, 4)]
        elif f.startswith("gray"):
            rows = [(0, w, h, 0, w, 1)]
        elif f.startswith("gbr"):
            rows = [(0, w, h, 96, w, 1), (1, w, h, 0, w, 1), (2, w, h, 48, w, 1)] + [(3, w, h, 144, w, 1)] * f.startswith("gbra")
        elif f.startswith("yuv"):
            cw, ch = (4 if "42" in f else 8), (3 if "420" in f else 6)
            rows = [(0, w, h, 0, w, 1), (1, cw, ch, 48, cw, 1), (2, cw, ch, 48 + cw * ch, cw, 1)] + [(3, w, h, 48 + 2 * cw * ch, w, 1)] * f.startswith("yuva")
        else:
            letters = f[:3] if f.endswith("24") else f
            rows = [(k, w, h, letters.index(x), w * len(letters), len(letters)) for k, x in enumerate(x for x in "rgba" if x in letters)]
        out += [f"({n}, {', '.join(map(str, r))}, {bits})" for r in rows]
    return ", ".join(out)


UNPACK = f"""WITH f(n, plane, w, h, first, line, step, bits) AS (VALUES {_spots()})
SELECT s_suppkey AS id, CAST(plane AS INTEGER) AS plane, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(NULL AS VARCHAR) AS error,
CAST(sum((y * w + x + 1) * (((first + y * line + x * step) * 37 + s_suppkey * 11) % (1 << bits))) AS BIGINT) AS weighted
FROM supplier JOIN f ON n = s_suppkey % {len(pixels.FORMATS)}, range(0, 8) a(x), range(0, 6) b(y) WHERE x < w AND y < h AND s_suppkey % 50 <> 0 GROUP BY ALL
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, 'payload length', NULL FROM supplier WHERE s_suppkey % 50 = 0"""


def repack(spark, sf_dir):
    """Digests of the payloads that the canonical planes give again."""
    own = _pictures(spark, sf_dir)
    planes = pixels.canonical(own).filter("error IS NULL").join(own.select("id", "format", "width", "height"), "id")
    again = pixels.payloads(planes)
    return again.select("id", F.octet_length("payload").cast("long").alias("bytes"), F.substring(F.hex("payload"), 1, 32).alias("head"))


def _lengths() -> str:
    return ", ".join(f"({n}, {s.samples}, {s.depth}, {s.shift}, {int(f in pixels.PACKED and '0' in pixels.PACKED[f])}, {pixels.PACKED.get(f, '').find('0')})" for n, f in enumerate(pixels.FORMATS) for s in [pixels.shape(f, WIDTH, HEIGHT)])


REPACK = f"""WITH f(n, samples, bits, up, padded, pad) AS (VALUES {_lengths()}),
v AS (SELECT s_suppkey AS id, samples, bits, i, CASE WHEN padded = 1 AND i % 4 = pad THEN 0 ELSE ((i * 37 + s_suppkey * 11) % (1 << bits)) << up END AS v FROM supplier JOIN f ON n = s_suppkey % {len(pixels.FORMATS)}, range(0, 16) r(i) WHERE s_suppkey % 50 <> 0)
SELECT id, CAST(any_value(samples * CASE WHEN bits > 8 THEN 2 ELSE 1 END) AS BIGINT) AS bytes,
substring(string_agg(CASE WHEN bits > 8 THEN printf('%02X%02X', CAST(v % 256 AS INTEGER), CAST(v // 256 AS INTEGER)) ELSE printf('%02X', CAST(v AS INTEGER)) END, '' ORDER BY i), 1, 32) AS head FROM v GROUP BY id"""


def _pair(s: int) -> tuple[np.ndarray, np.ndarray]:
    """A smooth picture and the same one moved by (s % 9 - 4, s % 7 - 3), both cut from one field."""
    y, x = np.mgrid[0:56, 0:72].astype(float)
    field = 128 + 50 * np.sin(x / 5 + s) + 40 * np.cos(y / 4 - s / 3) + 20 * np.sin((x + 2 * y) / 7)
    field = np.floor(field).clip(0, 255).astype(np.uint8)
    dx, dy = s % 9 - 4, s % 7 - 3
    return field[4:52, 4:68], field[4 + dy : 52 + dy, 4 + dx : 68 + dx]


def _pairs(spark, sf_dir, make):
    def run(batches):
        for pdf in batches:
            pairs = [make(int(s)) for s in pdf["s_suppkey"]]
            yield pd.DataFrame({"stream_id": pdf["s_suppkey"], "w": [a.shape[1] for a, _ in pairs], "h": [a.shape[0] for a, _ in pairs], "before": [np.ascontiguousarray(a).tobytes() for a, _ in pairs], "after": [np.ascontiguousarray(b).tobytes() for _, b in pairs]})

    return spread(read(spark, sf_dir, "supplier").select("s_suppkey")).mapInPandas(run, "stream_id long, w int, h int, before binary, after binary")


def translation(spark, sf_dir):
    """The whole-picture displacement of each pair, by a pyramid, and the classes of motion that are then proposed."""
    return motion.estimated(_pairs(spark, sf_dir, _pair)).select("stream_id", "dx", "dy", "share", F.concat_ws(",", "classes").alias("classes"))


TRANSLATION = "SELECT s_suppkey AS stream_id, CAST(s_suppkey % 9 - 4 AS INTEGER) AS dx, CAST(s_suppkey % 7 - 3 AS INTEGER) AS dy, CAST(1.0 AS DOUBLE) AS share, 'translation' AS classes FROM supplier"


def _turned(s: int) -> tuple[np.ndarray, np.ndarray]:
    """A smooth picture, and the same field through a map that turns and scales it a little, or not at all."""
    field = lambda x, y: (np.floor(128 + 50 * np.sin(x / 9 + s) + 40 * np.cos(y / 8 - s / 3) + 20 * np.sin((x + 2 * y) / 11)) // 32 * 32).clip(0, 255).astype(np.uint8)
    y, x = np.mgrid[0:64, 0:80]
    a, b = 65536 + 2500 * (s % 5 - 2), 2000 * (s % 3 - 1)
    return field(x, y), field((a * x - b * y) >> 16, (b * x + a * y) >> 16)


def refined(spark, sf_dir):
    """Pairs related by a strong scale, or by nothing: whether a refined map is the cheapest, and misses at most four fifths of what
    the best displacement misses (all of them where a map can't help)."""
    rows = motion.estimated(_pairs(spark, sf_dir, _turned))
    k = F.col("stream_id")
    rows = rows.filter((k % 5).isin(0, 4) | ((k % 5 == 2) & (k % 3 == 1)))
    return rows.select("stream_id", (F.col("class") != "translation").alias("warped"), (5 * F.col("best_error") <= 4 * F.col("translation_error")).alias("explained"))


REFINED = "SELECT s_suppkey AS stream_id, s_suppkey % 5 <> 2 AS warped, true AS explained FROM supplier WHERE s_suppkey % 5 IN (0, 4) OR s_suppkey % 5 = 2 AND s_suppkey % 3 = 1"

def planes_replayed(spark, sf_dir):
    """Ten-bit 4:2:0 programs of three planes, written and parsed: a box that moves from the start, a ramp with a copy, a raster under
    a global map; checksums of the planes at time 3. Every twentieth file has a changed byte."""

    def run(batches):
        for pdf in batches:
            made = []
            for s in pdf["s_suppkey"].tolist():
                luma = planes.Plane(64, [(1, 4, 3, planes.FILL, [500 + s % 100], b"")], [(1, 1, s % 5, 1)], [(15, 11, 1000)], [(t, [(0x2A, [], b"")]) for t in (1, 2, 3)], motion=[(1, 1, [2, 1])])
                ramp = planes.Plane(0, [(1, 8, 6, planes.GENERATOR, [0, 10 + s % 7, 3, 5], b"")], [(1, 1, 0, 0)], groups=[(2, [(0x27, [0, 0, 4, 4, 2, 1], b"")])])
                flat = np.array([[(x * 31 + y * 77 + s) % 1024 for x in range(8)] for y in range(6)], "<u2").tobytes()
                warp = planes.Plane(7, [(1, 8, 6, planes.RASTER, [], flat)], [(1, 1, 0, 0)], groups=[(1, [(planes.PREDICT, [1, 4096, 0, -4096, 0, 4096, 0], b"")])])
                data = planes.write(planes.Media(16, 12, "yuv420", (10, 10, 10)), [luma, ramp, warp], sha)
                made.append(data if s % 20 else data[:60] + bytes([data[60] ^ 1]) + data[61:])
            yield pd.DataFrame({"path": pdf["s_suppkey"].astype(str), "content": made})

    files = read(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "path string, content binary")
    got = planes.observations(files, 3, sha).select("path", "plane", "depth", F.posexplode("samples").alias("p", "v"))
    return got.groupBy(F.col("path").cast("long").alias("s_suppkey"), "plane", "depth").agg(F.count("*").alias("n"), F.sum(F.col("v") * (F.col("p") + 1)).cast("long").alias("weighted"))


PLANES_REPLAYED = """WITH s AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 20 <> 0),
v AS (SELECT s, 0 AS plane, y * 16 + x AS p, CASE WHEN x = 15 AND y = 11 THEN 1000 WHEN x - s % 5 - 6 BETWEEN 0 AND 3 AND y - 4 BETWEEN 0 AND 2 THEN 500 + s % 100 ELSE 64 END AS v FROM s, range(0, 16) a(x), range(0, 12) b(y)
UNION ALL SELECT s, 1, y * 8 + x, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 4 THEN 10 + s % 7 + 3 * (x - 2) + 5 * (y - 1) ELSE 10 + s % 7 + 3 * x + 5 * y END FROM s, range(0, 8) a(x), range(0, 6) b(y)
UNION ALL SELECT s, 2, y * 8 + x, (greatest(x - 1, 0) * 31 + y * 77 + s) % 1024 FROM s, range(0, 8) a(x), range(0, 6) b(y))
SELECT s AS s_suppkey, CAST(plane AS INTEGER) AS plane, CAST(10 AS INTEGER) AS depth, count(*) AS n, CAST(sum(v * (p + 1)) AS BIGINT) AS weighted FROM v GROUP BY ALL"""

def observations_checked(spark, sf_dir):
    """Observations of orders against four epochs, some with a wrong plane, depth, length or epoch."""
    k = F.col("o_orderkey")
    plane = lambda a, b: F.struct(F.lit(a).alias("sub_w"), F.lit(b).alias("sub_h"))
    kinds = {0: ("yuv420", F.array(plane(0, 0), plane(1, 1), plane(1, 1)), F.array(F.lit(8))), 1: ("yuv422", F.array(plane(0, 0), plane(1, 0), plane(1, 0)), F.array(F.lit(10), F.lit(8), F.lit(8))), 2: ("gray", F.array(plane(0, 0)), F.array(F.lit(12))), 3: ("yuv444", F.array(*[plane(0, 0)] * 3), F.array(F.lit(8), F.lit(8)))}
    epochs = None
    for i, (layout, known, depths) in kinds.items():
        one = spark.range(1).select(F.lit(i).cast("long").alias("epoch_id"), F.lit(17).alias("width"), F.lit(11).alias("height"), F.lit(layout).alias("layout"), known.alias("known"), depths.alias("depths"))
        epochs = one if epochs is None else epochs.unionByName(one)
    own = lambda w, h, d: F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(d).alias("depth"), (w * h * (2 if d > 8 else 1) - F.when(k % 11 == 0, 1).otherwise(0)).alias("bytes"))
    luma = F.struct((17 + F.when(k % 7 == 0, 1).otherwise(0)).alias("w"), F.lit(11).alias("h"), F.when(k % 5 == 1, 10).when(k % 5 == 2, 12).otherwise(8).alias("depth"), F.lit(0).alias("bytes"))
    luma = F.struct(luma["w"].alias("w"), luma["h"].alias("h"), luma["depth"].alias("depth"), (luma["w"] * 11 * F.when(luma["depth"] > 8, 2).otherwise(1)).alias("bytes"))
    planes_ = F.when(k % 5 == 0, F.array(luma, own(9, 6, 8), own(9, 6, 8))).when(k % 5 == 1, F.array(luma, own(9, 11, 8), own(9, 11, 8))).when(k % 5 == 2, F.array(luma)).otherwise(F.array(luma, own(17, 11, 8), own(17, 11, 8)))
    observed = read(spark, sf_dir, "orders").select(k.alias("obs"), (k % 5).alias("epoch_id"), F.when(k % 13 == 0, F.slice(planes_, 1, 1)).otherwise(planes_).alias("planes"))
    return media.observation_errors(observed, epochs)


OBSERVATIONS_CHECKED = """SELECT o_orderkey AS obs, CASE WHEN e = 4 THEN 'unknown epoch' WHEN e = 3 THEN 'depths' WHEN o_orderkey % 13 = 0 AND e <> 2 THEN 'plane count' WHEN o_orderkey % 7 = 0 THEN 'geometry'
WHEN o_orderkey % 11 = 0 AND e <> 2 THEN 'payload length' END AS error FROM (SELECT o_orderkey, o_orderkey % 5 AS e FROM orders)"""

_ALL = {
    "o15_4_observation_checks": (observations_checked, OBSERVATIONS_CHECKED),
    "o1_10_planes_replayed": (planes_replayed, PLANES_REPLAYED),
    "o1_16_unpack_all_formats": (unpack, UNPACK),
    "o1_17_repack_all_formats": (repack, REPACK),
    "o7_14_estimate_global": (translation, TRANSLATION),
    "o7_13_refined_maps": (refined, REFINED),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
