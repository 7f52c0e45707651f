"""Queries of the inverse encoder, over made-up movies of known structure and over frames of the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, lossy
from ..sources import decode, encode, view
from ..sources import frames as raw
from .adapters import FRAMES, frames, read, spread

FRAMES_EACH = 6
#: Movies that are handed on at once.
MOVIES = 64
#: What each kind of movie is, and the families that must win its frames after the first.
KINDS = (
    ("static", ("unchanged",) * 5),
    ("blink", ("sparse", "clear_overlay", "sparse", "clear_overlay", "sparse")),
    ("wrap scroll", ("copy_rect",) * 5),
    ("fade to one value", ("sparse", "fill", "unchanged", "unchanged", "unchanged")),
    ("two screens", ("raw", "exact_ref", "exact_ref", "exact_ref", "exact_ref")),
    ("ramp", ("generator",) * 5),
    ("panel", ("regions",) * 5),
    ("pan", ("translation",) * 5),
    ("held scroll", ("copy_rect", "prev_diff", "copy_rect", "prev_diff", "copy_rect")),
    ("brightness", ("transform_residual",) * 5),
    ("ramp with points", ("generator_residual",) * 5),
    ("screen scroll", ("copy_residual",) * 5),
    ("box comes and goes", ("regions", "clear_instances", "regions", "clear_instances", "regions")),
    ("sparkle", ("rans_residual",) * 5),
)


def texture(seed: int, width: int = 32, height: int = 24, top: int = 251) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return (((x * 37 + y * 91 + x * y * 7 + seed * 13) * (x + 3 * y + 5)) % top).astype(np.uint8)


def movie(kind: int, s: int) -> list[np.ndarray]:
    """Frames of one kind; s varies the samples, not the structure."""
    t = texture(s)
    y, x = np.mgrid[0:24, 0:32]
    ramp = lambda f: ((10 + f * 40 + 3 * x + 5 * y) % 256).astype(np.uint8)

    def dotted(a: np.ndarray, v: int, *points: tuple[int, int]) -> np.ndarray:
        a = a.copy()
        for px, py in points:
            a[py, px] = v
        return a

    def boxed(a: np.ndarray, v: int) -> np.ndarray:
        a = a.copy()
        a[8:16, 8:16] = v
        return a

    def shifted(f: int) -> np.ndarray:
        a = np.zeros_like(t)
        a[f:, 2 * f :] = t[: 24 - f, : 32 - 2 * f]
        return a

    dots = (2, 1), (5, 3), (9, 9)
    if kind == 0:
        return [t] * FRAMES_EACH
    if kind == 1:
        return [dotted(t, 255, *dots) if f % 2 else t for f in range(FRAMES_EACH)]
    if kind == 2:
        return [np.roll(t, 3 * f, 1) for f in range(FRAMES_EACH)]
    if kind == 3:
        return [t, dotted(t, 255, *dots)] + [np.full_like(t, 7 * s % 250 + 1)] * (FRAMES_EACH - 2)
    if kind == 4:
        return [texture(s + f % 2, 72) for f in range(FRAMES_EACH)]
    if kind == 5:
        return [ramp(f) for f in range(FRAMES_EACH)]
    if kind == 6:
        return [t] + [boxed(t, (f * 50 + s) % 251) for f in range(1, FRAMES_EACH)]
    if kind == 7:
        return [shifted(f) for f in range(FRAMES_EACH)]
    if kind == 8:
        return [np.roll(t, 3 * ((f + 1) // 2), 1) for f in range(FRAMES_EACH)]
    if kind == 9:
        return [texture(s, 64, 48, 200) + np.uint8(5 * f) for f in range(FRAMES_EACH)]
    if kind == 10:
        return [dotted(ramp(f), 77, *dots, (20, 11), (30, 20)) for f in range(FRAMES_EACH)]
    if kind == 11:
        tall = np.concatenate([t, *(texture(s + 1 + i)[:2] for i in range(FRAMES_EACH))])
        return [tall[2 * f : 2 * f + 24] for f in range(FRAMES_EACH)]
    if kind == 12:
        return [boxed(np.zeros_like(t), 9 + f) if f % 2 else np.zeros_like(t) for f in range(FRAMES_EACH)]
    big = texture(s, 64, 48, 200)
    y, x = np.mgrid[0:48, 0:64]
    return [big] + [np.where((7 * x + 11 * y + f) % 10 == 0, np.uint8(255), big) for f in range(1, FRAMES_EACH)]


def movies(spark, sf_dir):
    """Packed frames of a movie for each supplier; its kind is the key modulo the number of kinds."""

    def run(batches):
        for pdf in batches:
            keys = pdf["s_suppkey"].tolist()
            for lo in range(0, len(keys), MOVIES):
                rows = [(s, f, a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes()) for s in keys[lo : lo + MOVIES] for f, a in enumerate(movie(s % len(KINDS), s))]
                yield pd.DataFrame(rows, columns=["stream_id", "frame", "w", "h", "samples"])

    return spread(read(spark, sf_dir, "supplier").select("s_suppkey")).mapInPandas(run, "stream_id long, frame long, w int, h int, samples binary")


def choice(spark, sf_dir):
    """The family that wins each frame of each movie; the container is decoded before it counts."""
    rows = encode.encoded(movies(spark, sf_dir)).select(F.col("path").cast("long").alias("stream_id"), F.explode("decisions").alias("d"))
    return rows.select("stream_id", "d.frame", "d.family")


_EXPECTED = ", ".join(f"({k}, {f}, '{name}')" for k, (_, names) in enumerate(KINDS) for f, name in enumerate(names, 1))
CHOICE = f"WITH e(kind, frame, family) AS (VALUES {_EXPECTED}) SELECT s_suppkey AS stream_id, CAST(frame AS BIGINT) AS frame, family FROM supplier JOIN e ON kind = s_suppkey % {len(KINDS)}"


def decoded(spark, sf_dir):
    """Checksums of the frames that the containers decode to."""
    files = encode.encoded(movies(spark, sf_dir)).select("path", "content")
    got = decode.frames(files).filter("w = 32")
    dense = raw.dense(got.select("path", "frame", "samples"), 32)
    rows = dense.groupBy("path", "frame").agg(F.sum(F.col("v") * (F.col("y") * 32 + F.col("x") + 1)).cast("long").alias("weighted"))
    return rows.filter(F.col("path").cast("long") % len(KINDS) < 4).select(F.col("path").cast("long").alias("stream_id"), "frame", "weighted")


_T = "((x * 37 + y * 91 + x * y * 7 + s * 13) * (x + 3 * y + 5)) % 251"
_TX = _T.replace("x", "((x - 3 * f + 96) % 32)")
_DOT = "(x, y) IN ((2, 1), (5, 3), (9, 9))"
DECODED = f"""WITH g AS (SELECT s_suppkey AS s, s_suppkey % {len(KINDS)} AS k, f, x, y FROM supplier, range(0, {FRAMES_EACH}) a(f), range(0, 32) b(x), range(0, 24) c(y) WHERE s_suppkey % {len(KINDS)} < 4)
SELECT s AS stream_id, f AS frame, CAST(sum((y * 32 + x + 1) * CASE WHEN k = 2 THEN {_TX} WHEN k = 3 AND f > 1 THEN 7 * s % 250 + 1 WHEN {_DOT} AND (k = 1 AND f % 2 = 1 OR k = 3 AND f = 1) THEN 255 ELSE {_T} END) AS BIGINT) AS weighted FROM g GROUP BY ALL"""


def background(spark, sf_dir):
    """The background with which a whole stream is smallest; the first of equals. Listed where the structure decides it."""
    kind = F.col("path").cast("long") % len(KINDS)
    return encode.encoded(movies(spark, sf_dir)).filter(kind.isin(3, 7, 12)).select(F.col("path").cast("long").alias("stream_id"), "background")


BACKGROUND = f"SELECT s_suppkey AS stream_id, CAST(CASE WHEN s_suppkey % {len(KINDS)} = 3 THEN 7 * s_suppkey % 250 + 1 ELSE 0 END AS INTEGER) AS background FROM supplier WHERE s_suppkey % {len(KINDS)} IN (3, 7, 12)"


def raster_only(spark, sf_dir):
    """Bytes of containers that may only use whole rasters: a declaration for each distinct frame, a reset for each later one."""
    only = encode.encoded(movies(spark, sf_dir), ("raw", "exact_ref"))
    return only.select(F.col("path").cast("long").alias("stream_id"), F.octet_length("content").cast("long").alias("bytes")).filter(F.col("stream_id") % len(KINDS) < 3)


_EMPTY = 6 + 19 + 6 + 16 + 32  # header, checkpoint of one instance, digest
RASTER_ONLY = f"""SELECT s_suppkey AS stream_id, CAST({_EMPTY} + 32 * {FRAMES_EACH - 1} + (13 + 768) * CASE s_suppkey % {len(KINDS)} WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE {FRAMES_EACH} END AS BIGINT) AS bytes
FROM supplier WHERE s_suppkey % {len(KINDS)} < 3"""


def lossy_encode(spark, sf_dir):
    """Frames quantised to multiples of eight, encoded with the mark of quantised content, and decoded: checksums by frame."""
    own = lossy.box3(frames(spark, sf_dir)).withColumn("q", scalar.quantize(F.col("v"), 3))
    packed = own.groupBy("stream_id", "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "q"))).alias("s"))
    hexed = F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["q"]), 2, "0")), "")
    packed = packed.select(F.col("stream_id").cast("long").alias("stream_id"), "frame", F.lit(8).alias("w"), F.lit(8).alias("h"), F.unhex(hexed).alias("samples"))
    files = encode.encoded(packed, features=2)
    got = decode.frames(files.select("path", "content")).filter("error IS NULL")
    return raw.dense(got.select("path", "frame", "samples"), 8).groupBy(F.col("path").cast("long").alias("stream_id"), "frame").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


LOSSY_ENCODE = f"""WITH {FRAMES}, b AS (SELECT stream_id, frame, y, x, (coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v) + 2) // 4 AS v FROM fr WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))
SELECT CAST(stream_id AS BIGINT) AS stream_id, frame, CAST(sum(least(255, (v + 4) // 8 * 8) * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM b GROUP BY ALL"""

#: The box of a view, and its frame.
BOX, AT = (8, 4, 20, 14), 5


def views(spark, sf_dir):
    """A box of the last frame of four kinds of movies, one of them through five copies: checksum and work. Going back, the box of
    the scroll moves by three a frame and wraps around the edge for the last three."""
    files = encode.encoded(movies(spark, sf_dir).filter(F.col("stream_id") % len(KINDS) < 4)).select("path", "content")
    got = view.viewed(files, AT, BOX)
    dense = raw.dense(got.select("path", "samples"), BOX[2] - BOX[0])
    sums = dense.groupBy("path").agg(F.sum(F.col("v") * (F.col("y") * 12 + F.col("x") + 1)).cast("long").alias("weighted"))
    return got.join(sums, "path").select(F.col("path").cast("long").alias("stream_id"), "w", "h", "weighted", "replayed", "levels", "base", "copied", "objects", "peak", "spans")


_V = _T.replace("x", "(x + 8)").replace("y", "(y + 4)")
_VX = _TX.replace("x - 3", "x + 8 - 3").replace("y", "(y + 4)")
_VDOT = "(x + 8, y + 4) IN ((2, 1), (5, 3), (9, 9))"
VIEWS = f"""WITH g AS (SELECT s_suppkey AS s, s_suppkey % {len(KINDS)} AS k, 5 AS f, x, y FROM supplier, range(0, 12) b(x), range(0, 10) c(y) WHERE s_suppkey % {len(KINDS)} < 4)
SELECT s AS stream_id, CAST(12 AS INTEGER) AS w, CAST(10 AS INTEGER) AS h, CAST(sum((y * 12 + x + 1) * CASE WHEN k = 2 THEN {_VX} WHEN k = 3 THEN 7 * s % 250 + 1 WHEN {_VDOT} AND k = 1 THEN 255 ELSE {_V} END) AS BIGINT) AS weighted,
CAST(6 AS BIGINT) AS replayed, CAST(any_value(CASE WHEN k = 2 THEN 6 ELSE 1 END) AS BIGINT) AS levels, CAST(any_value(CASE k WHEN 1 THEN 241 WHEN 3 THEN 120 ELSE 240 END) AS BIGINT) AS base,
CAST(any_value(CASE WHEN k = 2 THEN 5 * 120 ELSE 0 END) AS BIGINT) AS copied, CAST(any_value(CASE WHEN k = 3 THEN 0 ELSE 1 END) AS BIGINT) AS objects, CAST(any_value(CASE WHEN k = 2 THEN 320 ELSE 120 END) AS BIGINT) AS peak, CAST(any_value(CASE WHEN k = 2 THEN 3 * 10 + 3 * 20 ELSE 10 END) AS BIGINT) AS spans FROM g GROUP BY s"""

def toroidal(spark, sf_dir):
    """The wrap-around shift of every frame of every movie against the frame before, if there is one."""
    return compare.shifts(movies(spark, sf_dir)).filter("dx IS NOT NULL").join(_held(spark, sf_dir), ["stream_id", "frame"], "left_anti")


def _held(spark, sf_dir):
    """Frames equal to the one before, whose shifts say nothing."""
    return compare.pairs_of(movies(spark, sf_dir)).filter("before = samples").select("stream_id", "frame")


TOROIDAL = f"""SELECT s_suppkey AS stream_id, CAST(f AS BIGINT) AS frame, CAST(3 AS INTEGER) AS dx, CAST(0 AS INTEGER) AS dy FROM supplier, range(1, {FRAMES_EACH}) r(f)
WHERE s_suppkey % {len(KINDS)} = 2 OR s_suppkey % {len(KINDS)} = 8 AND f % 2 = 1"""


def search_box(spark, sf_dir):
    """Where the box (8, 8)..(16, 16) of every frame comes from, within 64 samples, in the scrolls and pans among the movies. In the
    static ones every source outside the picture is as good, so the first displacement wins."""
    moved = compare.boxes_moved(movies(spark, sf_dir).filter((F.col("stream_id") % len(KINDS)).isin(0, 2, 7, 11)), (8, 8, 16, 16))
    return moved.filter(F.col("bad") == 0)


SEARCH_BOX = f"""WITH m(k, dy, dx) AS (VALUES (0, -64, -64), (2, 0, -3), (7, -1, -2), (11, 2, 0))
SELECT s_suppkey AS stream_id, CAST(f AS BIGINT) AS frame, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, CAST(0 AS BIGINT) AS bad FROM supplier JOIN m ON k = s_suppkey % {len(KINDS)}, range(1, {FRAMES_EACH}) r(f)"""

def guided(spark, sf_dir):
    """Guided against full search of the movies whose structure stays: the bytes are the same and no more is proposed."""
    stays = movies(spark, sf_dir).filter((F.col("stream_id") % len(KINDS)).isin(*STEADY))
    total = lambda c: F.aggregate("decisions", F.lit(0).cast("long"), lambda acc, d: acc + d[c])
    rows = lambda g: encode.encoded(stays, guided=g).select("path", F.octet_length("content").alias("bytes"), total("proposals").alias("n"))
    both = rows(True).join(rows(False).select("path", F.col("bytes").alias("all_bytes"), F.col("n").alias("all_n")), "path")
    return both.select(F.col("path").cast("long").alias("stream_id"), (F.col("bytes") == F.col("all_bytes")).alias("same_bytes"), (F.col("n") <= F.col("all_n")).alias("no_more"))


#: Kinds with one winner throughout.
STEADY = tuple(k for k, (_, names) in enumerate(KINDS) if len(set(names)) == 1)
GUIDED = f"SELECT s_suppkey AS stream_id, true AS same_bytes, true AS no_more FROM supplier WHERE s_suppkey % {len(KINDS)} IN {STEADY}"

_ALL = {
    "o9_8_guided_encode": (guided, GUIDED),
    "o7_9_toroidal_shift": (toroidal, TOROIDAL),
    "o7_15_search_box": (search_box, SEARCH_BOX),
    "o13_4_view_through_copies": (views, VIEWS),
    "o8_encoder_choice": (choice, CHOICE),
    "o15_9_movies_decoded": (decoded, DECODED),
    "o8_12_swept_backgrounds": (background, BACKGROUND),
    "o8_13_raster_only": (raster_only, RASTER_ONLY),
    "o14_3_lossy_encode": (lossy_encode, LOSSY_ENCODE),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
