"""Comparing and fitting frames: differences, constant regions, programs, motion runs, displacements."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["stream_id", "frame"]


def with_previous(frames: DataFrame) -> DataFrame:
    """Adds prev, the sample of the frame before at the same place (null for the first frame)."""
    return frames.withColumn("prev", F.lag("v").over(Window.partitionBy("stream_id", "y", "x").orderBy("frame")))


def diff_points(frames: DataFrame, background: int = 0) -> DataFrame:
    """Changed samples of each frame, numbered by x, then y."""
    changed = with_previous(frames).filter(F.col("v") != F.coalesce("prev", F.lit(background)))
    return changed.withColumn("ord", (F.row_number().over(Window.partitionBy(*FRAME).orderBy("x", "y")) - 1).cast("long")).drop("prev")


def uniform(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all samples of a group are one value, and which."""
    return frames.groupBy(*keys).agg((F.min("v") == F.max("v")).alias("uniform"), F.when(F.min("v") == F.max("v"), F.min("v")).alias("value"))


def fit_gradient(fields: DataFrame, keys: list[str], signed: bool = False) -> DataFrame:
    """base, sx, sy of fields (keys, x, y, v) that are exactly a wrapping ramp; every sample is proved, none is guessed."""
    at = lambda x, y: F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col("v")))
    # a field is one group of bounded size: its samples are proved where they are gathered, and nothing exploded is joined
    whole = fields.groupBy(*keys).agg(at(0, 0).alias("base"), F.pmod(at(1, 0) - at(0, 0), F.lit(256)).alias("sx"), F.pmod(at(0, 1) - at(0, 0), F.lit(256)).alias("sy"), F.collect_list(F.struct("x", "y", "v")).alias("samples"))
    good = F.forall("samples", lambda s: F.coalesce(s["v"] == F.pmod(F.col("base") + F.col("sx") * s["x"] + F.col("sy") * s["y"], F.lit(256)), F.lit(True)))
    proved = whole.filter(F.col("base").isNotNull() & F.col("sx").isNotNull() & F.col("sy").isNotNull() & good).drop("samples")
    if signed:
        for c in ("sx", "sy"):
            proved = proved.withColumn(c, F.when(F.col(c) > 128, F.col(c) - 256).otherwise(F.col(c)))
    return proved


def fit_checker(fields: DataFrame, keys: list[str], cells: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """a, b and the smallest cell of fields that are exactly a checkerboard."""
    tries = fields.withColumn("cell", F.explode(F.array(*map(F.lit, cells))))
    odd = F.expr("(x div cell + y div cell) % 2 = 1")
    found = tries.groupBy(*keys, "cell").agg(F.min(F.when(~odd, F.col("v"))).alias("a"), F.max(F.when(~odd, F.col("v"))).alias("a2"), F.min(F.when(odd, F.col("v"))).alias("b"), F.max(F.when(odd, F.col("v"))).alias("b2"))
    return found.filter("a = a2 AND b = b2 AND a <> b").groupBy(*keys).agg(F.min(F.struct("cell", "a", "b")).alias("f")).select(*keys, "f.cell", "f.a", "f.b")


def linear_runs(points: DataFrame, least: int = 3) -> DataFrame:
    """Maximal runs of equal steps of points (stream_id, t, x, y): first, last, dx, dy and length in steps."""
    order = Window.partitionBy("stream_id").orderBy("t")
    steps = points.withColumns({"dx": F.col("x") - F.lag("x").over(order), "dy": F.col("y") - F.lag("y").over(order), "i": F.row_number().over(order)}).filter("dx IS NOT NULL")
    same = Window.partitionBy("stream_id", "dx", "dy").orderBy("t")
    islands = steps.withColumn("island", F.col("i") - F.row_number().over(same))
    return islands.groupBy("stream_id", "dx", "dy", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("steps")).filter(F.col("steps") >= least).drop("island")


def accelerations(points: DataFrame, least: int = 3) -> DataFrame:
    """Maximal runs of equal second differences that are not zero."""
    order = Window.partitionBy("stream_id").orderBy("t")
    out = points.withColumns({"dx": F.col("x") - F.lag("x").over(order), "dy": F.col("y") - F.lag("y").over(order)})
    out = out.withColumns({"ax": F.col("dx") - F.lag("dx").over(order), "ay": F.col("dy") - F.lag("dy").over(order), "i": F.row_number().over(order)}).filter("ax IS NOT NULL")
    islands = out.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("stream_id", "ax", "ay").orderBy("t")))
    runs = islands.groupBy("stream_id", "ax", "ay", "island").agg(F.min("t").alias("first"), F.count("*").alias("steps"))
    return runs.filter((F.col("steps") >= least) & ((F.col("ax") != 0) | (F.col("ay") != 0))).drop("island")


def index_map(frames: DataFrame, most: int = 16) -> DataFrame:
    """Palettes of frames with at most `most` values (sorted), and the samples as places in them."""
    values = frames.groupBy(*FRAME).agg(F.array_sort(F.collect_set("v")).alias("palette")).filter(F.size("palette") <= most)
    return frames.join(values, FRAME).withColumn("idx", (F.array_position("palette", F.col("v")) - 1).cast("int"))


def displaced(frames: DataFrame, reach: int) -> DataFrame:
    """Mismatches of each frame with the frame before moved by (dx, dy), over the overlapping part, for all moves within reach.

    A frame is one row (a canvas is of bounded size), joined once with the frame before; samples are not multiplied by moves.
    """
    packed = frames.filter("v IS NOT NULL").groupBy(*FRAME).agg(F.collect_list(F.struct("y", "x", "v")).alias("s"))
    packed = packed.select(*FRAME, *(F.col(f"s.{c}").cast("array<int>").alias(c) for c in ("y", "x", "v")))
    before = packed.select("stream_id", (F.col("frame") + 1).alias("frame"), *(F.col(c).alias(f"p{c}") for c in ("y", "x", "v")))
    kind = {c: frames.schema[c].dataType.simpleString() for c in FRAME}

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            lo = 0
            while lo < batch.num_rows:  # slices of some CELLS samples
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), CELLS, "right")) + lo)
                yield from moved(batch.slice(lo, hi - lo), reach)
                lo = hi

    return packed.join(before.hint("merge"), FRAME).repartition(*FRAME).mapInArrow(run, f"stream_id {kind['stream_id']}, frame {kind['frame']}, dy int, dx int, sad long, n long, mismatches long")


#: Samples of the frames that are compared at once.
CELLS = 1 << 20


def moved(batch: pa.RecordBatch, reach: int):
    """What displaced returns, of rows with two frames each (y, x, v and py, px, pv)."""
    flat = {c: batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("y", "x", "v", "py", "px", "pv")}
    row = {p: np.repeat(np.arange(batch.num_rows), np.diff(batch.column(f"{p}v").offsets.to_numpy())) for p in ("", "p")}
    if not len(flat["v"]):
        return
    y0, x0 = min(flat["y"].min(), flat["py"].min()), min(flat["x"].min(), flat["px"].min())
    h, w = (int(max(flat[c].max(), flat[f"p{c}"].max()) - z) + 1 for c, z in (("y", y0), ("x", x0)))
    dense = {}
    for p in ("", "p"):
        v, there = np.zeros((batch.num_rows, h + 2 * reach, w + 2 * reach), np.int64), np.zeros((batch.num_rows, h + 2 * reach, w + 2 * reach), bool)
        at = row[p], flat[f"{p}y"] - y0 + reach, flat[f"{p}x"] - x0 + reach
        v[at], there[at] = flat[f"{p}v"], True
        dense[p] = v, there
    inner = (slice(None), slice(reach, reach + h), slice(reach, reach + w))
    now, here = (a[inner] for a in dense[""])
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            part = (slice(None), slice(reach - dy, reach - dy + h), slice(reach - dx, reach - dx + w))
            prev, there = (a[part] for a in dense["p"])
            both = here & there
            off = np.abs(now - prev) * both
            n = both.sum(axis=(1, 2))
            some = np.flatnonzero(n)
            made = [np.full(len(some), dy, np.int32), np.full(len(some), dx, np.int32), off.sum(axis=(1, 2))[some], n[some], (off != 0).sum(axis=(1, 2))[some]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in FRAME), *map(pa.array, made)], names=[*FRAME, "dy", "dx", "sad", "n", "mismatches"])


def best_displacement(frames: DataFrame, reach: int) -> DataFrame:
    """The move of least mean difference (compared as a fraction of whole numbers); of equals the first by dy, dx."""
    mean = (F.col("sad") * 1000000 / F.col("n")).cast("long")
    return displaced(frames, reach).groupBy(*FRAME).agg(F.min(F.struct(mean.alias("mean"), "dy", "dx", "sad")).alias("b")).select(*FRAME, "b.dy", "b.dx", "b.sad")


def backgrounds(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Candidate backgrounds of each stream: 0, 255, the corners of frame 0, and the most frequent sample (of equals the largest)."""
    corners = frames.filter(F.col("frame") == 0).filter(F.col("x").isin(0, width - 1) & F.col("y").isin(0, height - 1)).select("stream_id", "v")
    mode = frames.groupBy("stream_id", "v").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.max(F.struct("n", "v"))["v"].alias("v"))
    fixed = frames.select("stream_id").distinct().withColumn("v", F.explode(F.array(F.lit(0), F.lit(255))))
    return corners.unionByName(mode).unionByName(fixed).distinct()


def changed_boxes(frames: DataFrame, most: int = 4) -> DataFrame:
    """Bounding boxes of 4-connected changed areas, the largest first, at most `most` for each frame.

    A frame is one group of bounded size (a canvas); its labels spread inside the group, frames in parallel.
    """
    import numpy as np
    import pandas as pd

    def boxes(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = set(zip(pdf["y"], pdf["x"])), []
        for seed in sorted(left):
            if seed not in left:
                continue
            todo, area = [seed], []
            left.discard(seed)
            while todo:
                y, x = todo.pop()
                area.append((y, x))
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in left:
                        left.discard(p)
                        todo.append(p)
            ys, xs = np.array(area).T
            out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1))
        out.sort(key=lambda b: -b[2] * b[3])
        s, f = pdf["stream_id"].iloc[0], pdf["frame"].iloc[0]
        return pd.DataFrame([(s, f, k, *b) for k, b in enumerate(out[:most])], columns=["stream_id", "frame", "nth", "x", "y", "w", "h"])

    changed = with_previous(frames).filter("v <> prev")
    return changed.select("stream_id", "frame", "y", "x").groupBy(*FRAME).applyInPandas(boxes, "stream_id int, frame long, nth int, x int, y int, w int, h int")


def row_hash_matches(frames: DataFrame) -> DataFrame:
    """Rows of a frame that are rows of the frame before, elsewhere or not: found by hash, confirmed by comparing."""
    rows = frames.groupBy(*FRAME, "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s")).select(*FRAME, "y", F.transform("s", lambda s: s["v"]).alias("s"))
    rows = rows.withColumn("h", F.xxhash64("s"))
    before = rows.select("stream_id", (F.col("frame") + 1).alias("frame"), F.col("y").alias("from_y"), F.col("s").alias("s2"), "h")
    return rows.join(before, [*FRAME, "h"]).filter(F.col("s") == F.col("s2")).select(*FRAME, "y", "from_y")


def position_after(n: Column, v: Column, a: Column) -> Column:
    """Displacement of n steps that begin at speed v and grow by a."""
    return n * v + a * (n * (n - 1) / 2).cast("long")


# Cells of the grid of wrap-around shifts that is searched in both directions at once, reach of a box search, and the
# comparisons that the boxes of one frame share.
TORUS, REACH, BUDGET = 4096, 64, 1 << 22
#: Samples that a wrap-around shift is tried on before the whole picture, about, twice.
PROBES = 16


def wraps(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """Wrap-around shifts (dx, dy) other than none that turn one picture into the other: along one axis, and along both on small
    pictures. A shift is tried where the first sample may come from, on some samples, then as a whole."""
    h, w = after.shape
    both = (w + 1) * (h + 1) <= TORUS
    sy, sx = np.nonzero(before == after[0, 0])
    dx, dy = -sx % w, -sy % h
    some = ((dx != 0) | (dy != 0)) & (both | (dx == 0) | (dy == 0))
    sy, sx = sy[some], sx[some]
    # some samples, half of them unlike the first, rule out nearly all
    unlike = np.flatnonzero(after != after[0, 0])
    for spots in (unlike, np.arange(after.size)):
        for y, x in (divmod(k, w) for k in spots[:: max(1, len(spots) // PROBES)].tolist()):
            some = before[(sy + y) % h, (sx + x) % w] == after[y, x]
            sy, sx = sy[some], sx[some]
            if not len(sy):
                return []
    return [(dx, dy) for dx, dy in zip((-sx % w).tolist(), (-sy % h).tolist()) if (np.roll(before, (dy, dx), (0, 1)) == after).all()]


def box_moves(before: np.ndarray, base: np.ndarray, after: np.ndarray, boxes: list[tuple[int, int, int, int]], reach: int = REACH, budget: int = BUDGET) -> list[tuple[int, int, int]]:
    """For each box (x0, y0, x1, y1) of a picture the displacement (dy, dx) of its source in the picture before with the fewest
    mismatches, and their number; samples whose source is outside compare with base. Rising dy, then dx; the first of equals. The
    boxes share a budget of compared samples; displacements beyond it are not tried."""
    h, w = after.shape
    padded = np.zeros((h + 2 * reach, w + 2 * reach), after.dtype)
    padded[reach : reach + h, reach : reach + w] = before
    inside = np.zeros(padded.shape, bool)
    inside[reach : reach + h, reach : reach + w] = True
    out = []
    for x0, y0, x1, y1 in boxes:
        own, kept, best = after[y0:y1, x0:x1], base[y0:y1, x0:x1] != after[y0:y1, x0:x1], None
        for dy in range(-reach, reach + 1):
            if budget < own.size * (2 * reach + 1):
                break
            budget -= own.size * (2 * reach + 1)
            rows = slice(y0 + dy + reach, y1 + dy + reach)
            there = np.lib.stride_tricks.sliding_window_view(padded[rows], own.shape[1], axis=1)[:, x0 : x0 + 2 * reach + 1]
            valid = np.lib.stride_tricks.sliding_window_view(inside[rows], own.shape[1], axis=1)[:, x0 : x0 + 2 * reach + 1]
            bad = np.where(valid, there != own[:, None, :], kept[:, None, :]).sum(axis=(0, 2))
            k = int(bad.argmin())
            if best is None or bad[k] < best[2]:
                best = dy, k - reach, int(bad[k])
        out.append(best or (0, 0, int(kept.sum())))
    return out


def pairs_of(frames: DataFrame) -> DataFrame:
    """Packed frames (stream_id, frame, w, h, samples) with the samples of the frame before."""
    order = Window.partitionBy("stream_id").orderBy("frame")
    return frames.withColumn("before", F.lag("samples").over(order)).filter("before IS NOT NULL")


def shifts(frames: DataFrame) -> DataFrame:
    """The first wrap-around shift (dx, dy) of each packed frame against the one before, null if there is none."""

    def run(batches):
        for pdf in batches:
            found = [wraps(*(np.frombuffer(v, np.uint8).reshape(r.h, r.w) for v in (r.before, r.samples))) for r in pdf.itertuples(index=False)]
            first = [min(f) if f else (None, None) for f in found]
            yield pd.DataFrame({"stream_id": pdf["stream_id"], "frame": pdf["frame"], "dx": [f[0] for f in first], "dy": [f[1] for f in first]}).astype({"dx": "Int64", "dy": "Int64"})

    return pairs_of(frames).select("stream_id", "frame", "w", "h", "before", "samples").mapInPandas(run, "stream_id long, frame long, dx int, dy int")


def boxes_moved(frames: DataFrame, box: tuple[int, int, int, int], reach: int = REACH) -> DataFrame:
    """Where a box of each packed frame comes from in the frame before: dy, dx and the mismatches left."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (np.frombuffer(v, np.uint8).reshape(r.h, r.w) for v in (r.before, r.samples))
                rows.append((r.stream_id, r.frame, *box_moves(a, a, b, [box], reach)[0]))
            yield pd.DataFrame(rows, columns=["stream_id", "frame", "dy", "dx", "bad"])

    return pairs_of(frames).select("stream_id", "frame", "w", "h", "before", "samples").mapInPandas(run, "stream_id long, frame long, dy int, dx int, bad long")
