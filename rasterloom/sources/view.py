"""Views of a container: a rectangle of one frame, evaluated through copies without painting whole frames.

First the plan goes back from the view: what a frame needs of the one before is where its copies read for what is needed of it.
Then frames are painted forward, each only where it is needed and not overwritten by a copy.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import codec
from ..operators.region import Region, target_of
from . import container as c
from . import decode, rewrite


@dataclass
class Work:
    """What a view has cost."""

    replayed: int = 0
    levels: int = 0
    base: int = 0
    copied: int = 0
    residual: int = 0
    objects: int = 0
    peak: int = 0
    spans: int = 0


def demands(groups: list[tuple], at: int, view: Region, width: int, height: int) -> list[Region]:
    """What the view of frame `at` needs of each frame up to it."""
    out = [Region.box(0, 0, 0, 0) for _ in range(at)] + [view]
    for t in range(at, 0, -1):
        for tag, args, _ in groups[t - 1][1]:
            if tag in (0x24, 0x25) and len(out[t]):
                out[t - 1] = out[t - 1].union(out[t].cut(*target_of(args, width, height)).moved(args[0] - args[4], args[1] - args[5]))
    return out


class Part:
    """Samples of a region's box."""

    def __init__(self, region: Region, value: int):
        self.region, self.samples = region, np.full(region.mask.shape, value, np.uint8)

    def put(self, x0: int, y0: int, values: np.ndarray, where: np.ndarray) -> int:
        """Values of a box that lies inside the region's, where a mask of that box says so."""
        here = self.samples[y0 - self.region.y :, x0 - self.region.x :][: values.shape[0], : values.shape[1]]
        here[where] = values[where]
        return int(where.sum())


def paint(part: Part, scene: decode.Scene, region: Region, work: Work, touched: set[int]) -> None:
    """Background, instances in order and overlay, over a region inside the part's. An object outside of it is not looked at."""
    height, width = scene.shape
    if not len(region):
        return
    work.base += len(region)
    x1, y1 = region.ends
    for iid, (oid, x, y) in scene.instances.items():
        w, h = scene.objects[oid][1][1:3]
        move = scene.motion.get(iid, ("",))
        if move[0] == "affine":
            py, px = np.mgrid[region.y : y1, region.x : x1]
            a, b, e, d, f, g = move[1:]
            sx, sy = (a * px + b * py + e) >> 8, (d * px + f * py + g) >> 8
            ok = region.mask & (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
            if ok.any():
                own = scene.samples(iid, oid)
                work.base += part.put(region.x, region.y, own[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], ok)
                touched.add(oid)
            continue
        a, b, e, f = max(x, region.x), max(y, region.y), min(x + w, x1), min(y + h, y1)
        if a < e and b < f and (ok := region.within(a, b, e, f)).any():
            work.base += part.put(a, b, scene.samples(iid, oid)[b - y : f - y, a - x : e - x], ok)
            touched.add(oid)
    for (x, y), v in scene.overlay.items():
        if region.x <= x < x1 and region.y <= y < y1 and region.mask[y - region.y, x - region.x]:
            part.samples[y - part.region.y, x - part.region.x] = v
            work.base += 1


def view(data: bytes, at: int, box: tuple[int, int, int, int], magic: bytes = c.MAGIC) -> tuple[np.ndarray, Work]:
    """The samples of a box (x0, y0, x1, y1) of frame `at`, clipped to the canvas, and the work; a box outside is an error."""
    (width, height, _), records, groups = rewrite.parts(data, magic)
    clip = Region.box(max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3]))
    if not len(clip):
        raise c.Breach("empty view")
    if not 0 <= at <= len(groups):
        raise c.Breach("no such frame")
    needed, work, touched, prev = demands(groups, at, clip, width, height), Work(), set(), None
    scene = decode.Scene(width, height)
    for r in records:
        scene.declare(*r)
    for t in range(at + 1):
        late = [x for x in groups[t - 1][1] if not scene.apply(*x)] if t else []
        work.replayed = t + 1
        if not len(needed[t]):
            continue
        part, rest = Part(needed[t], scene.background), needed[t]
        for tag, args, _ in late:
            if tag in (0x24, 0x25):
                rest = rest.without(*target_of(args, width, height))
        paint(part, scene, rest, work, touched)
        for tag, args, body in late:
            _late(part, prev, tag, args, body, width, height, work)
        work.levels, work.spans, work.peak = work.levels + 1, work.spans + needed[t].spans(), max(work.peak, needed[t].mask.size)
        prev = part
    work.objects = len(touched)
    return prev.samples, work


def _late(part: Part, prev: Part | None, tag: int, args: list[int], body: bytes, width: int, height: int, work: Work) -> None:
    region = part.region
    if tag in (0x24, 0x25):
        to = region.cut(*target_of(args, width, height))
        if len(to):
            x, y = to.x + args[0] - args[4] - prev.region.x, to.y + args[1] - args[5] - prev.region.y
            h, w = to.mask.shape
            work.copied += part.put(to.x, to.y, np.pad(prev.samples, ((0, h), (0, w)))[y : y + h, x : x + w], to.mask)
        return
    try:
        if body[:1] == bytes([codec.TRANSFORMED]):
            x1, y1 = region.ends
            total = part.samples + codec.transform_delta(body, width, height)[region.y : y1, region.x : x1]
            if total[region.mask].min(initial=0) < 0 or total[region.mask].max(initial=0) > 255:
                raise ValueError("sample out of range")
            work.residual += part.put(region.x, region.y, total.astype(np.uint8), region.mask)
            return
        for x, y, v in codec.points_of(body).tolist():
            if region.within(x, y, x + 1, y + 1).any():
                part.samples[y - region.y, x - region.x] = v
                work.residual += 1
    except ValueError as e:
        raise c.Breach(str(e)) from e


def viewed(files: DataFrame, at: int, box: tuple[int, int, int, int], magic: bytes = c.MAGIC) -> DataFrame:
    """The view of each of `binaryFile` rows (path, content): path, w, h, samples, the work, error."""
    names = [f.name for f in fields(Work)]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    samples, work = view(bytes(data), at, box, magic)
                    rows.append((path, samples.shape[1], samples.shape[0], samples.tobytes(), *(getattr(work, n) for n in names), None))
                except c.Breach as e:
                    rows.append((path, None, None, None, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "samples", *names, "error"]).astype(dict.fromkeys(("w", "h", *names), "Int64"))

    return files.select("path", "content").mapInPandas(run, "path string, w int, h int, samples binary, " + ", ".join(f"{n} long" for n in names) + ", error string")
