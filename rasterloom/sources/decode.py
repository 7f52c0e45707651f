"""Frames of a container, in packed form: the path for large canvases and long chains. One container is one task's work."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import scalar
from ..functions.kept import remembered
from ..operators import codec
from . import container as c


class Scene:
    """State of a scene: what transitions change, and how it is painted."""

    kind = np.uint8  # of samples

    def __init__(self, width: int, height: int):
        self.shape, self.background = (height, width), 0
        self.objects: dict[int, tuple] = {}
        self.instances: dict[int, list[int]] = {}  # id: object, x, y; the order is the paint order
        self.overlay: dict[tuple[int, int], int] = {}
        self.motion: dict[int, tuple] = {}  # id: ("velocity", vx, vy), ("program", segments) or ("affine", six numbers)
        self.palettes: dict[int, list[int]] = {}
        self.bound: dict[int, int] = {}
        #: background and instances as painted last, if they are as they were but for the instances that came on top since
        self.under: np.ndarray | None = None
        self.fresh: list[int] = []

    def copy(self, objects: Mapping | None = None, instances: MutableMapping | None = None) -> Scene:
        """A scene of its own state; objects are never changed and are shared. Programs must not have begun. With `objects` or
        `instances` the table of them is not copied, but that one."""
        out = Scene(self.shape[1], self.shape[0])
        out.background, out.objects = self.background, dict(self.objects) if objects is None else objects
        out.instances = {k: list(v) for k, v in self.instances.items()} if instances is None else instances
        if instances or instances is None:
            out.under, out.fresh = self.under, list(self.fresh)
        out.palettes = {k: list(v) for k, v in self.palettes.items()}
        out.overlay, out.motion, out.bound = dict(self.overlay), dict(self.motion), dict(self.bound)
        return out

    def declare(self, tag: int, args: list[int], data: bytes) -> None:
        if tag in (c.PALETTE, c.CHECKPOINT, c.CHECKPOINT_BOUND) or args[0] in self.objects:
            self.under = None
        if tag == c.PALETTE:
            self.palettes[args[0]] = list(data)
        elif tag in (c.CHECKPOINT, c.CHECKPOINT_BOUND):
            self.background, width = args[0], 4 if tag == c.CHECKPOINT else 5
            for i in range(1, len(args), width):
                self.instances[args[i]] = args[i + 1 : i + 4]
                if width == 5 and args[i + 4]:
                    self.bound[args[i]] = args[i + 4]
        else:
            self.objects[args[0]] = (tag, args, data)

    def apply(self, tag: int, args: list[int], data: bytes) -> bool:
        """Whether the transition was one of the state (the others are of the canvas)."""
        iid = args[0] if args else 0
        if tag == 0x21 and iid not in self.instances:
            self.fresh.append(iid)
        elif tag not in (0x23, 0x24, 0x25, 0x29, 0x2A):
            self.under = None
        if tag == 0x21:
            self.instances[iid] = args[1:4]
        elif tag == 0x22:
            self.instances[iid][1:] = args[1:3]
        elif tag == 0x23:
            self.overlay.update({(args[i], args[i + 1]): args[i + 2] for i in range(0, len(args), 3)})
        elif tag == 0x26:
            self._move(iid, ("velocity", *args[1:3]) if args[1:3] != [0, 0] else None)
        elif tag == 0x27:
            for k, m in self.motion.items():
                if m[0] == "velocity":
                    self._shift(k, m[1], m[2])
        elif tag == 0x28:
            for d in (self.instances, self.motion, self.bound):
                d.clear()
        elif tag == 0x29:
            self.overlay.clear()
        elif tag == c.TRAJECTORY:
            steps = program_steps(args[1:])
            if len(args) > 1:
                self._move(iid, ("program", steps))
            elif self.motion.get(iid, ("",))[0] == "program":
                del self.motion[iid]
        elif tag == 0x2C:
            for k, m in list(self.motion.items()):
                if m[0] == "program":
                    step = next(m[1], None)
                    if step is None:
                        del self.motion[k]
                    else:
                        self._shift(k, *step)
        elif tag == 0x2D:
            self.palettes[iid] = list(data)
        elif tag == 0x2E:
            if iid not in self.palettes:
                raise c.Breach("unknown palette")
            for i in range(1, len(args), 2):
                if args[i] >= len(self.palettes[iid]):
                    raise c.Breach("palette index")
                self.palettes[iid][args[i]] = args[i + 1]
        elif tag == 0x2F:
            self.bound.pop(iid, None)
            if args[1]:
                if args[1] not in self.palettes:
                    raise c.Breach("unknown palette")
                self.bound[iid] = args[1]
        elif tag == 0x30:
            self._move(iid, ("affine", *args[1:]) if args[1:] != [256, 0, 0, 0, 256, 0] else None)
        else:
            return False
        return True

    def _move(self, iid: int, motion: tuple | None) -> None:
        self.motion.pop(iid, None)
        if motion:
            self.motion[iid] = motion

    def _shift(self, iid: int, dx: int, dy: int) -> None:
        self.instances[iid][1] += dx
        self.instances[iid][2] += dy

    def samples(self, iid: int, oid: int) -> np.ndarray:
        tag, args, data = self.objects[oid]
        w, h = args[1:3]
        if tag == c.FILL:
            return np.full((h, w), args[3], np.uint8)
        if tag == c.GENERATOR:
            return generated(args[3], args[4:], w, h)
        if tag == c.EXTERNAL:
            raise c.Breach("external object")
        raster = np.frombuffer(data, np.uint8).reshape(h, w)
        if tag == c.INDEX:
            palette = self.palettes.get(self.bound.get(iid, 0))
            if palette is None or raster.max() >= len(palette):
                raise c.Breach("palette")
            return np.array(palette, np.uint8)[raster]
        return raster

    def painted(self) -> np.ndarray:
        """The canvas. Instances that came on top since it was painted last are painted on what was there, else all of them."""
        canvas = np.full(self.shape, self.background, self.kind) if self.under is None else self.under.copy()
        height, width = self.shape
        for iid in self.instances if self.under is None else self.fresh:
            oid, x, y = self.instances[iid]
            own = self.samples(iid, oid)
            h, w = own.shape
            move = self.motion.get(iid, ("",))
            if move[0] == "affine":
                py, px = np.mgrid[0:height, 0:width]
                a, b, e, d, f, g = move[1:]
                sx, sy = (a * px + b * py + e) >> 8, (d * px + f * py + g) >> 8
                ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
                canvas[ok] = own[sy[ok], sx[ok]]
                continue
            x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
            if x0 < x1 and y0 < y1:
                canvas[y0:y1, x0:x1] = own[y0 - y : y1 - y, x0 - x : x1 - x]
        self.under, self.fresh, canvas = canvas, [], canvas.copy()
        for (x, y), v in self.overlay.items():
            if 0 <= x < width and 0 <= y < height:
                canvas[y, x] = v
        return canvas


def program_steps(args: list[int]) -> Iterator[tuple[int, int]]:
    """Velocity of each step of a trajectory program."""
    at = 0
    while at < len(args):
        kind = args[at]
        n = len(c.SEGMENTS[kind])
        own = args[at + 1 : at + 1 + n]
        ax, ay = own[2:4] if kind else (0, 0)
        for j in range(own[-1]):
            yield own[0] + j * ax, own[1] + j * ay
        at += n + 1


#: Fields of up to so many samples are remembered, some at a time: what they are painted on changes more often than they do.
REMEMBERED = 1 << 12


def generated(kind: int, args: list[int], w: int, h: int) -> np.ndarray:
    """Samples of a program; not to be written to."""
    return remembered("fields", 64, (kind, *args, w, h), lambda: _generated(kind, args, w, h)) if w * h <= REMEMBERED else _generated(kind, args, w, h)


def _generated(kind: int, args: list[int], w: int, h: int) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w].astype(np.int64)
    if kind == 0:
        out = (args[0] + args[1] * x + args[2] * y) % 256
    elif kind == 1:
        out = np.where((x // args[2] + y // args[2]) % 2 == 0, args[0], args[1])
    elif kind == 2:
        out = (args[0] + args[1] * (x % args[3]) + args[2] * (y % args[3])) % 256
    else:
        flat = scalar.noise_values(pd.Series(np.full(w * h, np.uint64(args[0]).view(np.int64))), pd.Series(x.ravel()), pd.Series(y.ravel()))
        out = flat.to_numpy().reshape(h, w)
    out = out.astype(np.uint8)
    out.flags.writeable = False
    return out


def on_canvas(canvas: np.ndarray, before: np.ndarray, tag: int, args: list[int], data: bytes) -> np.ndarray:
    if tag in (0x24, 0x25):
        sx, sy, w, h, dx, dy = args
        out, left, top = canvas.copy(), max(0, -sx, -dx), max(0, -sy, -dy)
        right, bottom = min(w, canvas.shape[1] - sx, canvas.shape[1] - dx), min(h, canvas.shape[0] - sy, canvas.shape[0] - dy)
        if left < right and top < bottom:
            out[dy + top : dy + bottom, dx + left : dx + right] = before[sy + top : sy + bottom, sx + left : sx + right]
        return out
    if tag == 0x2A:
        out, (height, width) = canvas.copy(), canvas.shape
        try:
            if data[:1] == bytes([codec.TRANSFORMED]):
                total = canvas + codec.transform_delta(data, width, height)
                if total.min() < 0 or total.max() > 255:
                    raise ValueError("sample out of range")
                return total.astype(np.uint8)
            points = codec.points_of(data)
        except ValueError as e:
            raise c.Breach(str(e)) from e
        if len(points) and not ((points["x"] >= 0) & (points["x"] < width) & (points["y"] >= 0) & (points["y"] < height)).all():
            raise c.Breach("residual point outside the canvas")
        out[points["y"], points["x"]] = points["v"]
        return out
    raise c.Breach("unknown transition")


def decode(data: bytes, magic: bytes = c.MAGIC) -> Iterator[np.ndarray]:
    """Frame 0, then a frame for each group: state transitions first, then what is painted, then the canvas's own."""
    scene, pending, canvas = None, None, None

    def close(group: list[tuple], before: np.ndarray) -> np.ndarray:
        late = [x for x in group if not scene.apply(*x)]
        out = scene.painted()
        for x in late:
            out = on_canvas(out, before, *x)
        return out

    for n, tag, t, args, body, _, _ in c.read(data, magic):
        if n == 0:
            scene = Scene(*args[:2])
        elif t is None:
            scene.declare(tag, args, body)
        elif tag == c.GROUP:
            if pending is None:
                canvas = scene.painted()
                yield canvas
            else:
                canvas = close(pending, canvas)
                yield canvas
            pending = []
        else:
            pending.append((tag, args, body))
    yield scene.painted() if pending is None else close(pending, canvas)


#: Bytes of frames that are handed on at once, about, and what a row counts besides its samples.
BATCH, ROW = 4 << 20, 256


def frames(files: DataFrame, magic: bytes = c.MAGIC) -> DataFrame:
    """Frames of `binaryFile` rows (path, content): path, frame, w, h, samples; a container that breaks a rule gives an error row."""

    def run(batches):
        rows, size = [], 0

        def made() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["path", "frame", "w", "h", "samples", "error"]).astype({"frame": "Int64", "w": "Int32", "h": "Int32"})

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    for n, f in enumerate(decode(bytes(data), magic)):
                        rows.append((path, n, f.shape[1], f.shape[0], f.tobytes(), None))
                        size += f.nbytes + ROW
                        if size >= BATCH:
                            yield made()
                            rows, size = [], 0
                except c.Breach as e:
                    rows.append((path, None, None, None, None, str(e)))
        if rows:
            yield made()

    return files.select("path", "content").mapInPandas(run, "path string, frame long, w int, h int, samples binary, error string")
