"""The second container: programs of several planes, of any depth up to 16 bits, under one media descriptor.

A file is a header, a descriptor, a block for each plane (background, objects, instances, overlay, groups and, where it is declared,
palettes and motion at the start), and a digest. Feature bits are the fewest that the content needs; what needs a bit is refused
without it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.digest import blake3
from ..operators import codec
from . import container as c
from . import decode

MAGIC = b"SCENE"
VERSION, UNIVERSE, PROFILE = 2, 2, 1
# Feature bits (families, global motion), tags of blocks, kinds of objects, and layouts with their codes, components
# and how often the second and third plane are halved across and down.
FAMILIES, GLOBAL = 1, 2
DESCRIPTOR, PLANE = 0x11, 0x10
FILL, RASTER, INDEX, GENERATOR = 1, 2, 3, 4
LAYOUTS = {
    "gray": (1, "g", 0, 0), "yuv400": (2, "y", 0, 0), "yuv420": (3, "yuv", 1, 1), "yuv422": (4, "yuv", 1, 0), "yuv444": (5, "yuv", 0, 0), "yuva420": (6, "yuva", 1, 1), "yuva444": (7, "yuva", 0, 0), "gbr": (8, "RGB", 0, 0),
    "gbra": (9, "RGBa", 0, 0), "rgb": (10, "RGB", 0, 0), "bgr": (11, "RGB", 0, 0), "rgba": (12, "RGBa", 0, 0), "bgra": (13, "RGBa", 0, 0), "argb": (14, "RGBa", 0, 0), "abgr": (15, "RGBa", 0, 0), "indexed": (16, "i", 0, 0),
}
COMPONENTS = {"y": 1, "u": 2, "v": 3, "R": 4, "G": 5, "B": 6, "a": 7, "g": 8, "i": 9}
# Operations with the struct codes of their operands, those with counted parts, those with bytes; operations and
# objects that need the bit of families; precisions of maps by their codes; kinds of motion at the start.
PLAIN = {0x22: "IIii", 0x23: "Iii", 0x24: "", 0x25: "", 0x27: "iiIIii", 0x29: "Iii", 0x2A: "", 0x2C: "", 0x2F: "II", 0x30: "Iiiiiii", 0x32: "Biiiiii"}
COUNTED = {0x26: ("", "iiI"), 0x2D: ("I", "I"), 0x2E: ("I", "II")}
BYTES = (0x28, 0x31)
DECLARE, TRAJECTORY, PREDICT = 0x21, 0x2B, 0x32
FAMILY_OPS, FAMILY_OBJECTS = frozenset(range(0x29, 0x32)), (INDEX, GENERATOR)
SHIFTS = {0: 8, 1: 12, 2: 16}
MOTION = {1: "ii", 3: "iiiiii", 4: "I"}
PROGRAM_MOTION = 2
# Parameters of generators by kind (gradient, checker, periodic, noise).
GENERATORS = {0: "Iii", 1: "III", 2: "IiiI", 3: "Q"}
#: Operations that change the state, as those of the first container.
STATE = {0x22: 0x21, 0x23: 0x22, 0x24: 0x28, 0x25: 0x29, 0x26: 0x23, 0x29: 0x26, 0x2A: 0x27, 0x2B: c.TRAJECTORY, 0x2C: 0x2C, 0x2D: 0x2D, 0x2E: 0x2E, 0x2F: 0x2F, 0x30: 0x30}


@dataclass
class Plane:
    """The program of one plane. Objects: (id, width, height, kind, arguments, samples); operations: (tag, arguments, bytes), a
    declaration having an object in place of its arguments; motion: (instance, kind, arguments)."""

    background: int = 0
    objects: list[tuple] = field(default_factory=list)
    instances: list[tuple[int, int, int, int]] = field(default_factory=list)
    overlay: list[tuple[int, int, int]] = field(default_factory=list)
    groups: list[tuple[int, list[tuple]]] = field(default_factory=list)
    palettes: dict[int, list[int]] = field(default_factory=dict)
    motion: list[tuple[int, int, list[int]]] = field(default_factory=list)

    def features(self) -> int:
        ops = [op for _, group in self.groups for op in group]
        objects = self.objects + [op[1] for op in ops if op[0] == DECLARE]
        family = bool(self.palettes or self.motion) or any(o[3] in FAMILY_OBJECTS for o in objects) or any(op[0] in FAMILY_OPS for op in ops)
        return FAMILIES * family | GLOBAL * any(op[0] == PREDICT for op in ops)


@dataclass
class Media:
    """What the planes mean. Colour: chroma location, primaries, transfer, matrix and range, by their codes."""

    width: int
    height: int
    layout: str
    depths: tuple[int, ...]
    colour: tuple[int, int, int, int, int] = (0, 0, 0, 0, 0)
    aspect: tuple[int, int] = (1, 1)
    orientation: int = 0
    field: int = 0

    def size(self, plane: int) -> tuple[int, int]:
        _, parts, across, down = LAYOUTS[self.layout]
        k, m = (across, down) if parts[plane] in "uv" else (0, 0)
        return -(-self.width >> k), -(-self.height >> m)

    def check(self) -> None:
        if self.layout not in LAYOUTS or min(self.width, self.height) < 1 or min(self.aspect) < 1:
            raise c.Breach("descriptor")
        if self.width * self.height > c.MOST_SAMPLES:
            raise c.Breach("too large")
        if len(self.depths) != len(LAYOUTS[self.layout][1]) or not all(1 <= d <= 16 for d in self.depths):
            raise c.Breach("depths")


def _samples(depth: int) -> str:
    return "u1" if depth <= 8 else "<u2"


def _object(one: tuple) -> bytes:
    oid, w, h, kind, args, samples = one
    out = struct.pack("<IIIB", oid, w, h, kind)
    if kind == FILL:
        return out + struct.pack("<I", *args)
    if kind == GENERATOR:
        return out + struct.pack("<B" + GENERATORS[args[0]], *args)
    return out + struct.pack("<Q", len(samples)) + samples


def _segments(args: list[int]) -> tuple[int, bytes]:
    out, n = b"", 0
    while args:
        codes = c.SEGMENTS[args[0]]
        out += struct.pack("<B" + codes, *args[: 1 + len(codes)])
        args, n = args[1 + len(codes) :], n + 1
    return n, out


def operation(tag: int, args, data: bytes = b"") -> bytes:
    """Bytes of an operation."""
    if tag == DECLARE:
        return bytes([tag]) + _object(args)
    if tag in PLAIN:
        return struct.pack("<B" + PLAIN[tag], tag, *args)
    if tag in COUNTED:
        head, each = COUNTED[tag]
        own, rest, n = args[: len(head)], args[len(head) :], len(each)
        return struct.pack("<B" + head + "I", tag, *own, len(rest) // n) + b"".join(struct.pack("<" + each, *rest[i : i + n]) for i in range(0, len(rest), n))
    if tag in BYTES:
        return struct.pack("<BQ", tag, len(data)) + data
    if tag == TRAJECTORY:
        n, out = _segments(args[1:])
        return struct.pack("<BII", tag, args[0], n) + out
    raise c.Breach("unknown operation")


def write(media: Media, planes: list[Plane], digest: Callable[[bytes], bytes] = blake3) -> bytes:
    media.check()
    if len(planes) != len(media.depths):
        raise c.Breach("plane count")
    features = 0
    for p in planes:
        features |= p.features()
    code, parts, _, _ = LAYOUTS[media.layout]
    out = MAGIC + b"\0" + struct.pack("<HIBIII", VERSION, UNIVERSE, PROFILE, features, media.width, media.height)
    out += struct.pack("<BHB", DESCRIPTOR, code, len(parts)) + b"".join(struct.pack("<BB", COMPONENTS[x], d) for x, d in zip(parts, media.depths))
    out += struct.pack("<5BIIBB", *media.colour, *media.aspect, media.orientation, media.field)
    for k, p in enumerate(planes):
        out += struct.pack("<BBI", PLANE, k, p.background)
        out += struct.pack("<I", len(p.objects)) + b"".join(_object(o) for o in sorted(p.objects, key=lambda o: o[0]))
        out += struct.pack("<I", len(p.instances)) + b"".join(struct.pack("<IIii", *i) for i in p.instances)
        out += struct.pack("<I", len(p.overlay)) + b"".join(struct.pack("<iiI", *o) for o in p.overlay)
        out += struct.pack("<I", len(p.groups))
        for t, ops in p.groups:
            out += struct.pack("<QI", t, len(ops)) + b"".join(operation(*op) for op in ops)
        if features & FAMILIES:
            out += struct.pack("<I", len(p.palettes)) + b"".join(struct.pack(f"<II{len(v)}I", i, len(v), *v) for i, v in sorted(p.palettes.items()))
            out += struct.pack("<I", len(p.motion))
            for iid, kind, args in sorted(p.motion):
                n, program = _segments(args) if kind == PROGRAM_MOTION else (0, b"")
                out += struct.pack("<IB", iid, kind) + (struct.pack("<I", n) + program if kind == PROGRAM_MOTION else struct.pack("<" + MOTION[kind], *args))
    return out + digest(out)


class _Reader(c.Cursor):
    def segments(self) -> list[int]:
        (n,), out = self.pull("I"), []
        for _ in range(n):
            (kind,) = self.pull("B")
            if kind not in c.SEGMENTS:
                raise c.Breach("unknown segment")
            own = self.pull(c.SEGMENTS[kind])
            if not own[-1] or kind == 1 and own[2:4] == [0, 0]:
                raise c.Breach("segment without effect")
            out += [kind, *own]
        return out

    def object(self, depth: int, features: int) -> tuple:
        oid, w, h, kind = self.pull("IIIB")
        if not w or not h:
            raise c.Breach("empty object")
        if w * h > c.MOST_SAMPLES:
            raise c.Breach("too large")
        if kind in FAMILY_OBJECTS and not features & FAMILIES:
            raise c.Breach("feature not declared")
        if kind == FILL:
            args = self.pull("I")
            if args[0] >> depth:
                raise c.Breach("sample out of range")
            return oid, w, h, kind, args, b""
        if kind == GENERATOR:
            (program,) = self.pull("B")
            if program not in GENERATORS:
                raise c.Breach("unknown generator")
            own = self.pull(GENERATORS[program])
            if program in (1, 2) and not own[-1]:
                raise c.Breach("generator without effect")
            return oid, w, h, kind, [program, *own], b""
        if kind not in (RASTER, INDEX):
            raise c.Breach("unknown object")
        (size,) = self.pull("Q")
        each = 1 if kind == INDEX else np.dtype(_samples(depth)).itemsize
        if size != w * h * each:
            raise c.Breach("sample count")
        samples = self.take(size)
        if kind == RASTER and np.frombuffer(samples, _samples(depth)).max() >> depth:
            raise c.Breach("sample out of range")
        return oid, w, h, kind, [], samples

    def op(self, depth: int, features: int) -> tuple:
        (tag,) = self.pull("B")
        if tag in FAMILY_OPS and not features & FAMILIES or tag == PREDICT and not features & GLOBAL:
            raise c.Breach("feature not declared")
        if tag == DECLARE:
            return tag, self.object(depth, features), b""
        if tag in PLAIN:
            args = self.pull(PLAIN[tag])
            if tag == PREDICT and args[0] not in SHIFTS or any(abs(v) > c.LARGEST for v in args[-2:] if tag in (0x22, 0x23, 0x29)):
                raise c.Breach("operand out of range")
            return tag, args, b""
        if tag in COUNTED:
            head, each = COUNTED[tag]
            own, (n,) = self.pull(head), self.pull("I")
            return tag, own + [v for _ in range(n) for v in self.pull(each)], b""
        if tag in BYTES:
            (n,) = self.pull("Q")
            return tag, [], self.take(n)
        if tag == TRAJECTORY:
            (iid,) = self.pull("I")
            return tag, [iid, *self.segments()], b""
        raise c.Breach("unknown operation")


def parse(data: bytes, digest: Callable[[bytes], bytes] = blake3) -> tuple[Media, list[Plane]]:
    """The inverse of write(); raises Breach. Feature bits that nothing needs are refused too."""
    cur = _Reader(data, len(data) - 32)
    if cur.end < 6 or cur.take(6) != MAGIC + b"\0":
        raise c.Breach("magic")
    version, universe, profile, features, width, height = cur.pull("HIBIII")
    if (version, universe, profile) != (VERSION, UNIVERSE, PROFILE) or features & ~(FAMILIES | GLOBAL):
        raise c.Breach("unsupported version, universe, profile or feature")
    tag, code, n = cur.pull("BHB")
    layout = next((k for k, v in LAYOUTS.items() if v[0] == code), None)
    if tag != DESCRIPTOR or layout is None or n != len(LAYOUTS[layout][1]):
        raise c.Breach("descriptor")
    pairs = [cur.pull("BB") for _ in range(n)]
    if [p[0] for p in pairs] != [COMPONENTS[x] for x in LAYOUTS[layout][1]]:
        raise c.Breach("components")
    colour = tuple(cur.pull("5B"))
    media = Media(width, height, layout, tuple(p[1] for p in pairs), colour, tuple(cur.pull("II")), *cur.pull("BB"))
    media.check()
    planes = []
    for k in range(n):
        tag, index, background = cur.pull("BBI")
        depth = media.depths[k]
        if (tag, index) != (PLANE, k) or background >> depth:
            raise c.Breach("plane")
        counted = lambda read: [read() for _ in range(cur.pull("I")[0])]
        p = Plane(background, counted(lambda d=depth: cur.object(d, features)), counted(lambda: tuple(cur.pull("IIii"))), counted(lambda: tuple(cur.pull("iiI"))))
        if any(a[0] >= b[0] for a, b in zip(p.objects, p.objects[1:])):
            raise c.Breach("objects do not rise")
        last = 0
        for _ in range(cur.pull("I")[0]):
            t, count = cur.pull("QI")
            if t <= last:
                raise c.Breach("time does not rise")
            last = t
            p.groups.append((t, [cur.op(depth, features) for _ in range(count)]))
        if features & FAMILIES:
            for _ in range(cur.pull("I")[0]):
                pid, size = cur.pull("II")
                if not pid or not size or pid in p.palettes:
                    raise c.Breach("palette")
                p.palettes[pid] = cur.pull(f"{size}I")
            for _ in range(cur.pull("I")[0]):
                iid, kind = cur.pull("IB")
                if kind != PROGRAM_MOTION and kind not in MOTION or p.motion and iid <= p.motion[-1][0] or iid not in {i[0] for i in p.instances}:
                    raise c.Breach("motion")
                p.motion.append((iid, kind, cur.segments() if kind == PROGRAM_MOTION else cur.pull(MOTION[kind])))
        planes.append(p)
    needed = 0
    for p in planes:
        needed |= p.features()
    if cur.at != cur.end or needed != features:
        raise c.Breach("not canonical")
    if digest(data[:-32]) != data[-32:]:
        raise c.Breach("digest")
    return media, planes


class PlaneScene(decode.Scene):
    """The state of one plane; samples are numbers of 32 bits."""

    kind = np.uint32

    def __init__(self, width: int, height: int, depth: int, program: Plane):
        super().__init__(width, height)
        self.depth, self.background = depth, program.background
        self.objects = {o[0]: o for o in program.objects}
        self.instances = {i: [o, x, y] for i, o, x, y in program.instances}
        self.overlay = {(x, y): v for x, y, v in program.overlay}
        self.palettes = {k: list(v) for k, v in program.palettes.items()}
        if len(self.objects) != len(program.objects) or len(self.instances) != len(program.instances):
            raise c.Breach("id twice")
        if any(o not in self.objects for o, _, _ in self.instances.values()):
            raise c.Breach("unknown object")
        for iid, kind, args in program.motion:
            tag = {1: 0x26, PROGRAM_MOTION: c.TRAJECTORY, 3: 0x30, 4: 0x2F}[kind]
            super().apply(tag, [iid, *args], b"")

    def samples(self, iid: int, oid: int) -> np.ndarray:
        _, w, h, kind, args, data = self.objects[oid]
        if kind == FILL:
            return np.full((h, w), args[0], np.uint32)
        if kind == GENERATOR:
            return generated(args, w, h, self.depth)
        if kind == RASTER:
            return np.frombuffer(data, _samples(self.depth)).reshape(h, w).astype(np.uint32)
        palette, index = self.palettes.get(self.bound.get(iid, 0)), np.frombuffer(data, np.uint8).reshape(h, w)
        if palette is None or index.max() >= len(palette):
            raise c.Breach("palette")
        return np.array(palette, np.uint32)[index]

    def check(self, tag: int, args: list[int]) -> None:
        """That an operation's ids are there, and new where they must be."""
        if tag == 0x22 and (args[1] not in self.objects or args[0] in self.instances):
            raise c.Breach("unknown object" if args[1] not in self.objects else "instance twice")
        if tag in (0x23, 0x29, TRAJECTORY, 0x2F, 0x30) and args[0] not in self.instances:
            raise c.Breach("unknown instance")
        if tag == 0x2E and args[0] not in self.palettes or tag == 0x2D and (not args[0] or len(args) < 2):
            raise c.Breach("palette")

    def step(self, ops: list[tuple], before: np.ndarray) -> np.ndarray:
        """The picture after a group: the state's operations first, then what is painted, then the canvas's own."""
        late = []
        for tag, args, data in ops:
            if tag == DECLARE:
                if args[0] in self.objects:
                    raise c.Breach("object twice")
                self.objects[args[0]] = args
            elif tag in STATE:
                self.check(tag, args)
                self.apply(STATE[tag], args[:1] if tag == 0x2D else args, args[1:] if tag == 0x2D else data)
            else:
                late.append((tag, args, data))
        out = self.painted()
        for tag, args, data in late:
            out = self._late(out, before, tag, args, data)
        if (out >> self.depth).any():
            raise c.Breach("sample out of range")
        return out

    def _late(self, canvas: np.ndarray, before: np.ndarray, tag: int, args: list[int], data: bytes) -> np.ndarray:
        h, w = canvas.shape
        if tag == 0x27:
            return decode.on_canvas(canvas, before, 0x24, args, b"")
        if tag == PREDICT:
            s, (a, b, e, d, f, g) = SHIFTS[args[0]], args[1:]
            y, x = np.mgrid[0:h, 0:w].astype(np.int64)
            sx, sy = (a * x + b * y + e) >> s, (d * x + f * y + g) >> s
            ok, out = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h), canvas.copy()
            out[ok] = before[sy[ok], sx[ok]]
            return out
        try:
            if tag == 0x31 or data[:1] == bytes([codec.TRANSFORMED]):
                total = canvas.astype(np.int64) + codec.transform_delta(data, w, h)
                if total.min() < 0 or total.max() >> self.depth:
                    raise ValueError("sample out of range")
                return total.astype(np.uint32)
            points = codec.points_of(data, self.depth > 8)
        except ValueError as e:
            raise c.Breach(str(e)) from e
        out = canvas.copy()
        if len(points) and not ((points["x"] >= 0) & (points["x"] < w) & (points["y"] >= 0) & (points["y"] < h)).all():
            raise c.Breach("residual point outside the canvas")
        out[points["y"], points["x"]] = points["v"]
        return out


def generated(args: list[int], w: int, h: int, depth: int) -> np.ndarray:
    """A program's samples at a depth; products of gradients wrap at the range."""
    kind, own, top = args[0], args[1:], 1 << depth
    y, x = np.mgrid[0:h, 0:w].astype(np.int64)
    if kind == 0:
        return ((own[0] + own[1] * x + own[2] * y) % top).astype(np.uint32)
    if kind == 1:
        return np.where((x // own[2] + y // own[2]) % 2 == 0, own[0], own[1]).astype(np.uint32)
    if kind == 2:
        return ((own[0] + own[1] * (x % own[3]) + own[2] * (y % own[3])) % top).astype(np.uint32)
    return (decode.generated(3, own, w, h).astype(np.int64) * top >> 8).astype(np.uint32)


def observation(media: Media, planes: list[Plane], at: int) -> list[np.ndarray]:
    """All planes after the groups up to time `at`; each plane is replayed by itself."""
    out = []
    for k, p in enumerate(planes):
        scene = PlaneScene(*media.size(k), media.depths[k], p)
        canvas = scene.painted()
        for t, ops in p.groups:
            if t > at:
                break
            canvas = scene.step(ops, canvas)
        out.append(canvas)
    return out


def observations(files: DataFrame, at: int, digest: Callable[[bytes], bytes] = blake3) -> DataFrame:
    """Planes of `binaryFile` rows (path, content) at a time: path, plane, w, h, depth, samples (array of int), error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    media, planes = parse(bytes(data), digest)
                    rows += [(path, k, v.shape[1], v.shape[0], media.depths[k], v.ravel().astype(int).tolist(), None) for k, v in enumerate(observation(media, planes, at))]
                except c.Breach as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "plane", "w", "h", "depth", "samples", "error"]).astype(dict.fromkeys(("plane", "w", "h", "depth"), "Int64"))

    return files.select("path", "content").mapInPandas(run, "path string, plane int, w int, h int, depth int, samples array<int>, error string")
