"""Containers step by step: declarations, instances, then a method for each transition under a time that only rises."""

from __future__ import annotations

from collections import Counter

from . import container as c


class BuildError(ValueError):
    """A step that is out of order or out of range."""


class Builder:
    """Every step is checked when it is made; finish() gives the container. `counts` says how often each step was made."""

    def __init__(self, width: int, height: int, background: int = 0):
        if width < 1 or height < 1:
            raise BuildError("empty canvas")
        if not 0 <= background < 256:
            raise BuildError("sample")
        self.size, self.background = (width, height), background
        self.records: list[tuple] = []
        self.start: list[list[int]] = []
        self.groups: list[tuple[int, list[tuple]]] = []
        self.known: set[int] = set()
        self.palettes: dict[int, int] = {}
        self.live: set[int] = set()
        self.counts: Counter = Counter()

    # declarations

    def _declare(self, tag: int, args: list[int], data: bytes = b"") -> Builder:
        if self.groups:
            raise BuildError("declaration after the first group")
        if args[0] in self.known:
            raise BuildError("object twice")
        if min(args[1:3]) < 1:
            raise BuildError("empty object")
        self.known.add(args[0])
        self.records.append((tag, args, data))
        self.counts["objects"] += 1
        return self

    def fill(self, oid: int, width: int, height: int, value: int) -> Builder:
        if not 0 <= value < 256:
            raise BuildError("sample")
        return self._declare(c.FILL, [oid, width, height, value])

    def raster(self, oid: int, width: int, height: int, samples: bytes, indexed: bool = False) -> Builder:
        if len(samples) != width * height:
            raise BuildError("sample count")
        return self._declare(c.INDEX if indexed else c.RASTER, [oid, width, height], samples)

    def program(self, oid: int, width: int, height: int, kind: int, args: list[int]) -> Builder:
        if kind not in c.GENERATORS or len(args) != len(c.GENERATORS[kind]):
            raise BuildError("generator")
        return self._declare(c.GENERATOR, [oid, width, height, kind, *args])

    def palette(self, pid: int, entries: bytes) -> Builder:
        if self.groups or pid in self.palettes or not 0 < len(entries) <= 256 or not pid:
            raise BuildError("palette")
        self.palettes[pid] = len(entries)
        self.records.append((c.PALETTE, [pid], entries))
        self.counts["palettes"] += 1
        return self

    def instance(self, iid: int, oid: int, x: int, y: int, palette: int = 0) -> Builder:
        if self.groups:
            raise BuildError("declaration after the first group")
        self._create(iid, oid, x, y)
        if palette and palette not in self.palettes:
            raise BuildError("unknown palette")
        self.start.append([iid, oid, x, y, palette])
        self.counts["instances"] += 1
        return self

    def _create(self, iid: int, oid: int, x: int, y: int) -> None:
        if iid in self.live:
            raise BuildError("instance twice")
        if oid not in self.known:
            raise BuildError("unknown object")
        self._spot(x, y)
        self.live.add(iid)

    def _spot(self, *values: int) -> None:
        if any(abs(v) > c.LARGEST for v in values):
            raise BuildError("coordinate out of range")

    # time and transitions

    def at(self, t: int) -> Builder:
        """Opens the group of time t, or goes on with it."""
        if t < 1 or self.groups and t < self.groups[-1][0]:
            raise BuildError("time does not rise")
        if not self.groups or t > self.groups[-1][0]:
            self.groups.append((t, []))
        return self

    def _push(self, name: str, tag: int, args: list[int], data: bytes = b"", of: int | None = None) -> Builder:
        if not self.groups:
            raise BuildError("transition before the first time")
        if of is not None and of not in self.live:
            raise BuildError("unknown instance")
        self.groups[-1][1].append((tag, args, data))
        self.counts[name] += 1
        return self

    def create(self, iid: int, oid: int, x: int, y: int) -> Builder:
        if self.groups:
            self._create(iid, oid, x, y)
        return self._push("create", 0x21, [iid, oid, x, y])

    def move(self, iid: int, x: int, y: int) -> Builder:
        self._spot(x, y)
        return self._push("move", 0x22, [iid, x, y], of=iid)

    def patch(self, points: list[tuple[int, int, int]]) -> Builder:
        if any(a[:2] >= b[:2] for a, b in zip(points, points[1:])):
            raise BuildError("points do not rise")
        return self._push("patch", 0x23, [v for p in points for v in p])

    def copy(self, sx: int, sy: int, w: int, h: int, dx: int, dy: int) -> Builder:
        return self._push("copy", 0x24, [sx, sy, w, h, dx, dy])

    def shift(self, sx: int, sy: int, w: int, h: int, dx: int, dy: int) -> Builder:
        return self._push("shift", 0x25, [sx, sy, w, h, dx, dy])

    def velocity(self, iid: int, vx: int, vy: int) -> Builder:
        self._spot(vx, vy)
        return self._push("velocity", 0x26, [iid, vx, vy], of=iid)

    def advance(self) -> Builder:
        return self._push("advance", 0x27, [])

    def clear_instances(self) -> Builder:
        self._push("clear_instances", 0x28, [])
        self.live.clear()
        return self

    def clear_overlay(self) -> Builder:
        return self._push("clear_overlay", 0x29, [])

    def residual(self, block: bytes) -> Builder:
        return self._push("residual", 0x2A, [], block)

    def trajectory(self, iid: int, segments: list[list[int]]) -> Builder:
        """Segments (0, vx, vy, steps) or (1, vx, vy, ax, ay, steps); none takes the program away."""
        for s in segments:
            if s[0] not in c.SEGMENTS or len(s) != 1 + len(c.SEGMENTS[s[0]]) or s[-1] < 1 or s[0] == 1 and list(s[3:5]) == [0, 0]:
                raise BuildError("segment")
        if any(a[0] == b[0] == 0 and list(a[1:3]) == list(b[1:3]) for a, b in zip(segments, segments[1:])):
            raise BuildError("segments to be merged")
        return self._push("trajectory", c.TRAJECTORY, [iid, *(v for s in segments for v in s)], of=iid)

    def advance_programs(self) -> Builder:
        return self._push("advance_programs", 0x2C, [])

    def set_palette(self, pid: int, entries: bytes) -> Builder:
        if not pid or not 0 < len(entries) <= 256:
            raise BuildError("palette")
        self._push("set_palette", 0x2D, [pid], entries)
        self.palettes[pid] = len(entries)
        return self

    def patch_palette(self, pid: int, changes: list[tuple[int, int]]) -> Builder:
        if any(a[0] >= b[0] for a, b in zip(changes, changes[1:])) or any(i >= self.palettes.get(pid, 0) for i, _ in changes):
            raise BuildError("palette index")
        return self._push("patch_palette", 0x2E, [pid, *(v for ch in changes for v in ch)])

    def bind(self, iid: int, pid: int) -> Builder:
        if pid and pid not in self.palettes:
            raise BuildError("unknown palette")
        return self._push("bind", 0x2F, [iid, pid], of=iid)

    def affine(self, iid: int, a: int, b: int, x: int, d: int, e: int, y: int) -> Builder:
        self._spot(a, b, x, d, e, y)
        return self._push("affine", 0x30, [iid, a, b, x, d, e, y], of=iid)

    def finish(self, magic: bytes = c.MAGIC) -> bytes:
        """The container; checkpoints carry palettes only where there are some."""
        bound = bool(self.palettes) and any(tag == c.PALETTE for tag, _, _ in self.records)
        rows = [v for i in self.start for v in (i if bound else i[:4])]
        checkpoint = (c.CHECKPOINT_BOUND if bound else c.CHECKPOINT, [self.background, *rows], b"")
        ordered = sorted(self.records, key=lambda r: r[0] == c.PALETTE)
        return c.write(*self.size, [*ordered, checkpoint], self.groups, magic=magic)
