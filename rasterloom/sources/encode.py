"""From frames to a container: for each frame every family proposes transitions, the cheapest that the decoder proves wins.

A price is the number of bytes that the group and its new declarations take. Proposals are sorted by price and then by the order
of FAMILIES; the first whose transitions make exactly the frame is taken. A stream's frames depend on one another, so a stream is
one task's work; streams are apart.
"""

from __future__ import annotations

from collections import ChainMap, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import codec, compare, govern
from . import container as c
from . import decode

# Families in the order in which equal prices are settled.
FAMILIES = (
    "unchanged", "fill", "clear_instances", "clear_overlay", "sparse", "residual", "rans_residual", "transform_residual", "raw", "exact_ref",
    "generator", "generator_residual", "prev_diff", "copy_rect", "copy_residual", "translation", "regions",
)
#: What searches for proposals, in this order, and the families that each may propose.
PROPOSERS = {
    "simple": {"unchanged", "fill", "clear_instances", "clear_overlay"},
    "whole": {"raw", "exact_ref"},
    "moved": {"translation"},
    "generated": {"generator", "generator_residual"},
    "tiled": {"regions"},
    "points": {"sparse", "residual", "rans_residual", "transform_residual"},
    "copied": {"prev_diff", "copy_rect", "copy_residual"},
}
# Bytes of an empty group; most overlay points; most cells of a region change, and sides of cells; reach of a
# translation; share of a program's misses.
GROUP, OVERLAY_CAP, MOST_CELLS, CELLS, REACH, MISSES = 13, 1 << 20, 256, (64, 32, 16, 8), 2, 16
PERIODS, CHECKS = (2, 4, 8, 16, 32, 64, 128, 256), (1, 2, 4, 8, 16, 32)
SCROLL = 3
#: Transitions that leave the instances there are as they are.
ADDING = {0x21, 0x23, 0x24, 0x29, 0x2A}


@dataclass
class Proposal:
    family: str
    payload: int
    transitions: list[tuple]
    objects: list[tuple] = field(default_factory=list)  # contents that are not yet declared, by the ids the transitions use

    @property
    def rank(self) -> tuple[int, int]:
        return self.payload, FAMILIES.index(self.family)


@dataclass
class Decision:
    frame: int
    family: str
    payload: int
    proposals: int
    prices: dict[str, int]  # the least price of each family that proposed


def programs(target: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Generators that some samples of a field speak for; whether they render it is for the caller to see."""
    h, w = target.shape
    if min(h, w) < 2:
        return
    s = target.astype(int)
    sx, sy = int(s[0, 1] - s[0, 0]) % 256, int(s[1, 0] - s[0, 0]) % 256
    if sx or sy:
        yield 0, [int(s[0, 0]), sx, sy]
    for k in CHECKS:
        if k < min(h, w) and s[0, 0] != s[0, k]:
            yield 1, [int(s[0, 0]), int(s[0, k]), k]
    for p in PERIODS:
        if p < min(h, w) and (sx or sy) and s[0, p] == s[0, 0] == s[p, 0]:
            yield 2, [int(s[0, 0]), sx, sy, p]


def content(samples: np.ndarray) -> tuple:
    """(tag, arguments after the id, data) of an object of these samples."""
    h, w = samples.shape
    if (samples == samples[0, 0]).all():
        return c.FILL, (w, h, int(samples[0, 0])), b""
    return c.RASTER, (w, h), samples.tobytes()


def declaration(one: tuple) -> int:
    return len(c.record(one[0], [0, *one[1]], one[2]))


def group_bytes(transitions: list[tuple]) -> int:
    return GROUP + sum(len(c.transition(*x)) for x in transitions)


def least_block(n: int, data: np.ndarray) -> int:
    """Bytes that a block of n bytes has at least, by the entropy of its bytes."""
    p = np.bincount(data, minlength=256) / max(1, n)
    p = p[p > 0]
    return 9 + min(n, 512 + int(-n * (p * np.log2(p)).sum() / 8))


class Governor:
    """What the last winners say about where to search: the same rules as govern.family_plans(), frame by frame."""

    def __init__(self):
        self.ring: deque[tuple[str, int]] = deque(maxlen=govern.RING)
        self.seen, self.broaden = 0, True

    def plan(self) -> dict[str, str]:
        if self.broaden:
            return dict.fromkeys(govern.MODES, "full")
        active = {family for family, _ in self.ring}
        out = {}
        for mode in govern.MODES:
            families, how = govern.TRUSTED_BY.get(mode, ((), "off"))
            swept = govern.SWEPT.get(mode, "off") if self.seen % govern.SWEEP == 0 else "off"
            out[mode] = how if active & set(families) else swept
        return out

    def observe(self, family: str, payload: int) -> None:
        novel = bool(self.ring) and family not in {f for f, _ in self.ring}
        self.ring.append((family, payload))
        payloads = sorted(p for _, p in self.ring)
        median = payloads[len(payloads) // 2]
        self.broaden = novel or len(payloads) >= govern.SLEW_RING and median > 0 and payload > govern.SLEW * median
        self.seen += 1


class Encoder:
    """With `guided` each frame is searched as the governor plans, else in full. A plan never decides what is exact or cheapest.

    What follows from a frame, the one before and what is painted alone is kept in `shared` while the frame is encoded: encoders of
    other backgrounds that go frame by frame with this one have the same.
    """

    def __init__(self, frames: list[np.ndarray], background: int = 0, families: tuple[str, ...] = FAMILIES, overlay_cap: int = OVERLAY_CAP, guided: bool = False, shared: dict | None = None):
        self.shared = {} if shared is None else shared
        self.frames, self.families, self.cap = frames, families, overlay_cap
        self.governor = Governor() if guided else None
        self.plan = dict.fromkeys(govern.MODES, "full")
        self.height, self.width = frames[0].shape
        self.scene = decode.Scene(self.width, self.height)
        self.scene.background = background
        self.ids: dict[tuple, int] = {}
        self.records: list[tuple] = []
        self.groups: list[tuple] = []
        self.decisions: list[Decision] = []
        self.next_instance = 1

    def once(self, name: str, of: np.ndarray | None, make: Callable):
        key = name if of is None else (name, of.tobytes())
        if key not in self.shared:
            self.shared[key] = make()
        return self.shared[key]

    # what proposals are made of

    def price(self, contents: list[tuple]) -> int:
        return sum(declaration(x) for x in dict.fromkeys(contents) if x not in self.ids)

    def placed(self, spots: list[tuple[tuple, int, int]]) -> tuple[list[tuple], list[tuple], int]:
        """Transitions that create an instance of each content at its spot, the new contents and their price."""
        new = [x for x in dict.fromkeys(s[0] for s in spots) if x not in self.ids]
        ids = {x: len(self.ids) + 1 + i for i, x in enumerate(new)}
        out = [(0x21, [self.next_instance + i, ids.get(x) or self.ids[x], px, py], b"") for i, (x, px, py) in enumerate(spots)]
        return out, new, self.price(new)

    def reset(self, family: str, one: tuple, more: list[tuple] | None = None) -> Proposal:
        """Everything goes and one object covers the canvas."""
        created, new, price = self.placed([(one, 0, 0)])
        transitions = [(0x28, [], b""), (0x29, [], b""), *created, *(more or [])]
        return Proposal(family, group_bytes(transitions) + price, transitions, new)

    def correction(self, base: np.ndarray, target: np.ndarray, best: int, before: int) -> tuple | None:
        """A residual of the differing points, unless it can't come below `best` with `before` bytes besides."""
        x, y, v, least = self.once("points", base, lambda: self._points(base, target))
        if before + 5 + least > best:
            return None
        return 0x2A, [], self.once("correction", base, lambda: codec.point_block(x, y, v))

    def _points(self, base: np.ndarray, target: np.ndarray) -> tuple:
        """Differing points and the least bytes of their block."""
        y, x = np.nonzero(base != target)
        points = np.zeros(len(x), codec.POINT)
        points["x"], points["y"], points["v"] = x, y, target[y, x]
        return x, y, points["v"], least_block(points.nbytes, points.view(np.uint8))

    # families: each gives proposals that make the frame, given the cheapest price so far

    def simple(self, target, base, prev, best) -> Iterator[Proposal]:
        if (target == base).all():
            yield Proposal("unchanged", GROUP, [])
            return
        state = self.scene
        if self.plan["clears"] == "off":
            return
        if (target == state.background).all():
            yield Proposal("fill", GROUP + 2, [(0x28, [], b""), (0x29, [], b"")])
        if state.instances:
            yield from self._cleared("clear_instances", (0x28, [], b""), target)
        if state.overlay:
            yield from self._cleared("clear_overlay", (0x29, [], b""), target)

    def _cleared(self, family: str, transition: tuple, target: np.ndarray) -> Iterator[Proposal]:
        # either clears the instances, or leaves them alone
        after = self.scene.copy(self.scene.objects, {} if transition[0] == 0x28 else self.scene.instances)
        after.apply(*transition)
        if (after.painted() == target).all():
            yield Proposal(family, GROUP + 1, [transition])

    def points(self, target, base, prev, best) -> Iterator[Proposal]:
        y, x = self.once("changed", base, lambda: np.nonzero((base != target).T)[::-1])  # in rising order of x, then y
        if not len(x):
            return
        if len(self.scene.overlay) + len(x) <= self.cap:
            yield Proposal("sparse", GROUP + 5 + 9 * len(x), [(0x23, self.once("patch", base, lambda: np.column_stack([x, y, target[y, x]]).ravel().tolist()), b"")])
        if fix := self.correction(base, target, best, GROUP):
            yield Proposal("rans_residual" if fix[2][0] else "residual", group_bytes([fix]), [fix])
        mask = codec.mask_bytes(self.width, self.height)
        if self.plan["transform"] == "off" or self.plan["transform"] == "probe" and 16 * len(x) < target.size:
            return
        if 9 * len(x) >= mask + 64 and GROUP + 5 + 2 + mask + 8 + 18 < best:
            fix = (0x2A, [], self.once("transform", base, lambda: codec.transform_block(base, target)))
            yield Proposal("transform_residual", group_bytes([fix]), [fix])

    def whole(self, target, base, prev, best) -> Iterator[Proposal]:
        one = content(target)
        yield self.reset("exact_ref" if one in self.ids else "raw", one)

    def generated(self, target, base, prev, best) -> Iterator[Proposal]:
        rendered = lambda: [(kind, args, made := decode.generated(kind, args, self.width, self.height), int((made != target).sum())) for kind, args in programs(target)]
        for kind, args, made, misses in self.once("programs", None, rendered) if self.plan["generators"] != "off" else ():
            if kind and self.plan["generators"] == "probe":
                continue
            one = (c.GENERATOR, (self.width, self.height, kind, *args), b"")
            if not misses:
                yield self.reset("generator", one)
            elif misses * MISSES <= target.size:
                plain = self.reset("generator", one)
                if fix := self.correction(made, target, best, plain.payload):
                    yield self.reset("generator_residual", one, [fix])

    def copied(self, target, base, prev, best) -> Iterator[Proposal]:
        w, h = self.width, self.height
        everything = (0x24, [0, 0, w, h, 0, 0], b"")
        if (prev == target).all():
            yield Proposal("prev_diff", group_bytes([everything]), [everything])
        elif fix := self.correction(prev, target, best, GROUP + 25):
            yield Proposal("prev_diff", group_bytes([everything, fix]), [everything, fix])
        if self.plan["copies"] == "off":
            return
        for dx, dy in self.once("wraps", None, lambda: compare.wraps(prev, target)):
            moves = [(0x24, [sx, sy, cw, ch, (sx + dx) % w, (sy + dy) % h], b"") for sx, cw in ((0, w - dx), (w - dx, dx)) for sy, ch in ((0, h - dy), (h - dy, dy)) if cw and ch]
            yield Proposal("copy_rect", group_bytes(moves), moves)
        for dx, dy in [(k, 0) for k in range(-SCROLL, SCROLL + 1) if k] + [(0, k) for k in range(-SCROLL, SCROLL + 1) if k]:
            if abs(dx) >= w or abs(dy) >= h:
                continue
            move = (0x24, [max(0, -dx), max(0, -dy), w - abs(dx), h - abs(dy), max(0, dx), max(0, dy)], b"")
            after, same = self.once(f"scroll {dx} {dy}", base, lambda move=move: ((canvas := decode.on_canvas(base, prev, *move)), bool((canvas == target).all())))
            if same:
                yield Proposal("copy_rect", group_bytes([move]), [move])
            elif fix := self.correction(after, target, best, GROUP + 25):
                yield Proposal("copy_residual", group_bytes([move, fix]), [move, fix])

    def moved(self, target, base, prev, best) -> Iterator[Proposal]:
        scene = self.scene
        if self.plan["translation"] == "off" or len(scene.instances) != 1 or scene.overlay:
            return
        ((iid, (oid, x, y)),) = scene.instances.items()
        if tuple(scene.objects[oid][1][1:3]) != (self.width, self.height):
            return
        own, (h, w) = scene.samples(iid, oid), target.shape
        for dy in range(-REACH, REACH + 1):
            for dx in range(-REACH, REACH + 1):
                px, py = x + dx, y + dy
                x0, y0, x1, y1 = max(0, px), max(0, py), min(w, px + w), min(h, py + h)
                if not (dx or dy) or x0 >= x1 or y0 >= y1 or (target[y0:y1, x0:x1] != own[y0 - py : y1 - py, x0 - px : x1 - px]).any():
                    continue
                there = np.full_like(target, scene.background)
                there[y0:y1, x0:x1] = target[y0:y1, x0:x1]
                if (there == target).all():
                    yield Proposal("translation", GROUP + 13, [(0x22, [iid, px, py], b"")])

    def tiled(self, target, base, prev, best) -> Iterator[Proposal]:
        changed = base != target
        if not changed.any() or any(changed[y, x] for x, y in self.scene.overlay if 0 <= x < self.width and 0 <= y < self.height):
            return
        for side in {"off": (), "probe": CELLS[2:3], "full": CELLS}[self.plan["regions"]]:
            spots = self.once(f"cells {side}", base, lambda side=side: self._spots(changed, target, side))
            if spots is None:
                continue
            created, new, price = self.placed(spots)
            yield Proposal("regions", group_bytes(created) + price, created, new)

    def _spots(self, changed: np.ndarray, target: np.ndarray, side: int) -> list[tuple] | None:
        """Contents and places of the cells that change, unless they are too many."""
        ys, xs = np.nonzero(changed)
        across = -(-self.width // side)
        cells = np.unique(ys // side * across + xs // side)
        if len(cells) > min(MOST_CELLS, max(1, target.size // 4)):
            return None
        return [(content(np.ascontiguousarray(target[y * side : (y + 1) * side, x * side : (x + 1) * side])), x * side, y * side) for y, x in (divmod(k, across) for k in cells.tolist())]

    # the court

    def made(self, transitions: list[tuple], objects: list[tuple], prev: np.ndarray) -> tuple[decode.Scene, np.ndarray]:
        new = {len(self.ids) + 1 + k: (tag, [0, *args], data) for k, (tag, args, data) in enumerate(objects)}
        tags = [x[0] for x in transitions]
        # instances add up over a stream: they are not copied where they all go or others only come on top
        own = {} if tags[:1] == [0x28] else ChainMap({}, self.scene.instances) if ADDING.issuperset(tags) else None
        after = self.scene.copy(ChainMap(new, self.scene.objects) if new else self.scene.objects, own)
        late = [x for x in transitions if not after.apply(*x)]
        canvas = after.painted()
        for x in late:
            canvas = decode.on_canvas(canvas, prev, *x)
        return after, canvas

    def step(self, n: int, target: np.ndarray, prev: np.ndarray) -> np.ndarray:
        base, found, best = self.scene.painted(), [], 1 << 62
        if self.governor:
            self.plan = self.governor.plan()
        for search, gives in PROPOSERS.items():
            if not gives & set(self.families):
                continue
            for p in getattr(self, search)(target, base, prev, best):
                if p.family in self.families:
                    found.append(p)
                    best = min(best, p.payload)
            if best == GROUP:
                break  # nothing is cheaper than an empty group
        for p in sorted(found, key=lambda p: p.rank):
            after, canvas = self.made(p.transitions, p.objects, prev)
            if (canvas == target).all():
                break
        else:
            raise c.Breach("no family makes the frame")
        self.declare(p.objects)
        after.objects = self.scene.objects
        if isinstance(after.instances, ChainMap):
            added, after.instances = after.instances.maps
            after.instances.update(added)
        self.scene = after
        self.next_instance = max([self.next_instance - 1, *(x[1][0] for x in p.transitions if x[0] == 0x21)]) + 1
        self.groups.append((n, p.transitions))
        prices: dict[str, int] = {}
        for q in found:
            prices[q.family] = min(q.payload, prices.get(q.family, q.payload))
        if self.governor:
            self.governor.observe(p.family, p.payload)
        self.decisions.append(Decision(n, p.family, p.payload, len(found), prices))
        return canvas

    def declare(self, objects: list[tuple]) -> None:
        for one in objects:
            self.ids[one] = oid = len(self.ids) + 1
            self.records.append((one[0], [oid, *one[1]], one[2]))
            self.scene.objects[oid] = (one[0], [oid, *one[1]], one[2])

    def begin(self) -> np.ndarray:
        """Encodes the first frame."""
        first, start = self.frames[0], []
        if not (first == self.scene.background).all():
            tries = [content(first)]
            if "generator" in self.families:
                tries += [(c.GENERATOR, (self.width, self.height, kind, *args), b"") for kind, args in programs(first) if (decode.generated(kind, args, self.width, self.height) == first).all()]
            one = min(tries, key=declaration)
            self.declare([one])
            start = [self.next_instance, 1, 0, 0]
            self.scene.instances[self.next_instance] = [1, 0, 0]
            self.next_instance += 1
        self.checkpoint = (c.CHECKPOINT, [self.scene.background, *start], b"")
        return first

    def run(self) -> int:
        """Encodes all frames; bytes of the container."""
        canvas = self.begin()
        for n, target in enumerate(self.frames[1:], 1):
            self.shared.clear()
            canvas = self.step(n, target, canvas)
        return self.size()

    def size(self) -> int:
        """Bytes of the container."""
        return len(c.header(1, 1)) + sum(len(c.record(*r)) for r in [*self.records, self.checkpoint]) + sum(group_bytes(g) for _, g in self.groups) + 32

    def container(self, features: int = 0) -> bytes:
        """The container, decoded as a proof."""
        out = c.write(self.width, self.height, [*self.records, self.checkpoint], self.groups, features)
        if not all((a == b).all() for a, b in zip(self.frames, decode.decode(out), strict=True)):
            raise c.Breach("the container does not decode to the frames")
        return out


def backgrounds(frames: list[np.ndarray]) -> list[int]:
    """Black, white, the corners of the first frame and the most frequent sample of all (the least of several)."""
    first = frames[0]
    counts = sum(np.bincount(f.ravel(), minlength=256) for f in frames)
    return sorted({0, 255, int(counts.argmax()), *(int(first[y, x]) for y in (0, -1) for x in (0, -1))})


def swept(frames: list[np.ndarray], families: tuple[str, ...] = FAMILIES, features: int = 0, guided: bool = False) -> tuple[bytes, Encoder]:
    """The smallest of the containers of all candidate backgrounds, the first of equals, and its encoder."""
    shared: dict = {}
    tries = [Encoder(frames, b, families, guided=guided, shared=shared) for b in backgrounds(frames)]
    canvases = [t.begin() for t in tries]
    for n, target in enumerate(frames[1:], 1):
        shared.clear()
        canvases = [t.step(n, target, canvas) for t, canvas in zip(tries, canvases)]
    best = min(tries, key=Encoder.size)  # the first of equals
    return best.container(features), best


def _frames(pdf: pd.DataFrame) -> list[np.ndarray]:
    pdf = pdf.sort_values("frame")
    return [np.frombuffer(s, np.uint8).reshape(h, w) for s, w, h in zip(pdf["samples"], pdf["w"], pdf["h"])]


def encoded(frames: DataFrame, families: tuple[str, ...] = FAMILIES, features: int = 0, guided: bool = False) -> DataFrame:
    """Packed frames (stream_id, frame, w, h, samples) as containers: path, content, background, decisions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, own = swept(_frames(pdf), families, features, guided)
        rows = [{"frame": d.frame, "family": d.family, "payload": d.payload, "proposals": d.proposals, "prices": d.prices} for d in own.decisions]
        return pd.DataFrame({"path": [str(pdf["stream_id"].iloc[0])], "content": [data], "background": [own.scene.background], "decisions": [rows]})

    schema = "path string, content binary, background int, decisions array<struct<frame: long, family: string, payload: long, proposals: long, prices: map<string, long>>>"
    spark = frames.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a stream's work is far more than its bytes: few bytes must not put all streams into one task
    return frames.select("stream_id", "frame", "w", "h", "samples").repartition(parts, "stream_id").groupBy("stream_id").applyInPandas(run, schema)
