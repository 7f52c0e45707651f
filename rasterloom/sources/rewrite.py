"""Rewrites of a container that keep every frame: they are tried in rounds, and one is kept only if the container shrinks and
decodes to the same frames. The proof is the decoder's; a rewrite itself is never trusted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import container as c
from . import decode

ROUNDS = 512


def parts(data: bytes, magic: bytes = c.MAGIC) -> tuple[list[int], list[tuple], list[tuple]]:
    """Size and features, records and groups."""
    head, records, groups = [], [], []
    for n, tag, t, args, body, _, _ in c.read(data, magic):
        if n == 0:
            head = args
        elif t is None:
            records.append((tag, args, body))
        elif tag == c.GROUP:
            groups.append((t, []))
        else:
            groups[-1][1].append((tag, args, body))
    return head, records, groups


def merged_duplicates(records: list[tuple], groups: list[tuple]) -> Iterator[tuple]:
    """Objects of equal content become the first of them."""
    first, keeps, out = {}, {}, []
    for tag, args, body in records:
        if tag in (c.RASTER, c.FILL, c.INDEX, c.GENERATOR, c.EXTERNAL):
            keeps[args[0]] = first.setdefault((tag, tuple(args[1:]), body), args[0])
            if keeps[args[0]] != args[0]:
                continue
        elif tag in (c.CHECKPOINT, c.CHECKPOINT_BOUND):
            width, args = 4 if tag == c.CHECKPOINT else 5, list(args)
            args[2::width] = [keeps[o] for o in args[2::width]]
        out.append((tag, args, body))
    if len(out) < len(records):
        yield out, [(t, [(tag, [a[0], keeps[a[1]], *a[2:]] if tag == 0x21 else a, b) for tag, a, b in g]) for t, g in groups]


def programs_for_rasters(records: list[tuple], groups: list[tuple]) -> Iterator[tuple]:
    """Rasters of at least 32 samples that are a ramp or a checkerboard become the program."""
    out = list(records)
    for i, (tag, args, body) in enumerate(records):
        if tag != c.RASTER or len(body) < 32 or min(args[1:3]) < 2:
            continue
        s = np.frombuffer(body, np.uint8).reshape(args[2], args[1]).astype(int)
        tries = [(0, [int(s[0, 0]), int((s[0, 1] - s[0, 0]) % 256), int((s[1, 0] - s[0, 0]) % 256)])]
        tries += [(1, [int(s[0, 0]), int(s[0, k]), k]) for k in (1, 2, 4, 8, 16, 32) if k < args[1]]
        for kind, program in tries:
            if (decode.generated(kind, program, args[1], args[2]) == s).all():
                out[i] = (c.GENERATOR, [*args, kind, *program], b"")
                break
    if out != records:
        yield out, groups


def velocities_for_placements(records: list[tuple], groups: list[tuple]) -> Iterator[tuple]:
    """Runs of at least three groups that place one instance at even steps become one velocity and advances."""
    at = 0
    while at < len(groups):
        end = at
        while end < len(groups) and len(groups[end][1]) == 1 and groups[end][1][0][0] == 0x22 and groups[end][1][0][1][0] == (groups[at][1][0][1][0] if groups[at][1] else None):
            end += 1
        for length in range(end - at, 2, -1):
            spots = [g[1][0][1][1:] for g in groups[at : at + length]]
            step = [spots[1][0] - spots[0][0], spots[1][1] - spots[0][1]]
            if any([b[0] - a[0], b[1] - a[1]] != step for a, b in zip(spots, spots[1:])):
                continue
            iid = groups[at][1][0][1][0]
            run = [(groups[at][0], [groups[at][1][0], (0x26, [iid, *step], b"")])] + [(t, [(0x27, [], b"")]) for t, _ in groups[at + 1 : at + length]]
            rest = groups[at + length :]
            if rest:
                run_rest = [(rest[0][0], [(0x26, [iid, 0, 0], b""), *rest[0][1]]), *rest[1:]]
                yield records, groups[:at] + run + run_rest
            yield records, groups[:at] + run + rest
            break
        at = max(end, at + 1)


def segments_of(spots: list[tuple[int, int]]) -> list[int] | None:
    """Operands of the cheapest program through positions, the one before the first included: one linear segment, one accelerated
    segment, or a linear one for each run of even steps; of equals the first."""
    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(spots, spots[1:])]
    turns = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(steps, steps[1:])]
    runs: list[list[int]] = []
    for x, y in steps:
        if runs and runs[-1][1:3] == [x, y]:
            runs[-1][3] += 1
        else:
            runs.append([0, x, y, 1])
    tries = [runs] if len(runs) == 1 else []
    if turns and len(set(turns)) == 1 and turns[0] != (0, 0):
        tries.append([[1, *steps[0], *turns[0], len(steps)]])
    if len(runs) > 1:
        tries.append(runs)
    size = lambda program: sum(len(c.transition(c.TRAJECTORY, [0, *s], b"")) for s in program)
    best = min(tries, key=size, default=None)
    return None if best is None else [v for s in best for v in s]


def programs_for_placements(records: list[tuple], groups: list[tuple]) -> Iterator[tuple]:
    """A maximal run of at least three groups that each only place one instance, which has no velocity or program, becomes a program
    that is advanced, where that takes fewer bytes."""
    scene = decode.Scene(1, 1)
    for r in records:
        scene.declare(*r)
    at = 0
    while at < len(groups):
        end, own = at, groups[at][1]
        if len(own) == 1 and own[0][0] == 0x22:
            iid = own[0][1][0]
            while end < len(groups) and len(groups[end][1]) == 1 and groups[end][1][0][0] == 0x22 and groups[end][1][0][1][0] == iid:
                end += 1
            if end - at >= 3 and iid not in scene.motion:
                spots = [tuple(scene.instances[iid][1:])] + [tuple(g[1][0][1][1:]) for g in groups[at:end]]
                program = segments_of(spots)
                if program and 14 * (end - at) + len(c.transition(c.TRAJECTORY, [iid, *program], b"")) + 1 < 26 * (end - at):
                    run = [(groups[at][0], [(c.TRAJECTORY, [iid, *program], b""), (0x2C, [], b"")])] + [(t, [(0x2C, [], b"")]) for t, _ in groups[at + 1 : end]]
                    yield records, groups[:at] + run + groups[end:]
        for _, transitions in groups[at : max(end, at + 1)]:
            for x in transitions:
                scene.apply(*x)
        at = max(end, at + 1)


def patches_for_residuals(records: list[tuple], groups: list[tuple]) -> Iterator[tuple]:
    """A residual that two or more groups in a row repeat becomes one lasting patch and empty groups."""
    from ..operators import codec

    at = 0
    while at < len(groups):
        end = at + 1
        own = groups[at][1]
        if len(own) == 1 and own[0][0] == 0x2A:
            while end < len(groups) and groups[end][1] == own:
                end += 1
            if end - at > 1:
                points = np.frombuffer(codec.unblock(own[0][2]), np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "u1")]))
                patch = (0x23, [int(v) for p in points for v in p], b"")
                rest = groups[end:]
                if rest:
                    rest = [(rest[0][0], [(0x29, [], b""), *rest[0][1]]), *rest[1:]]
                yield records, groups[:at] + [(groups[at][0], [patch])] + [(t, []) for t, _ in groups[at + 1 : end]] + rest
        at = end


REWRITES = (velocities_for_placements, programs_for_placements, patches_for_residuals, programs_for_rasters, merged_duplicates)


def collapsed(data: bytes, magic: bytes = c.MAGIC) -> bytes:
    """The container with programs in place of placements, as far as that pays. One with palettes stays as it is."""
    if any(tag in (c.PALETTE, c.CHECKPOINT_BOUND) for tag, _, _ in parts(data, magic)[1]):
        return data
    return optimized(data, magic, (programs_for_placements,), 256)


def optimized(data: bytes, magic: bytes = c.MAGIC, rewrites: tuple = REWRITES, rounds: int = ROUNDS) -> bytes:
    """The container after as many rewrites as pay and are proved, one a round."""
    frames = list(decode.decode(data, magic))
    for _ in range(rounds):
        head, records, groups = parts(data, magic)
        for rewrite in rewrites:
            for tried in rewrite(records, groups):
                try:
                    new = c.write(head[0], head[1], *tried, features=head[2], magic=magic)
                    same = len(new) < len(data) and all((a == b).all() for a, b in zip(frames, decode.decode(new, magic), strict=True))
                except (c.Breach, ValueError):
                    continue
                if same:
                    break
            else:
                continue
            data = new
            break
        else:
            break
    return data


def optimize(files: DataFrame, magic: bytes = c.MAGIC, rewrite=optimized) -> DataFrame:
    """`binaryFile` rows (path, content) with the rewritten container: path, before, after, content, error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    new = rewrite(bytes(data), magic)
                    rows.append((path, len(data), len(new), new, None))
                except c.Breach as e:
                    rows.append((path, len(data), None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "before", "after", "content", "error"]).astype({"after": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, before long, after long, content binary, error string")
