"""Global motion between two pictures: a displacement by a pyramid, then maps refined by damped least squares, then their price.

All of this only proposes. What a map predicts is evaluated in fixed point and what it misses is corrected, so a proposal can
be poor but never wrong.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Reach of the search, coarse steps an axis, least side of a coarse picture, points of the grid, rounds of
# refinement, shares from which and up to which a translation ends the search, fractional bits of maps.
REACH, COARSE, LEAST_SIDE, GRID, ROUNDS, DONE, HOPELESS, PRECISIONS = 64, 24, 32, 4096, 24, 0.98, 0.02, (8, 12, 16)
TRIES = 6
#: Samples of a row whose sums bound their differences.
RUN = 8
# Bytes of a map, of a corrected point, and of the group around them.
MAP, POINT, GROUP = 26, 12, 13


def tolerance(depth: int) -> int:
    """How far a sample may be off and still count as explained."""
    return min(8, max(1, 1 << depth >> 7))


def halved(a: np.ndarray) -> np.ndarray:
    """Means of squares of two, rounded down; an odd edge is left out."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    a = a[:h, :w].astype(np.int64)
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) // 4


def grid_step(width: int, height: int) -> int:
    step = 1
    while -(-width // step) * -(-height // step) > GRID:
        step += 1
    return step


def grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about GRID points, evenly over a picture."""
    step = grid_step(width, height)
    y, x = np.mgrid[0:height:step, 0:width:step]
    return x.ravel(), y.ravel()


def displacement(before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """(dx, dy) with the least mean difference of after(x, y) from before(x + dx, y + dy): coarse pictures are searched widely,
    finer ones by one step around what was found. Of equals the first in rising dy, then dx."""
    levels = [(before.astype(np.int64), after.astype(np.int64))]
    while min(levels[-1][0].shape) // 2 >= LEAST_SIDE:
        levels.append((halved(levels[-1][0]), halved(levels[-1][1])))
    best = (0, 0)
    for level in range(len(levels) - 1, -1, -1):
        unit = 1 << level
        reach = min(COARSE, max(1, -(-REACH // unit))) if level == len(levels) - 1 else 1
        dx, dy = _nearest(*levels[level], best[0] // unit, best[1] // unit, reach)
        best = dx * unit, dy * unit
    return best


def _nearest(a: np.ndarray, b: np.ndarray, cx: int, cy: int, reach: int) -> tuple[int, int]:
    """(dx, dy) within reach of (cx, cy) with the least mean difference over the grid; all displacements are decided. The differences
    of sums over runs of a row are never above those of the samples, so displacements are looked at by rising bounds, until a bound
    is above the least mean."""
    h, w = b.shape
    step = grid_step(w, h)
    own = b[::step, ::step]
    rows, cols = own.shape
    dys, dxs = np.arange(cy - reach, cy + reach + 1), np.arange(cx - reach, cx + reach + 1)
    # grid points inside: from first to end on each axis
    y0, y1 = np.maximum(0, -(dys // step)), np.minimum(rows, (h - 1 - dys) // step + 1)
    x0, x1 = np.maximum(0, -(dxs // step)), np.minimum(cols, (w - 1 - dxs) // step + 1)
    n = np.maximum(0, y1 - y0)[:, None] * np.maximum(0, x1 - x0)[None, :]
    bound = np.full(n.shape, np.inf)
    line = np.arange(rows)
    there = dys[:, None] + line * step
    valid = (there >= 0) & (there < h)
    there = there.clip(0, h - 1)
    for k, dx in enumerate(dxs):
        if x0[k] < x1[k]:
            cuts = np.arange(x0[k], x1[k], RUN)
            ours = np.add.reduceat(own[:, : x1[k]], cuts, axis=1)
            theirs = np.add.reduceat(a[:, x0[k] * step + dx :: step][:, : x1[k] - x0[k]], np.arange(0, x1[k] - x0[k], RUN), axis=1)
            bound[:, k] = (np.abs(theirs[there] - ours).sum(axis=2) * valid).sum(axis=1)
    bound = np.where(n > 0, bound / np.maximum(1, n), np.inf).ravel()
    found = None
    for at in np.argsort(bound, kind="stable").tolist():
        if not np.isfinite(bound[at]) or found is not None and bound[at] > found[0]:
            break
        j, k = divmod(at, len(dxs))
        sy, sx = int(y0[j]) * step + int(dys[j]), int(x0[k]) * step + int(dxs[k])
        source = a[sy::step, sx::step][: y1[j] - y0[j], : x1[k] - x0[k]]
        tried = np.abs(source - own[y0[j] : y1[j], x0[k] : x1[k]]).sum() / n[j, k], at
        if found is None or tried < found:
            found = tried
    j, k = divmod(found[1], len(dxs))
    return int(dxs[k]), int(dys[j])


def explained(before: np.ndarray, after: np.ndarray, dx: int, dy: int, tol: int) -> float:
    """Share of the points inside both pictures that a displacement explains."""
    h, w = before.shape
    x, y = grid(w, h)
    sx, sy = x + dx, y + dy
    inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    if not inside.any():
        return 0.0
    off = np.abs(before[sy[inside], sx[inside]].astype(int) - after[y[inside], x[inside]].astype(int))
    return float((off <= tol).mean())


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x0, y0 = np.floor(x).astype(int).clip(0, a.shape[1] - 2), np.floor(y).astype(int).clip(0, a.shape[0] - 2)
    u, v = x - x0, y - y0
    return (a[y0, x0] * (1 - u) + a[y0, x0 + 1] * u) * (1 - v) + (a[y0 + 1, x0] * (1 - u) + a[y0 + 1, x0 + 1] * u) * v


def refined(before: np.ndarray, after: np.ndarray, start: np.ndarray, similar: bool) -> np.ndarray:
    """Six parameters (a b c, d e f) of a map of after's points into before, from a start, by damped least squares. With `similar`
    it only turns, scales and moves."""
    h, w = before.shape
    x, y = (v.astype(float) for v in grid(w, h))
    a = before.astype(float)
    gy, gx = np.gradient(a)
    own = after[y.astype(int), x.astype(int)].astype(float)
    # one column of `basis` for each free parameter: how it changes the six
    basis = np.eye(6) if not similar else np.array([[1, 0, 0, 0, 1, 0], [0, -1, 0, 1, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1]], float).T
    steer = np.stack([x, y, np.ones_like(x)])

    def residuals(p):
        sx, sy = p[:3] @ steer, p[3:] @ steer
        inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
        return sx, sy, inside, np.where(inside, bilinear(a, sx.clip(0, w - 1), sy.clip(0, h - 1)) - own, 0.0)

    def cost(r):
        return (r[3] ** 2).sum() / max(1, r[2].sum()) if r[2].sum() * 4 >= len(x) else np.inf

    p, damping = start.astype(float), 1e-3
    now = residuals(p)
    for _ in range(ROUNDS):
        sx, sy, inside, r = now
        dx, dy = bilinear(gx, sx.clip(0, w - 1), sy.clip(0, h - 1)) * inside, bilinear(gy, sx.clip(0, w - 1), sy.clip(0, h - 1)) * inside
        jacobian = np.concatenate([dx * steer, dy * steer]).T @ basis
        normal, slope = jacobian.T @ jacobian, jacobian.T @ r
        for _ in range(TRIES):
            step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-9), slope)
            tried = p - basis @ step
            then = residuals(tried)
            if cost(then) < cost(now):
                p, now, damping = tried, then, damping / 4
                break
            damping *= 4
        else:
            break
        if np.abs(basis @ step).max() < 1e-7:
            break
    return p


def fixed(p: np.ndarray, shift: int) -> list[int]:
    """Half rounds away from zero; what doesn't fit saturates."""
    scaled = p * (1 << shift)
    return [int(v) for v in (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).clip(-(1 << 24), 1 << 24)]


def predicted(before: np.ndarray, base: np.ndarray, m: list[int], shift: int) -> np.ndarray:
    """What a map makes of the picture before; a source outside keeps the base."""
    h, w = base.shape
    y, x = np.mgrid[0:h, 0:w]
    sx, sy = (m[0] * x + m[1] * y + m[2]) >> shift, (m[3] * x + m[4] * y + m[5]) >> shift
    inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    out = base.copy()
    out[inside] = before[sy[inside], sx[inside]]
    return out


def proposals(before: np.ndarray, after: np.ndarray, depth: int = 8) -> list[tuple[str, np.ndarray]]:
    """Classes of motion with their parameters. The dearer ones come only where a translation explains neither almost all nor
    almost nothing."""
    dx, dy = displacement(before, after)
    shift = np.array([1, 0, dx, 0, 1, dy], float)
    out = [("translation", shift)]
    share = explained(before, after, dx, dy, tolerance(depth))
    if not HOPELESS < share < DONE:
        return out
    turned = refined(before, after, shift, True)
    return [*out, ("rotzoom", turned), ("affine", refined(before, after, turned, False)), ("affine", refined(before, after, shift, False))]


def priced(before: np.ndarray, after: np.ndarray, depth: int = 8, proposed: list[tuple[str, np.ndarray]] | None = None) -> list[tuple[str, int, int, list[int]]]:
    """(class, fractional bits, bytes, map): the class is chosen at 8 bits, then its precision; of equals the coarser. Bytes are of
    the map and of the points that it misses over the picture before. `proposed` is what proposals() gave, if it is known."""

    def price(p, shift):
        m = fixed(p, shift)
        return GROUP + MAP + 5 + POINT * int((predicted(before, before, m, shift) != after).sum()), m

    tries = [(name, p, *price(p, PRECISIONS[0])) for name, p in proposed or proposals(before, after, depth)]
    name, p, *_ = min(tries, key=lambda t: t[2])
    return sorted(((name, s, *price(p, s)) for s in PRECISIONS), key=lambda t: (t[2], t[1]))


def estimated(pairs: DataFrame) -> DataFrame:
    """Of pairs (stream_id, w, h, before, after): displacement, the share it explains, the classes proposed, the cheapest map with its
    class and precision, and the samples that it and that the translation miss."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (np.frombuffer(v, np.uint8).reshape(r.h, r.w) for v in (r.before, r.after))
                found = proposals(a, b)
                dx, dy = int(found[0][1][2]), int(found[0][1][5])
                name, bits, size, m = priced(a, b, 8, found)[0]
                miss = lambda n, s, a=a, b=b: int((predicted(a, a, n, s) != b).sum())
                rows.append((r.stream_id, dx, dy, explained(a, b, dx, dy, tolerance(8)), list(dict.fromkeys(n for n, _ in found)), name, bits, size, miss(m, bits), miss([256, 0, dx * 256, 0, 256, dy * 256], 8)))
            yield pd.DataFrame(rows, columns=["stream_id", "dx", "dy", "share", "classes", "class", "bits", "bytes", "best_error", "translation_error"])

    schema = "stream_id long, dx int, dy int, share double, classes array<string>, class string, bits int, bytes long, best_error long, translation_error long"
    return pairs.select("stream_id", "w", "h", "before", "after").mapInPandas(run, schema)
