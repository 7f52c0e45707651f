"""Global motion: the search by bounds decides as one that looks at every displacement; queries spread over tasks."""

import numpy as np
import pytest
from rasterloom.operators import motion
from rasterloom.plans import catalog, pictures

SF = "/root/testdata/sf0.001"


def every(a, b, cx, cy, reach):
    """(dx, dy) of the least mean, by looking at all of them in turn."""
    (h, w), best = b.shape, None
    x, y = motion.grid(w, h)
    for dy in range(cy - reach, cy + reach + 1):
        for dx in range(cx - reach, cx + reach + 1):
            ok = (x + dx >= 0) & (y + dy >= 0) & (x + dx < w) & (y + dy < h)
            if ok.any():
                mean = np.abs(a[y[ok] + dy, x[ok] + dx] - b[y[ok], x[ok]]).sum() / ok.sum()
                if best is None or mean < best[0]:
                    best = mean, dx, dy
    return best[1:]


@pytest.mark.parametrize("size", [(1, 1), (2, 3), (1, 40), (31, 33), (48, 64), (10, 900), (150, 90)])
def test_nearest(size):
    rng = np.random.default_rng(sum(size))
    a = rng.integers(0, 256, size)
    for b in (a, a * 0, np.roll(a, (1, -2), (0, 1)), rng.integers(0, 2, size)):
        for one in (a, a // 128, a * 0):
            assert motion._nearest(one, b, 0, 0, 5) == every(one, b, 0, 0, 5)
            assert motion._nearest(one, b, 1, -1, 1) == every(one, b, 1, -1, 1)


def test_few_displacements_are_looked_at_sample_by_sample():
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and all(isinstance(s, slice) and s.start is not None for s in at):
                looked.append(at)
            return super().__getitem__(at)

    a, b = (v.astype(np.int64) for v in pictures._pair(5))
    assert motion._nearest(a.view(Counted), b, 0, 0, 24) == (5 % 9 - 4, 5 % 7 - 3)
    assert 0 < len(looked) < 49 * 49 // 20


def test_each_pair_is_proposed_for_once(spark, monkeypatch):
    a, b = pictures._turned(3)
    found = motion.proposals(a, b)
    want = motion.priced(a, b)
    monkeypatch.setattr(motion, "proposals", None)
    assert motion.priced(a, b, 8, found) == want


@pytest.mark.parametrize("name", ["o7_14_estimate_global", "o7_13_refined_maps", "o10_8_collapse"])
def test_suppliers_are_dealt_over_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4
