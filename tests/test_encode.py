"""The encoder does what depends on frames alone once for all backgrounds, and decides as encoders of one background each."""

import numpy as np
import pytest
from rasterloom.operators import compare
from rasterloom.plans import movies
from rasterloom.sources import decode, encode


@pytest.mark.parametrize("kind", range(len(movies.KINDS)))
def test_backgrounds_share_work_not_decisions(kind):
    frames = movies.movie(kind, 30 + kind)
    data, best = encode.swept(frames)
    alone = [encode.Encoder(frames, b) for b in encode.backgrounds(frames)]
    sizes = [e.run() for e in alone]
    first = alone[sizes.index(min(sizes))]
    assert best.decisions == first.decisions and data == first.container()


def test_work_of_frames_is_done_once(monkeypatch):
    frames, tried, plain = movies.movie(11, 25), [], compare.wraps
    monkeypatch.setattr(compare, "wraps", lambda a, b: tried.append(1) or plain(a, b))
    assert len(encode.backgrounds(frames)) > 2
    encode.swept(frames)
    assert len(tried) == len(frames) - 1


def test_families_that_may_not_win_are_not_searched(monkeypatch):
    monkeypatch.setattr(encode.Encoder, "copied", None)
    monkeypatch.setattr(encode.Encoder, "points", None)
    assert {d.family for d in encode.swept(movies.movie(4, 4), ("raw", "exact_ref"))[1].decisions} == {"raw", "exact_ref"}


def test_objects_are_not_copied_for_each_proposal(monkeypatch):
    """A long stream of ever new frames: the table of its objects must not be copied at every step."""
    from rasterloom.sources import decode

    rng, asked, plain = np.random.default_rng(1), [], decode.Scene.copy
    monkeypatch.setattr(decode.Scene, "copy", lambda self, *a: asked.append(a) or plain(self, *a))
    encode.Encoder([rng.integers(0, 256, (8, 8), dtype=np.uint8) for _ in range(5)]).run()
    assert asked and all(a and a[0] is not None for a in asked)


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (6, 1), (5, 6), (8, 8), (70, 80)])
def test_wraps(size):
    rng, (h, w) = np.random.default_rng(sum(size)), size
    a = rng.integers(0, 3, size)
    both = (w + 1) * (h + 1) <= compare.TORUS
    for before, after in ((a, a), (a, np.roll(a, (1, 2), (0, 1))), (a, np.roll(a, 3, 1)), (a * 0, a * 0), (a // 2, np.roll(a // 2, 1, 0)), (a, 2 - a)):
        want = [(dx, dy) for dx in range(w) for dy in range(h) if (dx or dy) and (both or not (dx and dy)) and (np.roll(before, (dy, dx), (0, 1)) == after).all()]
        assert sorted(compare.wraps(before, after)) == want


def test_instances_that_add_up_are_painted_once(monkeypatch):
    # each frame is a new instance over all the others; painting all of them for each frame grows with the square of the frames
    seen, plain = [], decode.Scene.samples
    monkeypatch.setattr(decode.Scene, "samples", lambda self, iid, oid: seen.append(1) or plain(self, iid, oid))

    def painted(n):
        seen.clear()
        frames = list(np.random.default_rng(3).integers(90, 160, (n, 8, 8)).astype(np.uint8))
        _, best = encode.swept(frames)
        assert {d.family for d in best.decisions} == {"regions"} and len(best.scene.instances) == n
        return len(seen)

    assert painted(80) < 2.5 * painted(40)
