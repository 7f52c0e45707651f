import sys

import numpy as np
import pytest
from rasterloom import __main__ as cli
from rasterloom.sources import build, child, container, decode, rewrite, script


def test_builder_equals_the_script():
    text = "canvas 16 12 background 7 object 1 fill 4 3 200 object 3 raster 2 2 1 2 3 4 instance 1 1 0 0 instance 2 3 3 -1 at 1 velocity 1 2 1 advance at 4 move 2 5 5 trajectory 1 lin 1 0 3 advance_traj at 5 clear_overlay clear_instances"
    b = build.Builder(16, 12, 7).fill(1, 4, 3, 200).raster(3, 2, 2, bytes([1, 2, 3, 4])).instance(1, 1, 0, 0).instance(2, 3, 3, -1)
    b.at(1).velocity(1, 2, 1).advance().at(4).move(2, 5, 5).trajectory(1, [[0, 1, 0, 3]]).at(4).advance_programs().at(5).clear_overlay().clear_instances()
    assert b.finish() == container.write(*script.parse(text))
    assert b.counts["objects"] == 2 and b.counts["move"] == 1
    many = build.Builder(8, 8).raster(1, 2, 1, b"\0\1", indexed=True).palette(5, bytes([9, 8])).program(2, 3, 3, 0, [1, 2, 3]).instance(1, 1, 0, 0, 5)
    many.at(2).create(4, 2, 1, 1).patch([(0, 0, 1), (1, 0, 2)]).copy(0, 0, 2, 2, 4, 4).shift(0, 0, 1, 1, 6, 6).patch_palette(5, [(1, 77)]).set_palette(6, b"abc").bind(1, 6).affine(4, 256, 0, 0, 0, 256, 0)
    assert len(list(decode.decode(many.finish()))) == 2


@pytest.mark.parametrize("step", [
    lambda b: b.move(1, 0, 0), lambda b: b.at(0), lambda b: b.at(3).at(2), lambda b: b.at(1).fill(9, 1, 1, 1), lambda b: b.fill(1, 2, 2, 2), lambda b: b.fill(8, 0, 2, 2),
    lambda b: b.instance(1, 1, 0, 0), lambda b: b.instance(2, 9, 0, 0), lambda b: b.at(1).move(7, 0, 0), lambda b: b.at(1).move(1, 1 << 25, 0), lambda b: b.at(1).patch([(1, 0, 0), (0, 0, 0)]),
    lambda b: b.at(1).trajectory(1, [[0, 1, 1, 2], [0, 1, 1, 3]]), lambda b: b.at(1).trajectory(1, [[1, 1, 1, 0, 0, 2]]), lambda b: b.at(1).bind(1, 4), lambda b: b.at(1).clear_instances().move(1, 0, 0), lambda b: b.raster(8, 2, 2, b"abc"),
])
def test_steps_that_are_wrong(step):
    with pytest.raises(build.BuildError):
        step(build.Builder(8, 8).fill(1, 2, 2, 5).instance(1, 1, 0, 0))


def test_placements_become_programs():
    spots = [(0, 0), (2, 1), (4, 2), (6, 3), (7, 3), (8, 3), (9, 3), (10, 3), (11, 3), (12, 3)]
    data = container.write(*script.parse("canvas 64 32 object 1 fill 3 3 9 instance 1 1 0 0 " + " ".join(f"at {t} move 1 {x} {y}" for t, (x, y) in enumerate(spots[1:], 1))))
    new = rewrite.collapsed(data)
    assert len(new) < len(data) and all((a == b).all() for a, b in zip(decode.decode(data), decode.decode(new), strict=True))
    assert rewrite.segments_of(spots) == [0, 2, 1, 3, 0, 1, 0, 6] and rewrite.segments_of([(0, 0), (1, 0), (3, 0), (6, 0)]) == [1, 1, 0, 1, 0, 3]
    assert rewrite.collapsed(new) == new


def test_children_are_bounded():
    python = [sys.executable, "-c"]
    assert child.run([*python, "import sys; sys.stdout.write(sys.stdin.read()[::-1])"], b"abc").out == b"cba"
    for argv, limits, why in ((["/no/such/program"], {}, "not started"), ([*python, "print('x' * 100000)"], {"most": 1000}, "too much output"), ([*python, "import time; time.sleep(60)"], {"seconds": 0.5}, "too slow"), ([], {}, "arguments")):
        with pytest.raises(child.ChildError, match=why):
            child.run(argv, **limits)


def test_command_line(tmp_path, capsys):
    rng = np.random.default_rng(1)
    first = rng.integers(0, 256, (6, 8), dtype=np.uint8)
    (tmp_path / "raw").write_bytes(b"".join(np.roll(first, k, 1).tobytes() for k in range(4)))
    p = lambda n: str(tmp_path / n)
    assert cli.main(["encode", p("raw"), p("a"), "--width", "8", "--height", "6"]) == 0 and cli.main(["archive", p("a"), p("m")]) == 0 and cli.main(["verify", p("a"), p("m")]) == 0
    assert cli.main(["decode", p("a"), p("frames")]) == 0 and (tmp_path / "frames/000003.gray").read_bytes() == np.roll(first, 3, 1).tobytes()
    assert cli.main(["optimize", p("a"), p("b")]) == 0 and cli.main(["bench", p("b")]) == 0 and cli.main(["quant", p("raw"), p("q"), "--width", "8", "--height", "6"]) == 0
    assert container.declares_quantized((tmp_path / "q").read_bytes())
    (tmp_path / "a").write_bytes((tmp_path / "a").read_bytes()[:-1] + b"?")
    assert cli.main(["verify", p("a"), p("m")]) == 1 and cli.main(["encode", p("raw"), p("c"), "--width", "7", "--height", "6"]) == 1
    assert "structural" in capsys.readouterr().err
