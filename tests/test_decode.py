import numpy as np
import pytest
from rasterloom.operators import codec
from rasterloom.sources import container as c
from rasterloom.sources import decode, rewrite, script


def scene(text):
    return c.write(*script.parse(text))


def test_moving_rectangle():
    groups = "".join(f" at {t} move 1 {1 + 2 * t} 0" for t in range(1, 6))
    frames = list(decode.decode(scene(f"canvas 16 6 object 1 fill 3 2 180 instance 1 1 1 0 {groups}")))
    assert len(frames) == 6
    for t, f in enumerate(frames):
        want = np.zeros((6, 16), np.uint8)
        want[0:2, 1 + 2 * t : 4 + 2 * t] = 180
        assert (f == want).all()


def test_motion_setters_and_programs():
    text = "canvas 40 8 object 1 fill 1 1 9 instance 1 1 0 0 at 1 velocity 1 2 1 advance at 2 trajectory 1 accel 1 0 1 0 2 lin 0 1 1 advance advance_traj at 3 advance_traj at 5 advance_traj at 6 advance_traj advance"
    spots = [tuple(int(v) for v in np.argwhere(f == 9)[0][::-1]) for f in decode.decode(scene(text))]
    assert spots == [(0, 0), (2, 1), (3, 1), (5, 1), (5, 2), (5, 2)]


def test_palette_overlay_copy_affine():
    text = """canvas 8 4 background 5 object 1 index 2 2 0 1 1 0 palette 3 10 20 instance 1 1 0 0 palette 3
      at 1 patch_palette 3 1=99 sparse 7 3 77 at 2 copy 0 0 2 2 4 1 at 3 clear_overlay affine 1 128 0 0 0 128 0"""
    f = list(decode.decode(scene(text)))
    assert f[0][:2, :2].tolist() == [[10, 20], [20, 10]] and f[1][:2, :2].tolist() == [[10, 99], [99, 10]] and f[1][3, 7] == 77
    assert f[2][1:3, 4:6].tolist() == [[10, 99], [99, 10]] and f[2][3, 7] == 77
    assert f[3][:4, :4].tolist() == [[10, 10, 99, 99]] * 2 + [[99, 99, 10, 10]] * 2 and f[3][3, 7] == 5


def residual(points):
    return codec.block(np.array(points, np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "u1")])).tobytes())


def test_residual_is_of_its_frame_only():
    base = [(c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")]
    f = list(decode.decode(c.write(4, 4, base, [(1, [(0x2A, [], residual([(2, 2, 50)]))]), (2, [])])))
    assert f[1][2, 2] == 50 and f[2][2, 2] == 0
    with pytest.raises(c.Breach):
        list(decode.decode(c.write(4, 4, base, [(1, [(0x2A, [], residual([(9, 2, 50)]))])])))


def containers():
    moves = "".join(f" at {t} move 1 {3 * t} {t}" for t in range(1, 9))
    yield "placements", scene(f"canvas 64 32 object 1 fill 4 4 9 instance 1 1 0 0 {moves} at 9 advance move 1 1 1 at 10 advance")
    ramp = " ".join(str((7 + 3 * x + 5 * y) % 256) for y in range(8) for x in range(8))
    yield "ramps", scene(f"canvas 32 32 object 1 raster 8 8 {ramp} object 2 raster 8 8 {ramp} instance 1 1 0 0 instance 2 2 9 9 at 1 move 2 3 3")
    base = [(c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")]
    same = (0x2A, [], residual([(x, 1, 200) for x in range(9)]))
    yield "residuals", c.write(16, 16, base, [(t, [same]) for t in range(1, 12)] + [(12, [(0x22, [1, 4, 4], b"")])])
    yield "nothing to gain", scene("canvas 8 8 object 1 fill 2 2 7 instance 1 1 0 0 at 1 move 1 3 3 at 2 move 1 1 5")


@pytest.mark.parametrize("name, data", list(containers()))
def test_rewrites_keep_every_frame(name, data):
    new = rewrite.optimized(data)
    assert all((a == b).all() for a, b in zip(decode.decode(data), decode.decode(new), strict=True))
    assert len(new) < len(data) if name != "nothing to gain" else new == data
    assert rewrite.optimized(new) == new


def test_in_spark(spark):
    rows = [(n, bytearray(d)) for n, d in containers()] + [("bad", bytearray(b"x"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = decode.frames(files).groupBy("path").agg({"frame": "count", "error": "max"}).collect()
    assert {r.path: r[1] if r.path != "bad" else r["max(error)"] for r in got}["bad"] == "magic"
    sizes = {r.path: (r.before, r.after) for r in rewrite.optimize(files.filter("path <> 'bad'")).collect()}
    assert sizes["ramps"][1] < sizes["ramps"][0]


def test_damage_gives_an_error_row_and_nothing_else(spark):
    import random

    rng, rows = random.Random(3), []
    for name, data in containers():
        for k in range(12):
            body = bytearray(data[:-32])
            body[rng.randrange(len(body))] ^= 1 << rng.randrange(8)
            rows.append((f"{name} {k}", bytearray(bytes(body) + c.blake3(bytes(body)))))
    rows.append(("palette", bytearray(c.write(4, 4, [(c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")], [(1, [(0x2E, [9, 0, 1], b"")])]))))
    rows.append(("transform", bytearray(c.write(4, 4, [(c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")], [(1, [(0x2A, [], b"\x02\x00\x01")])]))))
    files = spark.createDataFrame(rows, "path string, content binary")
    got = decode.frames(files).groupBy("path").agg({"error": "max", "frame": "count"}).collect()
    assert len(got) == len(rows) and all(r["max(error)"] or r["count(frame)"] for r in got)
    assert {r.path: r["max(error)"] for r in got if r.path in ("palette", "transform")} == {"palette": "unknown palette", "transform": "truncated"}
    optimised = rewrite.optimize(files).collect()
    assert len(optimised) == len(rows) and any(r.error for r in optimised) and any(r.after for r in optimised)


def test_a_scene_painted_step_by_step_is_the_scene_painted_anew():
    rng = np.random.default_rng(5)
    objects = [(c.FILL, [1, 5, 4, 77], b""), (c.RASTER, [2, 6, 3], bytes(range(18))), (c.INDEX, [3, 4, 4], bytes(k % 3 for k in range(16)))]
    scene, ops = decode.Scene(16, 12), []
    made = [(c.PALETTE, [1], b"\x05\x06\x07"), *objects]
    for x in made:
        scene.declare(*x)
    xy = lambda: rng.integers(-3, 14, 2).tolist()
    for k in range(300):
        iid, oid = int(rng.integers(1, 12)), int(rng.integers(1, 4))
        new = [(0x21, [iid, oid, *xy()], b""), (0x2F, [iid, 1], b"")]
        known = [(0x22, [iid, *xy()], b""), (0x26, [iid, 1, -1], b""), (0x27, [], b""), (0x30, [iid, 200, 30, 5, 10, 256, 0], b"")] if iid in scene.instances else []
        other = [(0x23, [3, 4, 9, 15, 11, 200], b""), (0x29, [], b""), (0x2E, [1, 0, k % 256], b""), *([(0x28, [], b"")] if k % 40 == 0 else [])]
        one = [new, [[*known, *other][int(rng.integers(len(known) + len(other)))]]][k % 2]
        for x in one:
            scene.apply(*x)
        ops += one
        anew = decode.Scene(16, 12)
        for x in made:
            anew.declare(*x)
        for x in ops:
            anew.apply(*x)
        assert (scene.painted() == anew.painted()).all()
