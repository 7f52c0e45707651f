import numpy as np
import pytest
from rasterloom.operators import codec
from rasterloom.plans import movies
from rasterloom.sources import archive, decode, encode, script, view
from rasterloom.sources import container as c


def test_manifest_round_trip_and_damage():
    data, _ = encode.swept(movies.movie(1, 3))
    m = archive.build(data)
    packed = archive.pack(m)
    assert archive.unpack(packed) == m and archive.verify(data, m).status == "complete"
    for at in range(0, len(packed), 97):
        with pytest.raises(c.Breach):
            archive.unpack(packed[:at] + bytes([packed[at] ^ 1]) + packed[at + 1 :])
    with pytest.raises(c.Breach):
        archive.build(c.write(4, 4, [(c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")], [], c.EXTERNAL_OBJECTS))


def test_packets_put_together_again():
    data, _ = encode.swept(movies.movie(12, 3))
    bodies = b"".join(f[13:] for _, _, f in archive.packets(data))
    assert bodies == data


@pytest.mark.parametrize("kind", range(len(movies.KINDS)))
def test_each_family_wins_where_it_should(kind):
    frames = movies.movie(kind, kind + 14)
    data, own = encode.swept(frames)
    assert tuple(d.family for d in own.decisions) == movies.KINDS[kind][1]
    assert all((a == b).all() for a, b in zip(frames, decode.decode(data), strict=True))
    assert len(data) == own.container().__len__() and own.decisions[0].payload == min(own.decisions[0].prices.values())


def test_random_frames_and_small_overlay():
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, 256, (7, 9), dtype=np.uint8)]
    for _ in range(8):
        f = frames[-1].copy()
        f[rng.integers(0, 7, 3), rng.integers(0, 9, 3)] = rng.integers(0, 256, 3)
        frames.append(f)
    for cap in (0, 5, 1 << 20):
        own = encode.Encoder(frames, 0, overlay_cap=cap)
        size = own.run()
        assert len(own.container()) == size and (cap or "sparse" not in {d.family for d in own.decisions})


def test_transform_blocks():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 200, (10, 13), dtype=np.uint8)
    target = base.copy()
    target[2:5, 3:13] += 17
    block = codec.transform_block(base, target)
    assert (base + codec.transform_delta(block, 13, 10) == target).all()
    for bad in (block[:5], b"\x03" + block[1:], block + b"x", block[:2] + b"\xff" * codec.mask_bytes(13, 10) + block[2 + codec.mask_bytes(13, 10) :]):
        with pytest.raises(ValueError):
            codec.transform_delta(bad, 13, 10)
    records = [(c.RASTER, [1, 13, 10], base.tobytes()), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")]
    assert (list(decode.decode(c.write(13, 10, records, [(1, [(0x2A, [], block)])])))[1] == target).all()
    with pytest.raises(c.Breach):
        list(decode.decode(c.write(13, 10, records, [(1, [(0x2A, [], block[:20])])])))
    deep = codec.point_block(np.array([3, 1]), np.array([0, 2]), np.array([700, 9]), deep=True)
    assert codec.points_of(deep, deep=True).tolist() == [(1, 2, 9), (3, 0, 700)]


def test_views_equal_the_crop_of_the_whole_frame():
    rng = np.random.default_rng(6)
    for kind in (0, 1, 2, 7, 8, 9, 11, 13):
        data, _ = encode.swept(movies.movie(kind, kind))
        frames = list(decode.decode(data))
        h, w = frames[0].shape
        for _ in range(6):
            x0, y0 = int(rng.integers(-3, w - 1)), int(rng.integers(-3, h - 1))
            box = (x0, y0, x0 + int(rng.integers(4, 20)), y0 + int(rng.integers(4, 20)))
            for at in (0, 3, 5):
                got, work = view.view(data, at, box)
                assert (got == frames[at][max(0, box[1]) : box[3], max(0, box[0]) : box[2]]).all() and work.replayed == at + 1
    with pytest.raises(c.Breach):
        view.view(data, 0, (-5, -5, 0, 0))
    text = """canvas 20 12 background 5 object 1 raster 4 4 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 object 2 gradient 6 6 10 1 2 instance 1 1 2 2 instance 2 2 8 3
      at 1 affine 1 128 0 -100 0 128 -100 copy 0 0 9 9 5 2 at 2 sparse 3 3 77 10 5 78 copy 3 1 12 8 0 0 copy 1 1 4 4 16 8 at 3 move 2 -2 9 copy 0 0 20 12 1 1"""
    data = c.write(*script.parse(text))
    frames = list(decode.decode(data))
    for at, f in enumerate(frames):
        for box in ((0, 0, 20, 12), (3, 2, 11, 9), (15, 7, 20, 12), (0, 9, 4, 12)):
            assert (view.view(data, at, box)[0] == f[box[1] : box[3], box[0] : box[2]]).all()
