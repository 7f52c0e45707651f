import hashlib

import numpy as np
import pytest
from rasterloom.operators import codec, motion, pixels
from rasterloom.sources import container as c
from rasterloom.sources import planes


def sha(data):
    return hashlib.sha256(data).digest()


def sealed(data):
    return data[:-32] + sha(data[:-32])


def full():
    raster = np.arange(12, dtype="<u2").tobytes()
    deep = codec.point_block(np.array([0, 3]), np.array([1, 2]), np.array([4000, 5]), deep=True)
    one = planes.Plane(9, [(1, 4, 3, planes.RASTER, [], raster), (2, 2, 2, planes.INDEX, [], bytes([0, 1, 1, 0])), (3, 2, 2, planes.GENERATOR, [3, 99], b"")], [(1, 1, 0, 0), (2, 2, 3, 2), (3, 3, 1, 1)], [(0, 0, 4095)])
    one.palettes, one.motion = {4: [7, 3000]}, [(1, 2, [0, 1, 0, 2, 1, 0, 1, 1, 0, 3]), (2, 4, [4]), (3, 3, [128, 0, 0, 0, 128, 0])]
    one.groups = [(1, [(0x2C, [], b""), (0x2E, [4, 1, 2999], b"")]), (2, [(0x21, (9, 2, 1, planes.FILL, [77], b""), b""), (0x22, [8, 9, 5, 5], b""), (0x28, [], deep)]), (5, [(0x2C, [], b""), (0x32, [0, 256, 0, 256, 0, 256, 0], b""), (0x26, [1, 1, 50], b"")])]
    return planes.Media(8, 6, "yuva444", (12, 12, 12, 12), (1, 2, 3, 4, 0), (4, 3), 1, 2), [one, planes.Plane(5), planes.Plane(0), planes.Plane(4095)]


def test_round_trip_and_replay():
    media, programs = full()
    data = planes.write(media, programs, sha)
    assert planes.parse(data, sha) == (media, programs) and planes.write(*planes.parse(data, sha), sha) == data
    first, second, last = (planes.observation(media, programs, t)[0] for t in (0, 2, 9))
    assert first[0, 0] == 4095 and first[2, 4] == 3000 and second[5, 5] == 77 and second[1, 0] == 4000
    assert (last[:, :7] == np.where(np.indices((6, 7))[1] >= 0, second[:, 1:], 0)).sum() >= 40
    assert [int(p.max()) for p in planes.observation(media, programs, 1)[1:]] == [5, 0, 4095]


def test_features_are_the_fewest():
    plain = planes.write(planes.Media(4, 4, "gray", (8,)), [planes.Plane(1)], sha)
    assert plain[13:17] == b"\0\0\0\0"
    for bits in (1, 2, 4):
        with pytest.raises(c.Breach):
            planes.parse(sealed(plain[:13] + bytes([bits, 0, 0, 0]) + plain[17:]), sha)


def test_damage_is_refused():
    data = planes.write(*full(), sha)
    for at in range(0, len(data) - 32, 3):
        for harmed in (data[:at], sealed(data[:at] + bytes([data[at] ^ 0x80]) + data[at + 1 :])):
            try:
                planes.observation(*planes.parse(harmed, sha), 9)
            except c.Breach:
                pass
    with pytest.raises(c.Breach):
        planes.parse(data[:-1] + b"?", sha)


@pytest.mark.parametrize("name", pixels.FORMATS)
def test_formats_round_trip(name):
    rng = np.random.default_rng(1)
    for w, h in ((6, 4), (8, 5), (2, 1)):
        s = pixels.shape(name, w, h)
        own = [rng.integers(0, 1 << s.depth, (p[2], p[1])) for p in s.planes]
        data = pixels.repacked(name, w, h, own)
        assert all((a == b).all() for a, (_, b) in zip(own, pixels.unpacked(name, w, h, data), strict=True))
        with pytest.raises(pixels.PixelError):
            pixels.unpacked(name, w, h, data + b"x")
    if name in pixels.PAIRED:
        with pytest.raises(pixels.PixelError):
            pixels.shape(name, 5, 2)


def test_pictures_clip_and_refuse():
    p = pixels.Picture([np.zeros((4, 5), np.uint16), np.zeros((2, 3), np.uint16)], 10)
    p.fill(0, 1023, -2, 1, 3, 99)
    p.blit(1, np.array([[1, 2], [3, 4]]), 2, -1)
    p.put(0, 4, 0, 7)
    assert p.planes[0].tolist() == [[0, 0, 0, 0, 7]] + [[1023, 1023, 1023, 0, 0]] * 3 and p.planes[1].tolist() == [[0, 0, 3], [0, 0, 0]] and p.get(1, 9, 0) is None
    for step in (lambda: p.put(0, 5, 0, 1), lambda: p.put(0, 0, 0, 1024), lambda: p.fill(1, 2000, 0, 0, 1, 1), lambda: p.blit(0, np.array([[5000]]), 0, 0)):
        with pytest.raises(pixels.PixelError):
            step()


def test_maps_of_pans_and_turns():
    rng = np.random.default_rng(2)
    big = rng.integers(0, 256, (80, 100), dtype=np.uint8)
    assert motion.displacement(big[10:60, 10:80], big[13:63, 5:75]) == (-5, 3)
    name, bits, size, m = motion.priced(big[10:60, 10:80], big[13:63, 5:75])[0]
    assert name == "translation" and bits == 8 and m == [256, 0, -5 * 256, 0, 256, 3 * 256]
