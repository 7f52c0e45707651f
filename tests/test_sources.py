import pytest
from rasterloom.functions.digest import blake3
from rasterloom.sources import container as c
from rasterloom.sources import frames, script

SCRIPT = """
# a scene
canvas 16 12 background 7
object 1 fill 4 3 200   object 2 gradient 8 8 10 1 -2
object 3 raster 2 2 1 2
  3 4
object 4 noise 2 2 99
palette 5 0 10 20
instance 1 1 0 0 instance 2 2 3 -1 palette 5
at 1 velocity 1 2 1 advance
at 4 move 2 5 5 trajectory 1 lin 1 0 3 accel 0 0 1 1 2
  patch_palette 5 0=9 2=8 sparse 1 1 7 1 2 8 copy 0 0 8 8 -2 1
  affine 2 256 0 0 0 256 0 set_palette 5 1 2 3 bind 2 0
at 4 clear_overlay clear_instances
"""


def test_script_to_container_and_back():
    w, h, records, groups = script.parse(SCRIPT)
    data = c.write(w, h, records, groups)
    rows = list(c.read(data))
    assert rows[0][3] == [16, 12, 0]
    assert [(r[1], r[3], r[4]) for r in rows if r[2] is None][1:] == [(t, a, d) for t, a, d in records]
    got = {}
    for r in rows:
        if r[2] is not None and r[1] != c.GROUP:
            got.setdefault(r[2], []).append((r[1], r[3], r[4]))
    assert got == {t: [(a, b, d) for a, b, d in xs] for t, xs in groups}
    assert sum(r[6] for r in rows) + 32 == len(data) and all(a[5] + a[6] == b[5] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("text", ["move 1 1 1", "canvas 4 4 move 1 0 0", "canvas 4 4 object 1 raster 2 2 1", "canvas 4 4 at 2 advance at 1 advance", "canvas 0 4", "canvas 4 4 object 1 cone 1 1", "canvas 4 4 at 1 velocity 1 1", "canvas x 1", "canvas 4 4 object 1 fill 1 1 256"])
def test_scripts_that_are_wrong(text):
    with pytest.raises(script.ScriptError):
        script.parse(text)


def hostile():
    good = c.write(*script.parse(SCRIPT))
    seal = lambda b: b + blake3(b)
    fill, ckpt = (c.FILL, [1, 1, 1, 1], b""), (c.CHECKPOINT, [0, 1, 1, 0, 0], b"")
    yield "magic", b"X" + good[1:]
    yield "digest", good[:-1] + bytes([good[-1] ^ 1])
    yield "truncated", seal(good[:40])
    yield "magic", b""
    yield "object twice", c.write(4, 4, [fill, fill, ckpt], [])
    yield "unknown object", c.write(4, 4, [ckpt], [])
    yield "time does not rise", c.write(4, 4, [fill, ckpt], [(2, []), (2, [])])
    yield "unknown instance", c.write(4, 4, [fill, ckpt], [(1, [(0x22, [9, 0, 0], b"")])])
    yield "coordinate out of range", c.write(4, 4, [fill, ckpt], [(1, [(0x22, [1, 1 << 25, 0], b"")])])
    yield "points do not rise", c.write(4, 4, [fill, ckpt], [(1, [(0x23, [2, 0, 1, 1, 0, 1], b"")])])
    yield "segment without effect", c.write(4, 4, [fill, ckpt], [(1, [(0x2B, [1, 0, 1, 1, 0], b"")])])
    yield "no checkpoint", c.write(4, 4, [fill], [])
    yield "declaration after the checkpoint", c.write(4, 4, [fill, ckpt, (c.FILL, [2, 1, 1, 1], b"")], [])
    yield "empty canvas", c.write(0, 4, [fill, ckpt], [])
    yield "unknown record", seal(c.header(4, 4) + b"\x77")
    yield "unknown transition", seal(c.write(4, 4, [fill, ckpt], [])[:-32] + b"\x04" + (1).to_bytes(8, "little") + (1).to_bytes(4, "little") + b"\x99")


@pytest.mark.parametrize("error, data", list(hostile()))
def test_containers_that_are_wrong(error, data):
    with pytest.raises(c.Breach, match=error):
        list(c.read(data))


def test_spark_reads_containers(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(c.write(*script.parse(SCRIPT)))
    (tmp_path / "b.bin").write_bytes(b"nothing")
    spark.dataSource.register(c.ContainerSource)
    rows = spark.read.format("scene_container").load(str(tmp_path)).collect()
    assert [r.error for r in rows if r.path.endswith("b.bin")] == ["magic"]
    ok = [r for r in rows if r.path.endswith("a.bin")]
    assert len(ok) == len(list(c.read(c.write(*script.parse(SCRIPT))))) and all(r.error is None for r in ok)
    again = c.from_binary(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.ord, str(r.tag), str(r["args"])) for r in again) == sorted((r.ord, str(r.tag), str(r["args"])) for r in rows)


def test_scripts_in_spark(spark):
    got = {r.name: r for r in script.compiled(spark.createDataFrame([("a", SCRIPT), ("b", "at 1")], "name string, text string")).collect()}
    assert bytes(got["a"].data) == c.write(*script.parse(SCRIPT)) and got["b"].error == "canvas comes first"


def test_raw_frames(spark, tmp_path):
    (tmp_path / "ok").write_bytes(bytes(range(24)))
    (tmp_path / "odd").write_bytes(bytes(7))
    got = frames.raw_frames(spark.read.format("binaryFile").load(str(tmp_path)), 4, 3)
    rows = sorted((r.path[-2:], -1 if r.frame is None else r.frame, r.error) for r in got.collect())
    assert rows == [("dd", -1, "length"), ("ok", 0, None), ("ok", 1, None)]
    dense = frames.dense(got.filter("error IS NULL"), 4).collect()
    assert all(r.v == r.frame * 12 + r.y * 4 + r.x for r in dense) and len(dense) == 24


def test_manifests(spark):
    lines = spark.createDataFrame([("#tb 0: 1001/24000",), ("0,  0,  0, 1, 48, ABCD",), ("0, 1, N/A, 1, 48, ef01",), ("",)], "value string").coalesce(1)
    got = frames.framehash(lines).orderBy("frame")
    assert [(r.frame, r.pts, r["size"], r.hash) for r in got.collect()] == [(0, 0, 48, "abcd"), (1, None, 48, "ef01")]
    assert tuple(frames.time_base(lines).first()) == (1001, 24000)
    mine = spark.createDataFrame([(0, 0, 48, "abcd"), (1, 5, 48, "ef01"), (2, 6, 48, "00")], "frame long, pts long, size long, digest string")
    assert {tuple(r) for r in frames.verified_import(mine, got).collect()} == {(1, "time"), (2, "unexpected")}
    probe = spark.createDataFrame([(0, "index=3"), (0, "disposition.default=0"), (1, "index=4"), (1, "disposition.default=1"), (1, "x=a=b"), (1, "noise")], "section int, value string")
    assert frames.chosen_stream(frames.probe(probe)).first().pairs["x"] == "a=b"


def test_digest_of_published_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    data = bytes(i % 251 for i in range(1025))
    assert blake3(data[:1024]).hex()[:16] == "42214739f095a406" and blake3(data).hex()[:16] == "d00278ae47eb27b3"
