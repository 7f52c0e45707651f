"""The command line: python -m rasterloom COMMAND ARGS. Files are local; tables go through the queries."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import numpy as np

from .sources import archive, container, decode, encode, rewrite, script


def raw(path: str, width: int, height: int) -> list[np.ndarray]:
    data = Path(path).read_bytes()
    if not data or len(data) % (width * height):
        raise container.Breach("length")
    return list(np.frombuffer(data, np.uint8).reshape(-1, height, width))


def quantized(frames: list[np.ndarray], shift: int) -> list[np.ndarray]:
    half = 1 << shift >> 1
    return [np.minimum(255, (f.astype(int) + half) >> shift << shift).astype(np.uint8) for f in frames]


def demo(a) -> str:
    moves = " ".join(f"at {t} move 1 {100 + 2 * t} 0" for t in range(1, 101))
    data = container.write(*script.parse(f"canvas 1920 1080 object 7 fill 200 100 180 instance 1 7 100 0 {moves}"))
    Path(a.out).write_bytes(data)
    return f"{len(data)} bytes for 101 frames"


def encode_file(a) -> str:
    frames = raw(a.input, a.width, a.height)
    if a.shift:
        frames = quantized(frames, a.shift)
    data, own = encode.swept(frames, features=container.QUANTIZED if a.shift else 0)
    Path(a.out).write_bytes(data)
    won: dict[str, int] = {}
    for d in own.decisions:
        won[d.family] = won.get(d.family, 0) + 1
    return f"{len(data)} bytes, background {own.scene.background}, " + ", ".join(f"{k} {v}" for k, v in won.items())


def decode_file(a) -> str:
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    n = 0
    for n, f in enumerate(decode.decode(Path(a.input).read_bytes()), 1):
        (out / f"{n - 1:06d}.gray").write_bytes(f.tobytes())
    return f"{n} frames"


def verify_file(a) -> str:
    r = archive.verify(Path(a.input).read_bytes(), archive.unpack(Path(a.manifest).read_bytes()), not a.shallow)
    if r.status != "complete":
        raise container.Breach(f"{r.status}, record {r.first_bad_record}, frame {r.first_bad_frame}")
    return f"complete, {r.frames_checked} frames"


def archive_file(a) -> str:
    data = archive.pack(archive.build(Path(a.input).read_bytes()))
    Path(a.out).write_bytes(data)
    return f"{len(data)} bytes"


def optimize_file(a) -> str:
    before = Path(a.input).read_bytes()
    after = (rewrite.collapsed if a.collapse else rewrite.optimized)(before)
    Path(a.out).write_bytes(after)
    return f"{len(before)} to {len(after)} bytes"


def bench_file(a) -> str:
    data, begin = Path(a.input).read_bytes(), time.perf_counter()
    n = sum(1 for _ in decode.decode(data))
    return f"{n} frames in {time.perf_counter() - begin:.3f} s"


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="rasterloom")
    sub = top.add_subparsers(required=True)

    def command(name: str, do, *args: str):
        p = sub.add_parser(name)
        for x in args:
            p.add_argument(x)
        p.set_defaults(do=do)
        return p

    command("demo", demo, "out")
    for name in ("encode", "quant"):
        p = command(name, encode_file, "input", "out")
        p.add_argument("--width", type=int, required=True)
        p.add_argument("--height", type=int, required=True)
        p.add_argument("--shift", type=int, default=3 if name == "quant" else 0, choices=range(8))
    command("decode", decode_file, "input", "out")
    command("verify", verify_file, "input", "manifest").add_argument("--shallow", action="store_true")
    command("archive", archive_file, "input", "out")
    command("optimize", optimize_file, "input", "out").add_argument("--collapse", action="store_true")
    command("bench", bench_file, "input")
    a = top.parse_args(argv)
    try:
        print(a.do(a))
    except (container.Breach, script.ScriptError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
