"""The scene script: whitespace-separated tokens, comments from # to the end of a line, runs of values that end at a keyword."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import container as c

# The keywords.
KEYWORDS = {
    "canvas", "background", "object", "palette", "instance", "at", "move", "velocity", "advance", "trajectory", "advance_traj", "affine", "set_palette", "patch_palette", "bind", "copy", "move_rect", "sparse",
    "clear_instances", "clear_overlay",
}
TAGS = {"move": 0x22, "velocity": 0x26, "affine": 0x30, "bind": 0x2F, "copy": 0x24, "move_rect": 0x25, "sparse": 0x23, "advance": 0x27, "advance_traj": 0x2C, "clear_instances": 0x28, "clear_overlay": 0x29}
KINDS = ("gradient", "checker", "periodic", "noise")


class ScriptError(ValueError):
    """A script that does not follow the grammar."""


def statements(text: str) -> Iterator[tuple[str, list[str]]]:
    """Keywords with their operands. `palette` and `move` inside an instance line are operands."""
    words = [w for line in text.splitlines() for w in line.split("#")[0].split()]
    at = 0
    while at < len(words):
        key = words[at]
        if key not in KEYWORDS:
            raise ScriptError(f"expected a keyword, found {key}")
        end = at + 1
        while end < len(words) and (words[end] not in KEYWORDS or key == "instance" and words[end] == "palette" and end == at + 5):
            end += 1
        yield key, words[at + 1 : end]
        at = end


def number(word: str, low: int = -(1 << 63), high: int = (1 << 63) - 1) -> int:
    try:
        n = int(word)
    except ValueError:
        raise ScriptError(f"not a number: {word}") from None
    if not low <= n <= high:
        raise ScriptError(f"out of range: {word}")
    return n


def parse(text: str) -> tuple[int, int, list[tuple], list[tuple]]:
    """width, height, records and groups, as container.write takes them."""
    canvas, background, records, instances, bound, groups = None, 0, [], [], False, []
    for key, ops in statements(text):
        if canvas is None and key != "canvas":
            raise ScriptError("canvas comes first")
        try:
            if key == "canvas":
                canvas = [number(x, 1, 1 << 16) for x in ops]
                if len(canvas) != 2:
                    raise ScriptError("canvas W H")
            elif key == "background":
                background = number(ops[0], 0, 255)
            elif key == "object":
                records.append(_object(ops))
            elif key == "palette":
                records.append((c.PALETTE, [number(ops[0], 1)], bytes(number(x, 0, 255) for x in ops[1:])))
            elif key == "instance":
                bound |= len(ops) > 4
                instances.append([number(x) for x in ops[:4]] + [number(ops[5]) if len(ops) > 4 else 0])
            elif key == "at":
                t = number(ops[0], 1)
                if groups and t < groups[-1][0]:
                    raise ScriptError("time goes back")
                if not groups or t > groups[-1][0]:
                    groups.append((t, []))
            elif not groups:
                raise ScriptError(f"{key} before at")
            else:
                groups[-1][1].append(_transition(key, ops))
        except IndexError:
            raise ScriptError(f"{key}: operands are missing") from None
    if canvas is None:
        raise ScriptError("no canvas")
    rows = [x for i in instances for x in (i if bound else i[:4])]
    records.append((c.CHECKPOINT_BOUND if bound else c.CHECKPOINT, [background, *rows], b""))
    return canvas[0], canvas[1], records, groups


def _object(ops: list[str]) -> tuple:
    oid, kind, w, h = number(ops[0]), ops[1], number(ops[2], 1), number(ops[3], 1)
    rest = ops[4:]
    if kind == "fill":
        return c.FILL, [oid, w, h, number(rest[0], 0, 255)], b""
    if kind in ("raster", "index"):
        data = bytes(number(x, 0, 255) for x in rest)
        if len(data) != w * h:
            raise ScriptError("sample count")
        return c.RASTER if kind == "raster" else c.INDEX, [oid, w, h], data
    if kind in KINDS:
        k = KINDS.index(kind)
        args = [number(x) for x in rest]
        if len(args) != len(c.GENERATORS[k]):
            raise ScriptError(f"{kind}: parameters")
        return c.GENERATOR, [oid, w, h, k, *args], b""
    raise ScriptError(f"unknown object kind {kind}")


def _transition(key: str, ops: list[str]) -> tuple:
    if key == "trajectory":
        args, rest = [number(ops[0])], ops[1:]
        while rest:
            kind = {"lin": 0, "accel": 1}.get(rest[0])
            if kind is None:
                raise ScriptError(f"unknown segment {rest[0]}")
            n = len(c.SEGMENTS[kind])
            if len(rest) <= n:
                raise ScriptError("segment: operands are missing")
            args += [kind, *(number(x) for x in rest[1 : n + 1])]
            rest = rest[n + 1 :]
        return c.TRAJECTORY, args, b""
    if key == "set_palette":
        return 0x2D, [number(ops[0])], bytes(number(x, 0, 255) for x in ops[1:])
    if key == "patch_palette":
        pairs = [x.split("=") for x in ops[1:]]
        return 0x2E, [number(ops[0]), *(number(x, 0, 255) for p in pairs for x in p)], b""
    tag = TAGS[key]
    args = [number(x) for x in ops]
    if tag in c.PLAIN and len(args) != len(c.PLAIN[tag]):
        raise ScriptError(f"{key}: operands")
    return tag, args, b""


def compiled(scripts: DataFrame) -> DataFrame:
    """scripts (name, text) as containers: (name, data, error)."""

    def one(text: str) -> tuple:
        try:
            return c.write(*parse(text)), None
        except (ScriptError, c.Breach) as e:
            return None, str(e)

    def run(batches):
        for pdf in batches:
            out = [one(t) for t in pdf["text"]]
            yield pd.DataFrame({"name": pdf["name"], "data": [d for d, _ in out], "error": [e for _, e in out]})

    spark = scripts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # compiling is far more work than its bytes: few bytes must not put all scripts into one task
    return scripts.select("name", "text").repartition(parts, "name").mapInPandas(run, "name string, data binary, error string")
