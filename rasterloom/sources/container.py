"""The binary container of a scene, as records.

A container is a header, object and palette records, one checkpoint, groups of transitions, and a digest of all that came
before (BLAKE3, 32 bytes; a parameter). Numbers are little endian. The magic bytes are a parameter too.

`spark.read.format("scene_container")` gives one row for each record or transition: path, ord, tag, t, args, data, offset,
length, error. A container that breaks a rule gives the rows before the breach and one row that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.digest import blake3

MAGIC = b"SCENE\0"
VERSION, UNIVERSE, PROFILE = 1, 1, 1
SCHEMA = "path string, ord int, tag int, t long, args array<long>, data binary, offset long, length long, error string"
# Record tags.
RASTER, FILL, CHECKPOINT, GROUP, INDEX, PALETTE, GENERATOR, CHECKPOINT_BOUND, EXTERNAL = range(1, 10)
# Transition tags with the struct codes of their operands; those with counted parts are in COUNTED.
PLAIN = {0x21: "IIii", 0x22: "Iii", 0x24: "iiIIii", 0x25: "iiIIii", 0x26: "Iii", 0x27: "", 0x28: "", 0x29: "", 0x2C: "", 0x2F: "II", 0x30: "Iiiiiii"}
COUNTED = {0x23: ("", "iiB"), 0x2E: ("I", "BB")}
BYTES = {0x2A: "", 0x2D: "I"}
TRAJECTORY, SEGMENTS = 0x2B, {0: "iiQ", 1: "iiiiQ"}
# Parameters of generators by kind (gradient, checker, periodic, noise).
GENERATORS = {0: "Bii", 1: "BBI", 2: "BiiI", 3: "Q"}
LARGEST = 1 << 24
#: Most samples of a canvas or an object: sizes of a damaged file must not become memory.
MOST_SAMPLES = 1 << 26


class Breach(ValueError):
    """A rule of the format that a container breaks."""


class Cursor:
    def __init__(self, data: bytes, end: int):
        self.data, self.at, self.end = data, 0, end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Breach("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def pull(self, codes: str) -> list[int]:
        return list(struct.unpack("<" + codes, self.take(struct.calcsize("<" + codes))))


def header(width: int, height: int, features: int = 0, magic: bytes = MAGIC) -> bytes:
    return magic + struct.pack("<HIBIII", VERSION, UNIVERSE, PROFILE, features, width, height)


def record(tag: int, args: list[int], data: bytes = b"") -> bytes:
    """Bytes of an object, palette or checkpoint record."""
    if tag in (RASTER, INDEX):
        if len(data) != args[1] * args[2]:
            raise Breach("sample count")
        return struct.pack("<BIII", tag, *args) + data
    if tag == FILL:
        return struct.pack("<BIIIB", tag, *args)
    if tag == PALETTE:
        return struct.pack("<BII", tag, args[0], len(data)) + data
    if tag == GENERATOR:
        return struct.pack("<BIIIB", tag, *args[:4]) + struct.pack("<" + GENERATORS[args[3]], *args[4:])
    if tag == EXTERNAL:
        return struct.pack("<BIII", tag, *args) + data
    if tag in (CHECKPOINT, CHECKPOINT_BOUND):
        width = 4 if tag == CHECKPOINT else 5
        rows = args[1:]
        return struct.pack("<BBI", tag, args[0], len(rows) // width) + b"".join(struct.pack("<IIii" + "I" * (width - 4), *rows[i : i + width]) for i in range(0, len(rows), width))
    raise Breach("unknown record")


def transition(tag: int, args: list[int], data: bytes = b"") -> bytes:
    if tag in PLAIN:
        return struct.pack("<B" + PLAIN[tag], tag, *args)
    if tag in COUNTED:
        head, each = COUNTED[tag]
        own, rest, n = args[: len(head)], args[len(head) :], len(each)
        return struct.pack("<B" + head + "I", tag, *own, len(rest) // n) + b"".join(struct.pack("<" + each, *rest[i : i + n]) for i in range(0, len(rest), n))
    if tag in BYTES:
        return struct.pack("<B" + BYTES[tag] + "I", tag, *args, len(data)) + data
    if tag == TRAJECTORY:
        out, rest, n = b"", args[1:], 0
        while rest:
            codes = SEGMENTS[rest[0]]
            out += struct.pack("<B" + codes, *rest[: 1 + len(codes)])
            rest, n = rest[1 + len(codes) :], n + 1
        return struct.pack("<BII", tag, args[0], n) + out
    raise Breach("unknown transition")


def write(width: int, height: int, records: list[tuple], groups: list[tuple], features: int = 0, magic: bytes = MAGIC, digest: Callable[[bytes], bytes] = blake3) -> bytes:
    """records: (tag, args, data); groups: (t, [(tag, args, data), ...])."""
    made = [header(width, height, features, magic), *(record(*r) for r in records)]
    for t, transitions in groups:
        made += [struct.pack("<BQI", GROUP, t, len(transitions)), *(transition(*x) for x in transitions)]
    out = b"".join(made)
    return out + digest(out)


# Feature bits of streams whose payloads are in a store, and whose content was quantised.
EXTERNAL_OBJECTS, QUANTIZED = 1, 2


def features(data: bytes, magic: bytes = MAGIC) -> int:
    at = len(magic) + 7
    return int.from_bytes(data[at : at + 4], "little")


def declares_quantized(data: bytes, magic: bytes = MAGIC) -> bool:
    return bool(features(data, magic) & QUANTIZED)


def marked_quantized(data: bytes, magic: bytes = MAGIC, digest: Callable[[bytes], bytes] = blake3) -> bytes:
    """The container with the mark of quantised content, sealed again. One whose payloads are in a store is refused."""
    for _ in read(data, magic, digest):
        pass
    if features(data, magic) & EXTERNAL_OBJECTS:
        raise Breach("store-backed")
    at = len(magic) + 7
    out = data[:at] + (features(data, magic) | QUANTIZED).to_bytes(4, "little") + data[at + 4 : -32]
    return out + digest(out)


def scan(data: bytes, magic: bytes = MAGIC) -> list[tuple[str, int | None, int | None, int, int]]:
    """(kind, id, t, offset, length) of the top-level records, the digest at the end included. Only lengths are followed: no
    digest, id or order is checked."""
    cur = Cursor(data, len(data) - 32)
    if cur.take(len(magic)) != magic:
        raise Breach("magic")
    cur.pull("HIBIII")
    out = [("header", None, None, 0, cur.at)]
    while cur.at < cur.end:
        start = cur.at
        (tag,) = cur.pull("B")
        if tag == GROUP:
            t, count = cur.pull("QI")
            for _ in range(count):
                _transition(cur)
            out.append(("interval", None, t, start, cur.at - start))
            continue
        args, _ = _record(cur, tag)
        kind = "checkpoint" if tag in (CHECKPOINT, CHECKPOINT_BOUND) else "palette" if tag == PALETTE else "object"
        out.append((kind, None if kind == "checkpoint" else args[0], None, start, cur.at - start))
    return [*out, ("integrity", None, None, cur.at, 32)]


def read(data: bytes, magic: bytes = MAGIC, digest: Callable[[bytes], bytes] = blake3) -> Iterator[tuple]:
    """(ord, tag, t, args, data, offset, length) of each record and transition; raises Breach. The digest is checked last."""
    cur = Cursor(data, len(data) - 32)
    if cur.end < len(magic) or cur.take(len(magic)) != magic:
        raise Breach("magic")
    version, universe, profile, features, width, height = cur.pull("HIBIII")
    if (version, universe, profile) != (VERSION, UNIVERSE, PROFILE) or features & ~3:
        raise Breach("unsupported version, universe, profile or feature")
    if not width or not height:
        raise Breach("empty canvas")
    if width * height > MOST_SAMPLES:
        raise Breach("too large")
    yield 0, 0, None, [width, height, features], b"", 0, cur.at
    n, known, live, checkpoint, last = 1, set(), set(), False, 0
    while cur.at < cur.end:
        start = cur.at
        (tag,) = cur.pull("B")
        if tag == GROUP:
            if not checkpoint:
                raise Breach("group before the checkpoint")
            t, count = cur.pull("QI")
            if t <= last:
                raise Breach("time does not rise")
            last = t
            yield n, tag, t, [count], b"", start, cur.at - start
            n += 1
            for _ in range(count):
                start = cur.at
                tag, args, body = _transition(cur)
                _check(tag, args, known, live)
                yield n, tag, t, args, body, start, cur.at - start
                n += 1
            continue
        if checkpoint:
            raise Breach("declaration after the checkpoint")
        args, body = _record(cur, tag)
        if tag in (CHECKPOINT, CHECKPOINT_BOUND):
            checkpoint, width = True, 4 if tag == CHECKPOINT else 5
            for i in range(1, len(args), width):
                if args[i] in live:
                    raise Breach("instance twice")
                if args[i + 1] not in known:
                    raise Breach("unknown object")
                live.add(args[i])
        elif tag != PALETTE:
            if args[0] in known:
                raise Breach("object twice")
            known.add(args[0])
        yield n, tag, None, args, body, start, cur.at - start
        n += 1
    if not checkpoint:
        raise Breach("no checkpoint")
    if digest(data[: cur.end]) != data[cur.end :]:
        raise Breach("digest")


def _bounded(args: list[int]) -> list[int]:
    if args[1] * args[2] > MOST_SAMPLES:
        raise Breach("too large")
    return args


def _record(cur: Cursor, tag: int) -> tuple[list[int], bytes]:
    if tag in (RASTER, INDEX):
        args = cur.pull("III")
        if not args[1] or not args[2]:
            raise Breach("empty object")
        return args, cur.take(args[1] * args[2])
    if tag == FILL:
        return _bounded(cur.pull("IIIB")), b""
    if tag == PALETTE:
        pid, size = cur.pull("II")
        if not 0 < size <= 256:
            raise Breach("palette size")
        return [pid], cur.take(size)
    if tag == GENERATOR:
        args = cur.pull("IIIB")
        if args[3] not in GENERATORS:
            raise Breach("unknown generator")
        own = cur.pull(GENERATORS[args[3]])
        if args[3] in (1, 2) and not own[-1]:
            raise Breach("generator without effect")
        return _bounded(args) + own, b""
    if tag == EXTERNAL:
        return cur.pull("III"), cur.take(32)
    if tag in (CHECKPOINT, CHECKPOINT_BOUND):
        background, count = cur.pull("BI")
        codes = "IIii" + "I" * (tag == CHECKPOINT_BOUND)
        return [background, *(x for _ in range(count) for x in cur.pull(codes))], b""
    raise Breach("unknown record")


def _transition(cur: Cursor) -> tuple[int, list[int], bytes]:
    (tag,) = cur.pull("B")
    if tag in PLAIN:
        return tag, cur.pull(PLAIN[tag]), b""
    if tag in COUNTED:
        head, each = COUNTED[tag]
        own = cur.pull(head)
        (count,) = cur.pull("I")
        rows = [cur.pull(each) for _ in range(count)]
        keys = [r[:-1] for r in rows]
        if any(a >= b for a, b in zip(keys, keys[1:])):
            raise Breach("points do not rise")
        return tag, own + [x for r in rows for x in r], b""
    if tag in BYTES:
        own = cur.pull(BYTES[tag])
        (size,) = cur.pull("I")
        return tag, own, cur.take(size)
    if tag == TRAJECTORY:
        iid, count = cur.pull("II")
        args = [iid]
        for _ in range(count):
            (kind,) = cur.pull("B")
            if kind not in SEGMENTS:
                raise Breach("unknown segment")
            segment = cur.pull(SEGMENTS[kind])
            if not segment[-1] or kind == 1 and segment[2:4] == [0, 0]:
                raise Breach("segment without effect")
            args += [kind, *segment]
        return tag, args, b""
    raise Breach("unknown transition")


def _check(tag: int, args: list[int], known: set[int], live: set[int]) -> None:
    if tag in (0x21, 0x22) and any(abs(x) > LARGEST for x in args[-2:]):
        raise Breach("coordinate out of range")
    if tag == 0x21:
        if args[1] not in known:
            raise Breach("unknown object")
        if args[0] in live:
            raise Breach("instance twice")
        live.add(args[0])
    elif tag in (0x22, 0x26, 0x2B, 0x2F, 0x30) and args[0] not in live:
        raise Breach("unknown instance")
    elif tag == 0x28:
        live.clear()


def rows(path: str, data: bytes, magic: bytes = MAGIC) -> Iterator[tuple]:
    """Rows of SCHEMA; a breach becomes the last one."""
    n = 0
    try:
        for n, tag, t, args, body, offset, length in read(data, magic):
            yield path, n, tag, t, args, body, offset, length, None
    except Breach as e:
        yield path, n + 1, None, None, None, None, None, None, str(e)


class ContainerSource(DataSource):
    """Containers of a folder or file, one partition each. Option magic: hexadecimal."""

    @classmethod
    def name(cls) -> str:
        return "scene_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(dict(self.options))


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.magic = options["path"].removeprefix("file://"), bytes.fromhex(options.get("magic", MAGIC.hex()))

    def partitions(self) -> list[InputPartition]:
        import os

        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if not f.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from rows(partition.value, f.read(), self.magic)


def from_binary(files, magic: bytes = MAGIC):
    """The same rows from `binaryFile` rows (path, content): for stores that only Spark's readers open."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"]) for r in rows(p, bytes(c), magic)], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
