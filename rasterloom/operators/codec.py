"""Byte models and transforms as relations; the entropy coder itself as a function of one block."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.kept import remembered

# Fixed values of the entropy coder: units of a model, its bits, the lower end of the state.
TOTAL, SCALE_BITS, STATE_LOW = 16384, 14, 1 << 23


def byte_counts(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sym, n): how often each byte occurs. Bytes are read from the hexadecimal form, two digits each."""
    hexed = F.hex(F.col(text).cast("binary"))
    syms = blobs.select(key, hexed.alias("h")).select(key, "h", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("h")), F.lit(2))).alias("p")).filter(F.length("h") > 0)
    return syms.groupBy(key, F.conv(F.expr("substring(h, p, 2)"), 16, 10).cast("int").alias("sym")).agg(F.count("*").alias("n"))


def byte_model(counts: DataFrame, key: str) -> DataFrame:
    """Frequencies that sum to TOTAL: one for each present symbol, the rest by share, what is left to the largest remainders."""
    own = Window.partitionBy(key)
    rows = counts.withColumns({"all": F.sum("n").over(own), "used": F.count("*").over(own)})
    rows = rows.withColumns({"share": F.expr(f"n * ({TOTAL} - used) div all"), "rest": F.expr(f"n * ({TOTAL} - used) % all")})
    rows = rows.withColumns({"left": TOTAL - F.col("used") - F.sum("share").over(own), "nth": F.row_number().over(own.orderBy(F.col("rest").desc(), "sym"))})
    return rows.select(key, "sym", "n", (1 + F.col("share") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).cast("long").alias("freq"))


def blocks4(frames: DataFrame) -> DataFrame:
    """4 x 4 blocks as 16 columns s0..s15, row by row."""
    place = (F.col("y") % 4) * 4 + F.col("x") % 4
    cols = [F.max(F.when(place == k, F.col("v"))).cast("long").alias(f"s{k}") for k in range(16)]
    return frames.groupBy("stream_id", "frame", F.shiftright("y", 2).alias("by"), F.shiftright("x", 2).alias("bx")).agg(*cols)


def _points4(df: DataFrame, names: list[str], inverse: bool) -> DataFrame:
    a, b, c, d = (F.col(n) for n in names)
    if not inverse:
        y0, y2 = scalar.rotate(a + d, b + c, scalar.EVEN)
        y1, y3 = scalar.rotate(a - d, b - c, scalar.ODD)
        return df.withColumns(dict(zip(names, (y0, y1, y2, y3))))
    b0, b1 = scalar.unrotate(a, c, scalar.EVEN)
    b2, b3 = scalar.unrotate(b, d, scalar.ODD)
    return df.withColumns(dict(zip(names, (F.shiftright(b0 + b2, 1), F.shiftright(b1 + b3, 1), F.shiftright(b1 - b3, 1), F.shiftright(b0 - b2, 1)))))


ROWS = [[f"s{4 * r + c}" for c in range(4)] for r in range(4)]
COLUMNS = [[f"s{4 * r + c}" for r in range(4)] for c in range(4)]


def transform(blocks: DataFrame) -> DataFrame:
    """Integer transform, exactly invertible: rows, then columns, all in one projection chain."""
    return reduce(lambda df, names: _points4(df, names, False), ROWS + COLUMNS, blocks)


def untransform(blocks: DataFrame) -> DataFrame:
    return reduce(lambda df, names: _points4(df, names, True), COLUMNS + ROWS, blocks)


def model_of(data: bytes) -> np.ndarray:
    """The same model as byte_model, of one block."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(object)
    freq, total, used = np.zeros(256, np.int64), len(data), int(sum(x > 0 for x in n))
    if not total:
        return freq
    for s in range(256):
        if n[s]:
            freq[s] = 1 + n[s] * (TOTAL - used) // total
    rest = sorted((s for s in range(256) if n[s]), key=lambda s: (-(n[s] * (TOTAL - used) % total), s))
    for s in rest[: TOTAL - int(freq.sum())]:
        freq[s] += 1
    return freq


def range_encode(data: bytes, freq: np.ndarray) -> bytes:
    """Order-0 asymmetric numeral system: the state, then the bytes it gave off, last first."""
    start = (np.cumsum(freq) - freq).tolist()
    f, state, off = freq.tolist(), STATE_LOW, bytearray()
    for s in data:
        if not f[s]:
            raise ValueError("a byte that the model lacks")
        while state >= ((STATE_LOW >> SCALE_BITS) << 8) * f[s]:
            off.append(state & 255)
            state >>= 8
        state = ((state // f[s]) << SCALE_BITS) + state % f[s] + start[s]
    return state.to_bytes(4, "little") + bytes(reversed(off))


def range_decode(coded: bytes, freq: np.ndarray, n: int) -> bytes:
    """The n bytes that were encoded; the code must be used up exactly."""
    if len(coded) < 4:
        raise ValueError("truncated")
    start = (np.cumsum(freq) - freq).tolist()
    f, of = freq.tolist(), np.repeat(np.arange(256), freq).tolist()
    state, at, out = int.from_bytes(coded[:4], "little"), 4, bytearray(n)
    for i in range(n - 1, -1, -1):
        slot = state & (TOTAL - 1)
        s = out[i] = of[slot]
        state = f[s] * (state >> SCALE_BITS) + slot - start[s]
        while state < STATE_LOW:
            if at >= len(coded):
                raise ValueError("overread")
            state = state << 8 | coded[at]
            at += 1
    if at != len(coded):
        raise ValueError("bytes left over")
    return bytes(out)


#: Blocks and payloads of up to so many bytes are remembered, some at a time: an encoder tries the same residual more than once.
REMEMBERED = 1 << 14


def block(data: bytes) -> bytes:
    """Kind (0 raw, 1 coded), lengths of the data and of the payload (4 bytes each), then the payload: coded only where
    512 bytes of model and the code are shorter than the data."""
    return remembered("blocks", 256, data, lambda: _block(data)) if type(data) is bytes and len(data) <= REMEMBERED else _block(data)


def _block(data: bytes) -> bytes:
    if len(data) > 512 + 4:  # the least that a model and a code take
        freq = model_of(data)
        coded = range_encode(data, freq)
        if 512 + len(coded) < len(data):
            body = freq.astype("<u2").tobytes() + coded
            return b"\x01" + len(data).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    return b"\x00" + len(data).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def unblock(data: bytes) -> bytes:
    return remembered("payloads", 64, data, lambda: _unblock(data)) if type(data) is bytes and len(data) <= REMEMBERED else _unblock(data)


def _unblock(data: bytes) -> bytes:
    if len(data) < 9 or data[0] > 1:
        raise ValueError("bad block")
    n, size = int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:9], "little")
    if len(data) != 9 + size or data[0] == 0 and n != size:
        raise ValueError("bad block length")
    if not data[0]:
        return data[9:]
    freq = np.frombuffer(data[9:521], "<u2").astype(np.int64)
    if len(freq) != 256 or freq.sum() != TOTAL:
        raise ValueError("bad model")
    return range_decode(data[521:], freq, n)


def blocks_of(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of payloads with a check that each decodes to what it was: (key, n, kind, size, exact)."""

    def run(batches):
        for pdf in batches:
            data = [bytes(x) for x in pdf["data"]]
            coded = [block(x) for x in data]
            yield pd.DataFrame({key: pdf[key], "n": [len(x) for x in data], "kind": [c[0] for c in coded], "size": [len(c) for c in coded], "exact": [unblock(c) == x for c, x in zip(coded, data)]})

    kind = dict(blobs.dtypes)[key]
    return blobs.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).mapInPandas(run, f"{key} {kind}, n long, kind int, size long, exact boolean")


# Kind of a transform block, number of its transform, and side of its squares.
TRANSFORMED, LIFTING, SIDE = 2, 0, 4


def _turn(a: np.ndarray, b: np.ndarray, m: tuple[int, int], back: bool) -> tuple[np.ndarray, np.ndarray]:
    """One lifting rotation or its inverse; shifts of signed numbers are floors both ways."""
    p, q, s = m[0], m[1], scalar.TRANSFORM_SHIFT
    if back:
        a = a - (p * b >> s)
        b = b - (q * a >> s)
        return a - (p * b >> s), b
    a = a + (p * b >> s)
    b = b + (q * a >> s)
    return a + (p * b >> s), b


def _line(s: np.ndarray) -> np.ndarray:
    """Four points along the last axis."""
    a, b, c, d = np.moveaxis(s, -1, 0)
    y0, y2 = _turn(a + d, b + c, scalar.EVEN, False)
    y1, y3 = _turn(a - d, b - c, scalar.ODD, False)
    return np.stack([y0, y1, y2, y3], axis=-1)


def _unline(s: np.ndarray) -> np.ndarray:
    a, b, c, d = np.moveaxis(s, -1, 0)
    p0, p1 = _turn(a, c, scalar.EVEN, True)
    p2, p3 = _turn(b, d, scalar.ODD, True)
    return np.stack([p0 + p2 >> 1, p1 + p3 >> 1, p1 - p3 >> 1, p0 - p2 >> 1], axis=-1)


def squares(grid: np.ndarray) -> np.ndarray:
    """A grid as its 4 x 4 squares, row by row, with zeros beyond its edges."""
    h, w = grid.shape
    full = np.pad(grid, ((0, -h % SIDE), (0, -w % SIDE)))
    return full.reshape(full.shape[0] // SIDE, SIDE, -1, SIDE).swapaxes(1, 2).reshape(-1, SIDE, SIDE)


def transform_block(base: np.ndarray, target: np.ndarray) -> bytes:
    """What must be added to base to make target: a bit for each square that changes, then the first coefficients and all others of
    those squares, each stream a block of its own."""
    all_squares = squares(target.astype(np.int64) - base.astype(np.int64))
    coded = all_squares.any(axis=(1, 2))
    lines = _line(all_squares[coded])
    coefficients = _line(lines.swapaxes(1, 2)).swapaxes(1, 2).reshape(-1, SIDE * SIDE)
    zigzag = np.where(coefficients >= 0, 2 * coefficients, -2 * coefficients - 1).astype("<u4")
    streams = [block(zigzag[:, :1].tobytes()), block(zigzag[:, 1:].tobytes())]
    sizes = b"".join(len(s).to_bytes(4, "little") for s in streams)
    return bytes([TRANSFORMED, LIFTING]) + np.packbits(coded, bitorder="little").tobytes() + sizes + b"".join(streams)


def mask_bytes(width: int, height: int) -> int:
    return -(-(-(-width // SIDE) * -(-height // SIDE)) // 8)


def checked_transform(data: bytes, width: int, height: int) -> tuple[np.ndarray, bytes, bytes]:
    """Which squares a transform block codes and its two streams, not yet decoded; a ValueError names what is wrong."""
    down, n = -(-height // SIDE), -(-width // SIDE) * -(-height // SIDE)
    at = 2 + mask_bytes(width, height)
    if len(data) < at + 8:
        raise ValueError("truncated")
    if data[0] != TRANSFORMED or data[1] != LIFTING:
        raise ValueError("unknown transform")
    bits = np.unpackbits(np.frombuffer(data[2:at], np.uint8), bitorder="little").astype(bool)
    if bits[n:].any():
        raise ValueError("mask padding")
    first, rest = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4))
    if min(first, rest) < 9 or at + 8 + first + rest != len(data):
        raise ValueError("bad transform length")
    return bits[:n].reshape(down, -1), data[at + 8 : at + 8 + first], data[at + 8 + first :]


def transform_delta(data: bytes, width: int, height: int) -> np.ndarray:
    """What a transform block adds to a canvas."""
    coded, first, rest = checked_transform(data, width, height)
    n = int(coded.sum())
    first, rest = (np.frombuffer(unblock(s), np.uint8) for s in (first, rest))
    if len(first) != 4 * n or len(rest) != 60 * n:
        raise ValueError("coefficient count")
    z = np.concatenate([first.view("<u4").reshape(n, 1), rest.view("<u4").reshape(n, 15)], axis=1).astype(np.int64)
    c = np.where(z & 1, -(z >> 1) - 1, z >> 1).reshape(n, SIDE, SIDE)
    out = np.zeros((coded.size, SIDE, SIDE), np.int64)
    out[coded.ravel()] = _unline(_unline(c.swapaxes(1, 2)).swapaxes(1, 2))
    down, across = coded.shape
    return out.reshape(down, across, SIDE, SIDE).swapaxes(1, 2).reshape(down * SIDE, across * SIDE)[:height, :width]


# Points of a residual, and those of deeper samples.
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "u1")])
DEEP_POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "<u2")])


def point_block(x: np.ndarray, y: np.ndarray, v: np.ndarray, deep: bool = False) -> bytes:
    """Points in rising order of x, then y."""
    out = np.zeros(len(x), DEEP_POINT if deep else POINT)
    order = np.lexsort((y, x))
    out["x"], out["y"], out["v"] = x[order], y[order], v[order]
    return block(out.tobytes())


def points_of(data: bytes, deep: bool = False) -> np.ndarray:
    raw, kind = unblock(data), DEEP_POINT if deep else POINT
    if len(raw) % kind.itemsize:
        raise ValueError("point length")
    points = np.frombuffer(raw, kind)
    key = points["x"].astype(np.int64) << 32 | points["y"].astype(np.int64) & 0xFFFFFFFF
    if (np.diff(key) <= 0).any():
        raise ValueError("points do not rise")
    return points
