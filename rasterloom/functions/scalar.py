"""Integer scalar functions of the sample domain. All are built from JVM expressions, but for the noise hash, which must wrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers of the four-point lifting transform (eight fractional bits), of its even and its odd pair.
EVEN, ODD, TRANSFORM_SHIFT = (106, -181), (51, -98), 8
# Multipliers of the noise hash, and of its finaliser.
NOISE_X, NOISE_Y = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def floor_div(a: Column, b: Column) -> Column:
    """Rounds towards minus infinity for positive b."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def affine_source(a: Column, b: Column, c: Column, x: Column, y: Column, shift: int = 8) -> Column:
    """Source coordinate of a fixed-point map."""
    return F.shiftright((a * x + b * y + c).cast("long"), shift)


def gradient(base: Column, sx: Column, sy: Column, x: Column, y: Column, top: int = 255) -> Column:
    return F.pmod(base + sx * x + sy * y, F.lit(top + 1))


def checker(a: Column, b: Column, cell: Column, x: Column, y: Column) -> Column:
    return F.when(F.pmod(floor_div(x, cell) + floor_div(y, cell), F.lit(2)) == 0, a).otherwise(b)


def periodic(base: Column, sx: Column, sy: Column, period: Column, x: Column, y: Column, top: int = 255) -> Column:
    return F.pmod(base + sx * F.pmod(x, period) + sy * F.pmod(y, period), F.lit(top + 1))


# Functions in Python are wrapped when they are called: a wrapped one holds a session, and this module travels to the workers.


def noise_values(seed: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Top byte of a seeded hash of a coordinate; products wrap at 64 bits, which the session's checked arithmetic would refuse."""
    u = lambda s: s.to_numpy(np.int64).view(np.uint64)
    h = u(seed) ^ (u(x) * np.uint64(NOISE_X)) ^ (u(y) * np.uint64(NOISE_Y))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return pd.Series(((h ^ (h >> np.uint64(31))) >> np.uint64(56)).astype(np.int32))


def noise(seed: Column, x: Column, y: Column) -> Column:
    return F.pandas_udf(noise_values, T.IntegerType())(seed, x, y)


def noise_deep(seed: Column, x: Column, y: Column, top: int) -> Column:
    """Noise scaled to samples of any depth."""
    return F.shiftright(noise(seed, x, y) * (top + 1), 8)


def quantize(v: Column, shift: Column | int, half_up: bool = True) -> Column:
    """Sample on the lattice of 2**shift, saturated; shift 0 changes nothing."""
    k = shift if isinstance(shift, Column) else F.lit(shift)
    step = F.call_function("shiftleft", F.lit(1), k)
    half = F.call_function("shiftright", step, F.lit(1)) if half_up else F.lit(0)
    return F.least(F.lit(255), F.call_function("shiftleft", F.call_function("shiftright", v + half, k), k))


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, 2 to 0, 1, 2, 3, 4."""
    return F.when(v >= 0, v.cast("long") * 2).otherwise(-v.cast("long") * 2 - 1)


def unzigzag(z: Column) -> Column:
    return F.when(F.pmod(z, F.lit(2)) == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z, 1) - 1)


def rotate(a: Column, b: Column, m: tuple[int, int]) -> tuple[Column, Column]:
    """One lifting rotation of three steps."""
    u = a + F.shiftright(m[0] * b, TRANSFORM_SHIFT)
    v = b + F.shiftright(m[1] * u, TRANSFORM_SHIFT)
    return u + F.shiftright(m[0] * v, TRANSFORM_SHIFT), v


def unrotate(w: Column, v: Column, m: tuple[int, int]) -> tuple[Column, Column]:
    u = w - F.shiftright(m[0] * v, TRANSFORM_SHIFT)
    b = v - F.shiftright(m[1] * u, TRANSFORM_SHIFT)
    return u - F.shiftright(m[0] * b, TRANSFORM_SHIFT), b


def plane_length(n: Column, shift: Column | int) -> Column:
    """Samples of a subsampled line: a started group counts."""
    k = shift if isinstance(shift, Column) else F.lit(shift)
    return F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1), k) - 1, k)


def depth_top(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bits) - 1


def cross_product(value: Column, num: Column, den: Column) -> Column:
    """value * num * den without rounding, for comparing rational times."""
    return (value.cast("decimal(19,0)") * num.cast("decimal(10,0)")).cast("decimal(28,0)") * den.cast("decimal(10,0)")


def compare_times(value: Column, num: Column, den: Column, value2: Column, num2: Column, den2: Column) -> Column:
    """-1, 0 or 1 for value * num / den against another time."""
    left, right = cross_product(value, num, den2), cross_product(value2, num2, den)
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def rescale(value: Column, num: Column, den: Column, num2: Column, den2: Column) -> Column:
    """Ticks of another time base, or null if they are not whole."""
    top, bottom = cross_product(value, num, den2), (den.cast("decimal(19,0)") * num2.cast("decimal(10,0)"))
    return F.when(top % bottom == 0, (top / bottom).cast("decimal(38,0)").cast("long"))


# The reflected and the plain CRC-32 share this polynomial.
CRC_POLYNOMIAL = 0x04C11DB7


def crc32_plain(data: bytes) -> int:
    """CRC-32, most significant bit first, start and end value 0 (the packet check of a multimedia pipe)."""
    out = 0
    for b in data:
        out ^= b << 24
        for _ in range(8):
            out = (out << 1 ^ CRC_POLYNOMIAL) & 0xFFFFFFFF if out & 0x80000000 else out << 1 & 0xFFFFFFFF
    return out


def translation_of(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, shift: int) -> Column:
    """Whole-sample offset (x, y) of a fixed-point map that is a pure translation, else null."""
    unit = 1 << shift
    plain = (a == unit) & (e == unit) & (b == 0) & (d == 0) & (c % unit == 0) & (f % unit == 0)
    return F.when(plain, F.struct(F.shiftright(c.cast("long"), shift).alias("x"), F.shiftright(f.cast("long"), shift).alias("y")))


# Fixed value: largest coefficient of a map.
LARGEST_COEFFICIENT = 1 << 24


def map_coefficient(v: Column, shift: int) -> Column:
    """A real coefficient in fixed point: half rounds away from zero, what doesn't fit saturates."""
    r = F.round(v * float(1 << shift), 0)
    return F.greatest(F.lit(-float(LARGEST_COEFFICIENT)), F.least(F.lit(float(LARGEST_COEFFICIENT)), r)).cast("long")


def ticks_per_second(num: Column, den: Column) -> Column:
    """Of a time base of num / den seconds, or null if they are not whole."""
    return F.when(den % num == 0, (den / num).cast("long"))


def later(value: Column, num: Column, den: Column, ticks: Column, num2: Column, den2: Column) -> Column:
    """A time and a duration on the same time base; null on another base or beyond 64 bits."""
    total = value.cast("decimal(20,0)") + ticks.cast("decimal(20,0)")
    return F.when((num == num2) & (den == den2) & (total <= F.lit(2**63 - 1).cast("decimal(20,0)")), total.cast("long"))


def span(value: Column, num: Column, den: Column, value2: Column, num2: Column, den2: Column) -> Column:
    """Ticks on the first base from the second time to the first, or null if they are not whole or not positive."""
    ticks = value - rescale(value2, num2, den2, num, den)
    return F.when(ticks > 0, ticks)


def frame_ticks(rate_num: Column, rate_den: Column, num: Column, den: Column) -> Column:
    """Ticks of a time base that a frame of a constant rate lasts, or null if they are not whole."""
    return rescale(F.lit(1), rate_den, rate_num, num, den)


# Bytes of a transition without its counted parts, and of each counted part (points, changes, samples, bytes).
WIRE = {
    0x21: (17, 0), 0x22: (13, 0), 0x23: (5, 9), 0x24: (25, 0), 0x25: (25, 0), 0x26: (13, 0), 0x27: (1, 0), 0x28: (1, 0), 0x29: (1, 0),
    0x2A: (5, 1), 0x2B: (9, 17), 0x2C: (1, 0), 0x2D: (9, 1), 0x2E: (9, 2), 0x2F: (9, 0), 0x30: (29, 0),
}
# Fixed value: bytes that an accelerated segment has over a linear one.
ACCELERATED = 8


def wire_length(tag: Column, parts: Column, accelerated: Column | None = None) -> Column:
    """Bytes of a transition with so many counted parts, accelerated segments among them; null for an unknown tag."""
    table = F.create_map(*[F.lit(x) for k, (fixed, each) in WIRE.items() for x in (k, fixed * 1000 + each)])
    both = table[tag.cast("int")]
    out = F.expr("0") + F.floor(both / 1000) + (both % 1000) * parts
    return (out if accelerated is None else out + ACCELERATED * accelerated).cast("long")


def procedural_fraction(residual: Column, raster: Column, total: Column) -> Column:
    """Share of a stream's bytes that is neither residual nor raster samples."""
    return F.when(total == 0, F.lit(0.0)).otherwise(1.0 - (residual + raster) / F.when(total == 0, 1).otherwise(total))


def profile_label(shift: Column, half_up: Column, filtered: Column) -> Column:
    """Name of a lossy profile."""
    return F.concat(F.lit("q"), shift.cast("string"), F.when(half_up, ":halfup").otherwise(":deadzone"), F.when(filtered, ":box3").otherwise(""))


# Side data that has a type of its own.
TYPED_SIDE_DATA = ("mastering_display", "content_light_level", "timecode")


def side_data_class(kind: Column) -> Column:
    """How side data is treated: known kinds are typed, all others are carried along without being understood."""
    return F.when(kind.isin(*TYPED_SIDE_DATA), "typed").otherwise("unsupported")


# Start and multiplier of the 64-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_values(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of bytes, in 16 hexadecimal digits; rows are worked on together, a byte at a time."""
    rows = [bytes(d) for d in data]
    size = np.array([len(r) for r in rows])
    h = np.full(len(rows), FNV_START, np.uint64)
    flat, first = np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        h[at] = (h[at] ^ flat[first[at] + k]) * np.uint64(FNV_FACTOR)
    return pd.Series([f"{x:016x}" for x in h.tolist()])


def fnv1a(data: Column) -> Column:
    return F.pandas_udf(fnv1a_values, T.StringType())(data)
