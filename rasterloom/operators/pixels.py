"""Pixel formats: payloads as canonical planes and back. Canonical planes are Y Cb Cr, R G B or grey, alpha last, each tight rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Planar formats with depth, how often chroma is halved across and down, and planes in the order of the payload.
PLANAR = {
    "gray": (8, 0, 0, "y"), "gray16le": (16, 0, 0, "y"),
    "yuv420p": (8, 1, 1, "yuv"), "yuv420p10le": (10, 1, 1, "yuv"), "yuv420p12le": (12, 1, 1, "yuv"), "yuv420p14le": (14, 1, 1, "yuv"), "yuv420p16le": (16, 1, 1, "yuv"),
    "yuv422p": (8, 1, 0, "yuv"), "yuv422p10le": (10, 1, 0, "yuv"), "yuv422p12le": (12, 1, 0, "yuv"), "yuv422p16le": (16, 1, 0, "yuv"),
    "yuv444p": (8, 0, 0, "yuv"), "yuv444p10le": (10, 0, 0, "yuv"), "yuv444p12le": (12, 0, 0, "yuv"), "yuv444p16le": (16, 0, 0, "yuv"),
    "yuva420p": (8, 1, 1, "yuva"), "yuva444p": (8, 0, 0, "yuva"), "yuva444p10le": (10, 0, 0, "yuva"), "yuva444p12le": (12, 0, 0, "yuva"), "yuva444p16le": (16, 0, 0, "yuva"),
    "gbrp": (8, 0, 0, "gbr"), "gbrp10le": (10, 0, 0, "gbr"), "gbrp12le": (12, 0, 0, "gbr"), "gbrp16le": (16, 0, 0, "gbr"), "gbrap": (8, 0, 0, "gbra"), "gbrap10le": (10, 0, 0, "gbra"),
}
# Formats with woven chroma (4:2:0): depth, bits that samples are shifted up by, order of the two.
SEMI_PLANAR = {"nv12": (8, 0, "uv"), "nv21": (8, 0, "vu"), "p010le": (10, 6, "uv"), "p016le": (16, 0, "uv")}
# 8-bit formats of woven samples (0 is padding), and of two pixels that share chroma.
PACKED = {n: n for n in ("rgb0", "bgr0", "0rgb", "0bgr", "rgba", "bgra", "argb", "abgr")} | {"rgb24": "rgb", "bgr24": "bgr"}
PAIRED = {"yuyv422": "yuyv", "uyvy422": "uyvy"}
FORMATS = (*PLANAR, *SEMI_PLANAR, *PACKED, *PAIRED)
CANONICAL = "yuvrgba"


class PixelError(ValueError):
    """A payload that is none of its format."""


@dataclass
class Shape:
    """Where a format's samples are: for each canonical plane its size, and the first sample, row and step in the payload."""

    depth: int
    shift: int
    samples: int
    planes: list[tuple[str, int, int, int, int, int]]  # name, width, height, first, row, step


def shape(name: str, width: int, height: int) -> Shape:
    if min(width, height) < 1:
        raise PixelError("empty picture")
    half = lambda n, k: -(-n >> k)
    found, n, shift, depth = [], 0, 0, 8
    if name in PLANAR:
        depth, across, down, order = PLANAR[name]
        for p in order:
            w, h = (half(width, across), half(height, down)) if p in "uv" else (width, height)
            found.append((p, w, h, n, w, 1))
            n += w * h
    elif name in SEMI_PLANAR:
        depth, shift, order = SEMI_PLANAR[name]
        w, h, n = half(width, 1), half(height, 1), width * height
        found = [("y", width, height, 0, width, 1)] + [(p, w, h, n + k, 2 * w, 2) for k, p in enumerate(order)]
        n += 2 * w * h
    elif name in PACKED:
        order = PACKED[name]
        found = [(p, width, height, k, width * len(order), len(order)) for k, p in enumerate(order) if p != "0"]
        n = width * height * len(order)
    elif name in PAIRED:
        if width % 2:
            raise PixelError("odd width")
        order, row = PAIRED[name], 2 * width
        found = [("y", width, height, order.index("y"), row, 2)] + [(p, width // 2, height, order.index(p), row, 4) for p in "uv"]
        n = row * height
    else:
        raise PixelError("unknown format")
    return Shape(depth, shift, n, sorted(found, key=lambda p: CANONICAL.index(p[0])))


def _places(p: tuple) -> np.ndarray:
    _, w, h, first, row, step = p
    return first + np.arange(h)[:, None] * row + np.arange(w)[None, :] * step


def unpacked(name: str, width: int, height: int, payload: bytes) -> list[tuple[str, np.ndarray]]:
    """(name, samples) of each canonical plane. A payload of another length, or with a sample beyond the depth, is refused."""
    s = shape(name, width, height)
    kind = np.dtype("u1") if s.depth <= 8 else np.dtype("<u2")
    if len(payload) != s.samples * kind.itemsize:
        raise PixelError("payload length")
    flat = np.frombuffer(payload, kind)
    if s.shift:
        if (flat & ((1 << s.shift) - 1)).any():
            raise PixelError("bits below the sample")
        flat = flat >> s.shift
    planes = [(p[0], flat[_places(p)]) for p in s.planes]
    if any(v.max() >> s.depth for _, v in planes):
        raise PixelError("sample out of range")
    return planes


def repacked(name: str, width: int, height: int, planes: list[np.ndarray]) -> bytes:
    """The inverse of unpacked(): canonical planes in order; padding is zero."""
    s = shape(name, width, height)
    out = np.zeros(s.samples, "u1" if s.depth <= 8 else "<u2")
    if [v.shape for v in planes] != [(p[2], p[1]) for p in s.planes]:
        raise PixelError("plane sizes")
    for p, v in zip(s.planes, planes):
        out[_places(p)] = v.astype(out.dtype) << s.shift
    return out.tobytes()


def canonical(pictures: DataFrame) -> DataFrame:
    """Planes of pictures (id, format, width, height, payload): id, plane (its number), name, w, h, depth, samples (little endian),
    error. A payload that is refused gives one row with its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    depth = shape(r.format, r.width, r.height).depth
                    rows += [(r.id, k, n, v.shape[1], v.shape[0], depth, np.ascontiguousarray(v).tobytes(), None) for k, (n, v) in enumerate(unpacked(r.format, r.width, r.height, bytes(r.payload)))]
                except PixelError as e:
                    rows.append((r.id, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "plane", "name", "w", "h", "depth", "samples", "error"]).astype(dict.fromkeys(("plane", "w", "h", "depth"), "Int64"))

    return pictures.select("id", "format", "width", "height", "payload").mapInPandas(run, "id long, plane int, name string, w int, h int, depth int, samples binary, error string")


def payloads(planes: DataFrame) -> DataFrame:
    """Planes (id, format, width, height, plane, depth, samples) woven again: id, payload."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("plane")
        r = pdf.iloc[0]
        s = shape(r["format"], int(r["width"]), int(r["height"]))
        own = [np.frombuffer(x, "u1" if s.depth <= 8 else "<u2").reshape(p[2], p[1]) for x, p in zip(pdf["samples"], s.planes)]
        return pd.DataFrame({"id": [r["id"]], "payload": [repacked(r["format"], int(r["width"]), int(r["height"]), own)]})

    return planes.groupBy("id").applyInPandas(run, "id long, payload binary")


# pictures: planes of samples of any depth


class Picture:
    """Planes that are read and written in one domain, whatever they are stored in. A sample beyond the depth is refused."""

    def __init__(self, planes: list[np.ndarray], depth: int):
        self.planes, self.depth = [p.astype(np.uint32) for p in planes], depth
        if any(p.max(initial=0) >> depth for p in self.planes):
            raise PixelError("sample out of range")

    def _legal(self, v: np.ndarray | int) -> None:
        if np.max(v, initial=0) >> self.depth or np.min(v, initial=0) < 0:
            raise PixelError("sample out of range")

    def get(self, plane: int, x: int, y: int) -> int | None:
        if not 0 <= plane < len(self.planes) or not 0 <= y < self.planes[plane].shape[0] or not 0 <= x < self.planes[plane].shape[1]:
            return None
        return int(self.planes[plane][y, x])

    def put(self, plane: int, x: int, y: int, v: int) -> None:
        if self.get(plane, x, y) is None:
            raise PixelError("out of bounds")
        self._legal(v)
        self.planes[plane][y, x] = v

    def fill(self, plane: int, v: int, x0: int, y0: int, x1: int, y1: int) -> None:
        """A rectangle, clipped to the plane."""
        self._legal(v)
        self.planes[plane][max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = v

    def blit(self, plane: int, samples: np.ndarray, x: int, y: int) -> None:
        """Samples with their top left corner at (x, y), clipped to the plane."""
        self._legal(samples)
        h, w = self.planes[plane].shape
        x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + samples.shape[1]), min(h, y + samples.shape[0])
        if x0 < x1 and y0 < y1:
            self.planes[plane][y0:y1, x0:x1] = samples[y0 - y : y1 - y, x0 - x : x1 - x]
