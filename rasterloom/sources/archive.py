"""Archive manifests: what a container says of itself, its records, objects and frames, so that damage is found and named.

A manifest is bytes that end in a digest of all that came before. Verification goes through layers: what the header says, the
records, whether it decodes, the objects, the digest of the whole, and the frames; the first that fails names the status.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.digest import blake3
from . import container as c
from . import decode

MAGIC = b"MANIFEST"
# Version of manifests, code of grey samples, codes of the kinds of records, statuses in the order of the layers.
SCHEMA_VERSION, GRAY = 1, 0
KINDS = ("header", "object", "palette", "checkpoint", "interval", "integrity")
STATUSES = ("self_description_mismatch", "structural_mismatch", "stream_digest_mismatch", "object_mismatch", "frame_divergence", "complete")
HEAD, RECORD, OBJECT = "<HIBIIIBQQ32s32s", "<BIQQQ32s", "<I32s"
Digest = Callable[[bytes], bytes]


@dataclass
class Manifest:
    head: tuple  # version, universe, profile, features, width, height, pixel code
    frames: int
    length: int
    digest: bytes
    checkpoint: bytes
    records: list[tuple]  # kind, id, t, offset, length, digest
    objects: list[tuple]  # id, digest of its record
    frame_hashes: list[bytes]


def indexed(data: bytes, magic: bytes = c.MAGIC, digest: Digest = blake3) -> list[tuple]:
    """The top-level records with their digests; an id or time that a record lacks is 0."""
    return [(KINDS.index(kind), i or 0, t or 0, at, n, digest(data[at : at + n])) for kind, i, t, at, n in c.scan(data, magic)]


def _head(data: bytes, magic: bytes) -> tuple:
    return (*struct.unpack_from("<HIBIII", data, len(magic)), GRAY)


def _objects(data: bytes, magic: bytes, digest: Digest) -> list[tuple]:
    """Contents without their ids, so that equal contents have equal digests."""
    return [(i, digest(data[at : at + 1] + data[at + 5 : at + n])) for kind, i, _, at, n in c.scan(data, magic) if kind == "object"]


def build(data: bytes, magic: bytes = c.MAGIC, digest: Digest = blake3) -> Manifest:
    """Of a container that stands alone; one whose payloads are in a store is refused."""
    if c.features(data, magic) & c.EXTERNAL_OBJECTS:
        raise c.Breach("store-backed")
    frames = [digest(f.tobytes()) for f in decode.decode(data, magic)]
    end = next(at + n for kind, _, _, at, n in c.scan(data, magic) if kind == "checkpoint")
    return Manifest(_head(data, magic), len(frames), len(data), digest(data), digest(data[:end]), indexed(data, magic, digest), _objects(data, magic, digest), frames)


def pack(m: Manifest, digest: Digest = blake3) -> bytes:
    out = MAGIC + struct.pack("<I", SCHEMA_VERSION) + struct.pack(HEAD, *m.head, m.frames, m.length, m.digest, m.checkpoint)
    out += struct.pack("<I", len(m.records)) + b"".join(struct.pack(RECORD, *r) for r in m.records)
    out += struct.pack("<I", len(m.objects)) + b"".join(struct.pack(OBJECT, *o) for o in m.objects)
    out += struct.pack("<I", len(m.frame_hashes)) + b"".join(m.frame_hashes)
    return out + digest(out)


def unpack(data: bytes, digest: Digest = blake3) -> Manifest:
    """Raises Breach for a manifest that was changed, is cut short or is of another version."""
    if len(data) < 32 or digest(data[:-32]) != data[-32:]:
        raise c.Breach("digest")
    cur = c.Cursor(data, len(data) - 32)
    if cur.take(len(MAGIC)) != MAGIC:
        raise c.Breach("magic")
    if cur.pull("I") != [SCHEMA_VERSION]:
        raise c.Breach("unsupported version")
    head = struct.unpack(HEAD, cur.take(struct.calcsize(HEAD)))

    def listed(codes: str) -> list[tuple]:
        (n,) = cur.pull("I")
        size = struct.calcsize(codes)
        if n * size > cur.end - cur.at:
            raise c.Breach("count")
        return list(struct.iter_unpack(codes, cur.take(n * size)))

    records, objects, frames = listed(RECORD), listed(OBJECT), [h for (h,) in listed("<32s")]
    if not head[4] or not head[5] or head[6] != GRAY or cur.at != cur.end:
        raise c.Breach("not canonical")
    if len(frames) != head[7]:
        raise c.Breach("frame count")
    if any(r[0] >= len(KINDS) or not r[4] for r in records):
        raise c.Breach("record")
    return Manifest(head[:7], head[7], head[8], head[9], head[10], records, objects, frames)


@dataclass
class Report:
    status: str
    first_bad_record: int | None
    frames_checked: int
    first_bad_frame: int | None


def verify(data: bytes, m: Manifest, deep: bool = True, magic: bytes = c.MAGIC, digest: Digest = blake3) -> Report:
    """A container that is damaged is reported, not refused; only one whose records can't be followed raises Breach."""
    said = _head(data, magic) == m.head
    records = indexed(data, magic, digest)
    bad = next((i for i, (a, b) in enumerate(zip(records, m.records)) if a != b), None)
    whole = bad is None and len(records) == len(m.records)
    frames = []
    try:
        frames = [digest(f.tobytes()) for f in decode.decode(data, magic)]
        decodes = True
    except c.Breach:
        decodes = False
    objects = decodes and _objects(data, magic, digest) == m.objects
    differs = None
    if deep and said and whole and objects:
        differs = next((i for i, (a, b) in enumerate(zip(frames, m.frame_hashes)) if a != b), None)
        if differs is None and len(frames) != len(m.frame_hashes):
            differs = min(len(frames), len(m.frame_hashes))
    checks = (not said, not whole, not decodes, not objects, digest(data) != m.digest, differs is not None)
    names = ("self_description_mismatch", "structural_mismatch", "stream_digest_mismatch", "object_mismatch", "stream_digest_mismatch", "frame_divergence")
    status = next((n for n, failed in zip(names, checks) if failed), "complete")
    checked = 0 if not (deep and said and whole and objects) else len(frames) if differs is None else differs
    return Report(status, bad, checked, differs)


def archived(files: DataFrame, magic: bytes = c.MAGIC, digest: Digest = blake3) -> DataFrame:
    """`binaryFile` rows (path, content) with their manifests: path, content, manifest, error."""

    def run(batches):
        for pdf in batches:
            made, errors = [], []
            for data in pdf["content"]:
                try:
                    made.append(pack(build(bytes(data), magic, digest), digest))
                    errors.append(None)
                except c.Breach as e:
                    made.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": pdf["path"], "content": pdf["content"], "manifest": made, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, manifest binary, error string")


def verified(files: DataFrame, magic: bytes = c.MAGIC, deep: bool = True, digest: Digest = blake3) -> DataFrame:
    """(path, content, manifest): path, status, first_bad_record, first_bad_kind, frames_checked, first_bad_frame. What can't be
    followed at all has the breach as its status."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, data, manifest in zip(pdf["path"], pdf["content"], pdf["manifest"]):
                try:
                    m = unpack(bytes(manifest), digest)
                    r = verify(bytes(data), m, deep, magic, digest)
                    kind = None if r.first_bad_record is None else KINDS[m.records[r.first_bad_record][0]]
                    out.append((path, r.status, r.first_bad_record, kind, r.frames_checked, r.first_bad_frame))
                except c.Breach as e:
                    out.append((path, str(e), None, None, 0, None))
            names = ["path", "status", "first_bad_record", "first_bad_kind", "frames_checked", "first_bad_frame"]
            yield pd.DataFrame(out, columns=names).astype({"first_bad_record": "Int64", "first_bad_frame": "Int64"})

    schema = "path string, status string, first_bad_record long, first_bad_kind string, frames_checked long, first_bad_frame long"
    return files.select("path", "content", "manifest").mapInPandas(run, schema)


def record_rows(files: DataFrame, magic: bytes = c.MAGIC, digest: Digest = blake3) -> DataFrame:
    """The record index of `binaryFile` rows: path, ord, kind, id, t, offset, length, digest (hexadecimal), error."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, n, KINDS[r[0]], r[1], r[2], r[3], r[4], r[5].hex(), None) for n, r in enumerate(indexed(bytes(data), magic, digest))]
                except c.Breach as e:
                    rows = [(path, None, None, None, None, None, None, None, str(e))]
                names = ["path", "ord", "kind", "id", "t", "offset", "length", "digest", "error"]
                yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(("ord", "id", "t", "offset", "length"), "Int64"))

    return files.select("path", "content").mapInPandas(run, "path string, ord long, kind string, id long, t long, offset long, length long, digest string, error string")


# packets of a container, and containers of packets

PACKET = "<IBQ"
# Packet codes of the kinds of records.
CODES = {"header": 0x00, "object": 0x01, "palette": 0x02, "checkpoint": 0x03, "interval": 0x04, "integrity": 0x7E}


def packets(data: bytes, magic: bytes = c.MAGIC) -> list[tuple[int, str, bytes]]:
    """(seq, kind, frame): a packet's body is the record as it stands; the last one's is the digest."""
    if c.features(data, magic) & c.EXTERNAL_OBJECTS:
        raise c.Breach("store-backed")
    return [(seq, kind, struct.pack(PACKET, n + 9, CODES[kind], seq) + data[at : at + n]) for seq, (kind, _, _, at, n) in enumerate(c.scan(data, magic))]


def packetized(files: DataFrame, magic: bytes = c.MAGIC) -> DataFrame:
    """Packets of `binaryFile` rows: path, seq, kind, frame, error."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, *p, None) for p in packets(bytes(data), magic)]
                except c.Breach as e:
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "seq", "kind", "frame", "error"]).astype({"seq": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, seq long, kind string, frame binary, error string")


def reassembled(received: DataFrame, digest: Digest = blake3) -> DataFrame:
    """Received packets (path, seq, frame) put together again: path, packets applied before the first gap, complete (the digest
    came), verified (it is that of what came before), frames that can be played, content (with a digest of its own).

    A stream's packets are one task's work: the content is one value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("seq").sort_values("seq")
        prefix, seal, intervals, ready, n = b"", None, 0, False, 0
        for seq, frame in zip(pdf["seq"], pdf["frame"]):
            frame = bytes(frame)
            if seq != n or len(frame) < 13 or struct.unpack_from("<I", frame)[0] != len(frame) - 4:
                break
            n += 1
            if frame[4] == CODES["integrity"]:
                seal = frame[13:]
                break
            prefix += frame[13:]
            ready |= frame[4] == CODES["checkpoint"]
            intervals += frame[4] == CODES["interval"]
        good = seal is not None and digest(prefix) == seal
        content = prefix + digest(prefix) if ready else None
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "applied": [n], "complete": [seal is not None], "verified": [good], "playable": [1 + intervals if ready else 0], "content": [content]})

    return received.select("path", "seq", "frame").groupBy("path").applyInPandas(run, "path string, applied long, complete boolean, verified boolean, playable long, content binary")
