"""A store of contents: a log of records (digest, length, payload), what is put into and got from it, and containers whose payloads
are in it."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import blake3
from . import container as c
from . import rewrite

Digest = Callable[[bytes], bytes]
MAGIC, VERSION = b"BLOB", 1
# Bytes of a record's digest and length, largest payload.
FRAMING, LARGEST = 40, 1 << 28


class StoreError(ValueError):
    """What is wrong with a store or a request."""


def content(record: tuple) -> bytes:
    """The canonical form of an object record (tag, arguments, data): without its id."""
    tag, args, data = record
    whole = c.record(tag, args, data)
    return whole[:1] + whole[5:]


# the log


def appended(log: bytes, payloads: list[bytes], digest: Digest = blake3) -> tuple[bytes, list[tuple[bytes, bool]]]:
    """The log with those payloads that it lacks, and for each payload its id and whether it was new."""
    index, out, log = {cid for cid, _, _ in opened(log, digest)}, [], log or MAGIC + bytes([VERSION])
    for p in payloads:
        if len(p) > LARGEST:
            raise StoreError("payload too large")
        cid = digest(p)
        out.append((cid, cid not in index))
        if cid not in index:
            index.add(cid)
            log += cid + struct.pack("<Q", len(p)) + p
    return log, out


def opened(log: bytes, digest: Digest = blake3) -> list[tuple[bytes, int, int]]:
    """(id, offset, length of the payload) of each record; every payload is held against its id."""
    if not log:
        return []
    if log[: len(MAGIC)] != MAGIC or len(log) < len(MAGIC) + 1 or log[len(MAGIC)] != VERSION:
        raise StoreError("bad header")
    at, seen, out = len(MAGIC) + 1, set(), []
    while at < len(log):
        if len(log) - at < FRAMING:
            raise StoreError("truncated")
        cid, (n,) = log[at : at + 32], struct.unpack_from("<Q", log, at + 32)
        if n > LARGEST or at + FRAMING + n > len(log):
            raise StoreError("truncated")
        if digest(log[at + FRAMING : at + FRAMING + n]) != cid:
            raise StoreError("integrity")
        if cid in seen:
            raise StoreError("twice")
        seen.add(cid)
        out.append((cid, at, n))
        at += FRAMING + n
    return out


def records(logs: DataFrame, digest: Digest = blake3) -> DataFrame:
    """Records of logs (path, content) as rows: path, cid (hexadecimal), offset, length, payload, error. A log is one task's work."""

    def run(batches):
        for pdf in batches:
            for path, log in zip(pdf["path"], pdf["content"]):
                log = bytes(log)
                try:
                    rows = [(path, cid.hex(), at, n, log[at + FRAMING : at + FRAMING + n], None) for cid, at, n in opened(log, digest)]
                except StoreError as e:
                    rows = [(path, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "cid", "offset", "length", "payload", "error"]).astype({"offset": "Int64", "length": "Int64"})

    return logs.select("path", "content").mapInPandas(run, "path string, cid string, offset long, length long, payload binary, error string")


# the store as a table (cid, payload)


def put(store: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads (seq, payload) as rows to add to a store: cid, payload, seq of the first to bring it. What the store has is left out.

    The digest is SHA-256, so that nothing leaves the JVM. A frequent payload is reduced to its first before anything is joined."""
    named = payloads.select("seq", "payload", F.sha2("payload", 256).alias("cid"))
    first = named.groupBy("cid").agg(F.min_by("payload", "seq").alias("payload"), F.min("seq").alias("seq"))
    return first.join(store.select("cid"), "cid", "left_anti")


def get(store: DataFrame, wanted: DataFrame, most: int = LARGEST) -> DataFrame:
    """wanted (name, cid) with payload, or an error: missing, too large, or a payload that isn't that of its id."""
    rows = wanted.join(store.select("cid", F.col("payload").alias("found")), "cid", "left")
    error = F.when(F.col("found").isNull(), "missing").when(F.octet_length("found") > most, "too large").when(F.sha2("found", 256) != F.col("cid"), "integrity")
    return rows.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), F.col("found"))).drop("found")


# containers whose payloads are in a store


def externalized(data: bytes, magic: bytes = c.MAGIC, digest: Digest = blake3) -> tuple[bytes, list[bytes]]:
    """The container with references in place of its objects' payloads, and the payloads."""
    head, records, groups = rewrite.parts(data, magic)
    out, payloads = [], []
    for tag, args, body in records:
        if tag in (c.RASTER, c.INDEX, c.GENERATOR, c.FILL):
            payloads.append(content((tag, args, body)))
            out.append((c.EXTERNAL, args[:3], digest(payloads[-1])))
        else:
            out.append((tag, args, body))
    return c.write(head[0], head[1], out, groups, head[2] | c.EXTERNAL_OBJECTS, magic, digest), payloads


def resolved(data: bytes, lookup: Callable[[bytes], bytes | None], magic: bytes = c.MAGIC, digest: Digest = blake3) -> bytes:
    """The inverse: every reference is looked up and its payload held against it."""
    head, out, groups = [], [], []
    for n, tag, t, args, body, _, _ in c.read(data, magic, digest):
        if n == 0:
            head = args
        elif t is None and tag == c.EXTERNAL:
            found = lookup(body)
            if found is None:
                raise StoreError("missing")
            if digest(found) != body:
                raise StoreError("integrity")
            whole = found[:1] + struct.pack("<I", args[0]) + found[1:]
            cur = c.Cursor(whole, len(whole))
            (kind,) = cur.pull("B")
            own, samples = c._record(cur, kind)
            if own[1:3] != args[1:3] or cur.at != len(whole):
                raise StoreError("another object")
            out.append((kind, own, samples))
        elif t is None:
            out.append((tag, args, body))
        elif tag == c.GROUP:
            groups.append((t, []))
        else:
            groups[-1][1].append((tag, args, body))
    return c.write(head[0], head[1], out, groups, head[2] & ~c.EXTERNAL_OBJECTS, magic, digest)


def outsourced(files: DataFrame, magic: bytes = c.MAGIC, digest: Digest = blake3) -> DataFrame:
    """`binaryFile` rows (path, content) with references: path, content, payloads (array of struct cid, payload)."""

    def run(batches):
        for pdf in batches:
            made = [externalized(bytes(d), magic, digest) for d in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "content": [m[0] for m in made], "payloads": [[{"cid": digest(p).hex(), "payload": p} for p in m[1]] for m in made]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, payloads array<struct<cid: string, payload: binary>>")


def references(files: DataFrame, magic: bytes = c.MAGIC, digest: Digest = blake3) -> DataFrame:
    """(path, cid): what each container refers to."""

    def run(batches):
        for pdf in batches:
            rows = [(p, r[4].hex()) for p, d in zip(pdf["path"], pdf["content"]) for r in c.read(bytes(d), magic, digest) if r[1] == c.EXTERNAL and r[2] is None]
            yield pd.DataFrame(rows, columns=["path", "cid"])

    return files.select("path", "content").mapInPandas(run, "path string, cid string")


def fetched(files: DataFrame, store: DataFrame, magic: bytes = c.MAGIC, digest: Digest = blake3) -> DataFrame:
    """Containers with their payloads again: path, content, error. References meet the store (cid, payload) in a join; a container
    gets only what it asks for."""
    held = references(files, magic, digest).distinct().join(store.select("cid", "payload"), "cid").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("cid", "payload"))).alias("held"))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data, own in zip(pdf["path"], pdf["content"], pdf["held"]):
                own = dict(own or {})
                try:
                    rows.append((path, resolved(bytes(data), lambda b, own=own: None if own.get(b.hex()) is None else bytes(own[b.hex()]), magic, digest), None))
                except (StoreError, c.Breach) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").join(held, "path", "left").mapInPandas(run, "path string, content binary, error string")

