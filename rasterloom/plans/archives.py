"""Queries over the bytes of containers: marks, record indexes, manifests, packets, and what damage to them is found."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ..sources import archive, blobs, build, container, rewrite
from .adapters import LOG, read, spread
from .more import container_files


def sha(data: bytes) -> bytes:
    """The digest of these queries, which both engines have."""
    return hashlib.sha256(data).digest()


def marks(spark, sf_dir):
    """Containers of which every third is store-backed and every fifth is marked already: what marking them as quantised gives."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["p_partkey"]:
                made = container.write(64, 48, [(container.FILL, [1, 8, 6, int(k) % 256], b""), (container.CHECKPOINT, [0, 1, 1, 0, 0], b"")], [], (k % 3 == 0) * 1 | (k % 5 == 0) * 2)
                try:
                    new = container.marked_quantized(made)
                    rows.append((k, container.declares_quantized(new), next(container.read(new))[3][2], len(new) - len(made), None))
                except container.Breach as e:
                    rows.append((k, container.declares_quantized(made), container.features(made), 0, str(e)))
            yield pd.DataFrame(rows, columns=["p_partkey", "quantized", "features", "grown", "error"])

    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")).mapInPandas(run, "p_partkey long, quantized boolean, features int, grown int, error string")


MARKS = """SELECT s_suppkey AS p_partkey, s_suppkey % 3 <> 0 OR s_suppkey % 5 = 0 AS quantized, CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 2 WHEN s_suppkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS features, 0 AS grown,
CASE WHEN s_suppkey % 3 = 0 THEN 'store-backed' END AS error FROM supplier"""


def record_digests(spark, sf_dir):
    rows = archive.record_rows(container_files(spark, sf_dir), digest=sha)
    return rows.filter("kind = 'interval'").select("path", "ord", "t", "offset", "length", "digest")


_LE = lambda e: f"printf('%02X000000', CAST({e} AS INTEGER))"
_BYTES = f"""CASE op WHEN 'click' THEN '2201000000' || {_LE('x')} || {_LE('y')} WHEN 'purchase' THEN '2601000000' || {_LE('x')} || {_LE('y')}
 WHEN 'view' THEN '27' WHEN 'signup' THEN '2301000000' || {_LE('x')} || {_LE('y')} || '09' ELSE '29' END"""
_START = 25 + 14 + 22
RECORDS = f"""{LOG}, r AS (SELECT stream_id, t, '04' || printf('%02X%02X000000000000', CAST(t % 256 AS INTEGER), CAST(t // 256 AS INTEGER)) || '01000000' || {_BYTES} AS h FROM (SELECT *, event_id % 64 AS x, k % 48 AS y FROM ev)),
ix AS (SELECT stream_id, t, h, length(h) // 2 AS n, {_START} + coalesce(sum(length(h) // 2) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)"""
RECORD_DIGESTS = f"""WITH {RECORDS} SELECT CAST(stream_id AS VARCHAR) AS path, t + 2 AS ord, t, CAST(pos AS BIGINT) AS "offset", n AS length, sha256(unhex(h)) AS digest FROM ix"""


def manifests(spark, sf_dir):
    """Manifests of the containers, written and read again: how much they hold and how long they are."""
    made = archive.archived(container_files(spark, sf_dir), digest=sha)

    def run(batches):
        for pdf in batches:
            got = [archive.unpack(bytes(m), sha) for m in pdf["manifest"]]
            yield pd.DataFrame({"path": pdf["path"], "records": [len(m.records) for m in got], "objects": [len(m.objects) for m in got], "frames": [m.frames for m in got], "length": [m.length for m in got], "bytes": [len(m) for m in pdf["manifest"]]})

    return made.filter("error IS NULL").mapInPandas(run, "path string, records long, objects long, frames long, length long, bytes long")


MANIFESTS = f"""WITH {RECORDS} SELECT CAST(stream_id AS VARCHAR) AS path, count(*) + 4 AS records, CAST(1 AS BIGINT) AS objects, count(*) + 1 AS frames, CAST({_START + 32} + sum(n) AS BIGINT) AS length,
8 + 4 + 100 + 4 + 61 * (count(*) + 4) + 4 + 36 + 4 + 32 * (count(*) + 1) + 32 AS bytes FROM ix GROUP BY stream_id"""


def damaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Damage of eight kinds, by the stream."""
    content, manifest = [], []
    for path, data, packed in zip(pdf["path"], pdf["content"], pdf["manifest"]):
        data, m, kind = bytearray(data), archive.unpack(bytes(packed), sha), int(path) % 8
        spans = container.scan(bytes(data))
        if kind == 1:
            data[len(container.MAGIC) + 7] ^= 2  # a feature bit
        elif kind == 2:
            data[spans[5][3] + 2] ^= 1  # the time of the third interval
        elif kind == 3:
            data[-1] ^= 1
        elif kind == 4:
            m.digest = bytes(32)
        elif kind == 5:
            m.objects = [(m.objects[0][0], bytes(32))]
        elif kind == 6:
            m.frame_hashes[2] = bytes(32)
        elif kind == 7:
            del data[40:]
        content.append(bytes(data))
        manifest.append(archive.pack(m, sha))
    return pd.DataFrame({"path": pdf["path"], "content": content, "manifest": manifest})


def layered_status(spark, sf_dir):
    """Containers and manifests with damage of eight kinds: the status that verification finds, and the first bad record or frame."""
    made = archive.archived(container_files(spark, sf_dir), digest=sha)

    def run(batches):
        for pdf in batches:
            yield damaged(pdf)

    harmed = made.select("path", "content", "manifest").mapInPandas(run, "path string, content binary, manifest binary")
    return archive.verified(harmed, digest=sha)


LAYERED_STATUS = f"""WITH {LOG}, s AS (SELECT stream_id, count(*) AS n, stream_id % 8 AS k FROM ev GROUP BY stream_id)
SELECT CAST(stream_id AS VARCHAR) AS path,
 CASE k WHEN 0 THEN 'complete' WHEN 1 THEN 'self_description_mismatch' WHEN 2 THEN 'structural_mismatch' WHEN 3 THEN 'structural_mismatch'
 WHEN 4 THEN 'stream_digest_mismatch' WHEN 5 THEN 'object_mismatch' WHEN 6 THEN 'frame_divergence' ELSE 'truncated' END AS status,
 CASE k WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN n + 3 END AS first_bad_record, CASE k WHEN 1 THEN 'header' WHEN 2 THEN 'interval' WHEN 3 THEN 'integrity' END AS first_bad_kind,
 CASE WHEN k IN (0, 4) THEN n + 1 WHEN k = 6 THEN 2 ELSE 0 END AS frames_checked, CAST(CASE WHEN k = 6 THEN 2 END AS BIGINT) AS first_bad_frame FROM s"""


def packetize(spark, sf_dir):
    """Packets of the containers: what kind and how long each is, framing included, and the digest of its body."""
    rows = archive.packetized(container_files(spark, sf_dir))
    body = F.expr("substring(frame, 14)")
    return rows.filter("error IS NULL").select("path", "seq", "kind", F.octet_length("frame").cast("long").alias("framed"), F.when(F.col("kind") == "interval", F.sha2(body, 256)).alias("digest"))


PACKETIZE = f"""WITH {RECORDS}, m AS (SELECT stream_id, count(*) AS n FROM ix GROUP BY stream_id)
SELECT CAST(stream_id AS VARCHAR) AS path, t + 2 AS seq, 'interval' AS kind, n + 13 AS framed, sha256(unhex(h)) AS digest FROM ix
UNION ALL SELECT CAST(stream_id AS VARCHAR), seq, kind, framed, NULL FROM m, (VALUES (0, 'header', 38), (1, 'object', 27), (2, 'checkpoint', 35)) v(seq, kind, framed)
UNION ALL SELECT CAST(stream_id AS VARCHAR), n + 3, 'integrity', 45, NULL FROM m"""


def prefix_digests(spark, sf_dir):
    """Packets of which some streams lose the sixth, some have a changed byte, some lose the digest: what is put together again."""
    rows = archive.packetized(container_files(spark, sf_dir)).filter("error IS NULL").withColumn("k", F.col("path").cast("long") % 4)
    rows = rows.filter(~((F.col("k") == 1) & (F.col("seq") == 5)) & ~((F.col("k") == 3) & (F.col("kind") == "integrity")))
    rows = rows.withColumn("frame", F.when((F.col("k") == 2) & (F.col("seq") == 4), F.concat(F.expr("substring(frame, 1, octet_length(frame) - 1)"), F.unhex(F.lit("FE")))).otherwise(F.col("frame")))
    return archive.reassembled(rows).select("path", "applied", "complete", "verified", "playable", F.octet_length("content").cast("long").alias("bytes"))


PREFIX_DIGESTS = f"""WITH {RECORDS}, m AS (SELECT stream_id, stream_id % 4 AS k, count(*) AS n, CAST(sum(n) AS BIGINT) AS b, CAST(sum(n) FILTER (t < 3) AS BIGINT) AS early FROM ix GROUP BY stream_id)
SELECT CAST(stream_id AS VARCHAR) AS path, CASE k WHEN 1 THEN 5 WHEN 3 THEN n + 3 ELSE n + 4 END AS applied, k IN (0, 2) AS complete, k = 0 AS verified, CASE WHEN k = 1 THEN 3 ELSE n + 1 END AS playable,
{_START + 32} + CASE WHEN k = 1 THEN early ELSE b END AS bytes FROM m"""

def _with_rasters(spark, sf_dir):
    """A container for each supplier: a raster of one of twenty contents, a fill of one of seven, both placed."""

    def run(batches):
        for pdf in batches:
            made = []
            for s in pdf["s_suppkey"]:
                raster = bytes((x * 7 + y * 11 + s % 20) % 256 for y in range(4) for x in range(6))
                records = [(container.RASTER, [1, 6, 4], raster), (container.FILL, [2, 3, 3, int(s) % 7], b""), (container.CHECKPOINT, [0, 1, 1, 0, 0, 2, 2, 5, 5], b"")]
                made.append(container.write(16, 12, records, [(1, [(0x22, [1, int(s) % 9, 2], b"")])]))
            yield pd.DataFrame({"path": pdf["s_suppkey"].astype(str), "content": made})

    return read(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "path string, content binary")


def external_store(spark, sf_dir):
    """Containers whose payloads move to a store: what the store holds, and how often each content is referred to."""
    out = blobs.outsourced(_with_rasters(spark, sf_dir), digest=sha).select(F.explode("payloads").alias("p")).select("p.cid", "p.payload")
    return out.groupBy("cid").agg(F.count("*").alias("references"), F.max(F.octet_length("payload")).cast("long").alias("bytes"))


_RASTER = "'01' || '0600000004000000' || (SELECT string_agg(printf('%02X', CAST((x * 7 + y * 11 + k) % 256 AS INTEGER)), '' ORDER BY y, x) FROM range(0, 6) a(x), range(0, 4) b(y))"
EXTERNAL_STORE = f"""WITH r AS (SELECT k, {_RASTER} AS h FROM range(0, 20) q(k)),
c AS (SELECT h FROM supplier JOIN r ON k = s_suppkey % 20 UNION ALL SELECT '02' || '0300000003000000' || printf('%02X', CAST(s_suppkey % 7 AS INTEGER)) FROM supplier)
SELECT sha256(unhex(h)) AS cid, count(*) AS "references", CAST(any_value(length(h) // 2) AS BIGINT) AS bytes FROM c GROUP BY h"""


def external_fetch(spark, sf_dir):
    """Containers resolved against a store that has lost one content and has a changed byte in another."""
    own = _with_rasters(spark, sf_dir)
    out = blobs.outsourced(own, digest=sha)
    store = out.select(F.explode("payloads").alias("p")).select("p.cid", "p.payload").dropDuplicates(["cid"])
    lost = F.sha2(F.unhex(F.lit("02030000000300000003")), 256)
    bad = F.sha2(F.unhex(F.lit("02030000000300000005")), 256)
    store = store.filter(F.col("cid") != lost).withColumn("payload", F.when(F.col("cid") == bad, F.unhex(F.lit("02030000000300000006"))).otherwise(F.col("payload")))
    got = blobs.fetched(out.select("path", "content"), store, digest=sha)
    same = got.join(own.select("path", F.col("content").alias("was")), "path")
    # sealed by another digest than the original: all but the last 32 bytes must be equal
    body = lambda c: F.expr(f"substring({c}, 1, octet_length({c}) - 32)")
    return same.select("path", "error", (body("content") == body("was")).alias("exact"))


EXTERNAL_FETCH = "SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE s_suppkey % 7 WHEN 3 THEN 'missing' WHEN 5 THEN 'integrity' END AS error, CASE WHEN s_suppkey % 7 NOT IN (3, 5) THEN true END AS exact FROM supplier"


def store_logs(spark, sf_dir):
    """Store logs of which some are damaged: what opening them finds."""

    def run(batches):
        for pdf in batches:
            made = []
            for s in pdf["s_suppkey"]:
                log, _ = blobs.appended(b"", [b"a" * (int(s) % 11), b"b%d" % s, b"a" * (int(s) % 11)], sha)
                again = log + log[5:] if s % 5 == 1 else log[:-1] if s % 5 == 2 else log[:-1] + b"x" if s % 5 == 3 else b"X" + log[1:] if s % 5 == 4 else log
                made.append(again)
            yield pd.DataFrame({"path": pdf["s_suppkey"].astype(str), "content": made})

    logs = read(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "path string, content binary")
    rows = blobs.records(logs, sha)
    return rows.groupBy("path").agg(F.max("error").alias("error"), F.count("cid").alias("records"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


STORE_LOGS = """SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE s_suppkey % 5 WHEN 1 THEN 'twice' WHEN 2 THEN 'truncated' WHEN 3 THEN 'integrity' WHEN 4 THEN 'bad header' END AS error,
CAST(CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS records, CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 11 + 1 + length(CAST(s_suppkey AS VARCHAR)) ELSE 0 END AS BIGINT) AS bytes FROM supplier"""


def store_put_get(spark, sf_dir):
    """Texts put into a store that has those of English documents; then every document asks for its own, with a bound."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    have = docs.filter("lang = 'en'").select(F.sha2("payload", 256).alias("cid"), "payload").dropDuplicates(["cid"])
    fresh = blobs.put(have, docs.select(F.col("doc_id").alias("seq"), "payload"))
    whole = have.unionByName(fresh.select("cid", "payload"))
    got = blobs.get(whole, docs.select(F.col("doc_id").alias("name"), F.sha2("payload", 256).alias("cid")), 4000)
    return got.select(F.col("name").alias("doc_id"), "cid", "error", F.octet_length("payload").cast("long").alias("bytes")).join(fresh.select(F.col("seq").alias("doc_id"), F.lit(True).alias("brought")), "doc_id", "left")


STORE_PUT_GET = """WITH d AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS cid, strlen(coalesce(text, '')) AS n FROM documents),
f AS (SELECT min(doc_id) AS doc_id FROM d WHERE cid NOT IN (SELECT cid FROM d WHERE lang = 'en') GROUP BY cid)
SELECT doc_id, cid, CASE WHEN n > 4000 THEN 'too large' END AS error, CAST(CASE WHEN n <= 4000 THEN n END AS BIGINT) AS bytes, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN true END AS brought FROM d"""

def built(spark, sf_dir):
    """Containers built step by step; for every tenth supplier a step is out of range."""

    def run(batches):
        for pdf in batches:
            rows = []
            for s in pdf["s_suppkey"].tolist():
                try:
                    b = build.Builder(64, 48, s % 256).fill(1, 8, 6, s % 251).instance(1, 1, s % 50, 3)
                    for t in range(1, 3 + s % 5):
                        b.at(2 * t).move(1, (1 << 25) if s % 10 == 0 else s * t % 64, t)
                        if (s + t) % 3 == 0:
                            b.at(2 * t).patch([(t, 1, 9), (t, 2, 9)]).clear_overlay()
                    data = b.finish()
                    rows.append((s, len(data), sum(1 for r in container.read(data) if r[1] == container.GROUP), b.counts["move"], b.counts["patch"], None))
                except build.BuildError as e:
                    rows.append((s, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["s_suppkey", "bytes", "groups", "moves", "patches", "error"]).astype(dict.fromkeys(("bytes", "groups", "moves", "patches"), "Int64"))

    return read(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, "s_suppkey long, bytes long, groups long, moves long, patches long, error string")


BUILT = f"""WITH g AS (SELECT s_suppkey, unnest(range(1, 3 + s_suppkey % 5)) AS t FROM supplier WHERE s_suppkey % 10 <> 0)
SELECT s_suppkey, CAST({_START + 32} + sum(13 + 13 + CASE WHEN (s_suppkey + t) % 3 = 0 THEN 5 + 18 + 1 ELSE 0 END) AS BIGINT) AS bytes, count(*) AS groups, count(*) AS moves, count(*) FILTER ((s_suppkey + t) % 3 = 0) AS patches, CAST(NULL AS VARCHAR) AS error FROM g GROUP BY s_suppkey
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, 'coordinate out of range' FROM supplier WHERE s_suppkey % 10 = 0"""


def collapsed(spark, sf_dir):
    """Containers whose placements follow a line, a curve, two lines or nothing, with programs in their place: bytes before and after.
    A container is kept as it is where no program is shorter; every result is decoded and compared."""

    def run(batches):
        for pdf in batches:
            made = []
            for s in pdf["s_suppkey"].tolist():
                n = 4 + s % 7
                spot = {0: lambda k: (2 * k, k), 1: lambda k: (k * (k - 1) // 2, k), 2: lambda k: (min(k, 3), 0), 3: lambda k: (k * k * k % 17, 0)}[s % 4]
                groups = [(k, [(0x22, [1, *spot(k)], b"")]) for k in range(1, n + 1)]
                made.append(container.write(64, 48, [(container.FILL, [1, 8, 6, 200], b""), (container.CHECKPOINT, [0, 1, 1, 0, 0], b"")], groups))
            yield pd.DataFrame({"path": pdf["s_suppkey"].astype(str), "content": made})

    files = spread(read(spark, sf_dir, "supplier").select("s_suppkey")).mapInPandas(run, "path string, content binary")
    return rewrite.optimize(files, rewrite=rewrite.collapsed).select(F.col("path").cast("long").alias("s_suppkey"), "before", "after", "error")


COLLAPSED = f"""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS kind, 4 + s_suppkey % 7 AS n FROM supplier), k AS (SELECT s_suppkey, kind, n, unnest(range(0, n + 1)) AS k FROM s),
p AS (SELECT s_suppkey, kind, n, list(CASE kind WHEN 0 THEN 2 * k WHEN 1 THEN k * (k - 1) // 2 WHEN 2 THEN least(k, 3) ELSE k * k * k % 17 END ORDER BY k) AS x FROM k GROUP BY ALL),
d AS (SELECT *, [x[i + 1] - x[i] FOR i IN range(1, n + 1)] AS d FROM p), e AS (SELECT *, 1 + len([1 FOR i IN range(1, n) IF d[i + 1] <> d[i]]) AS runs FROM d),
b AS (SELECT *, {_START + 32} + 26 * n AS before, CASE WHEN kind = 1 THEN 9 + 25 ELSE 9 + 17 * runs END AS program FROM e)
SELECT s_suppkey, CAST(before AS BIGINT) AS before, CAST(CASE WHEN 14 * n + program + 1 < 26 * n THEN {_START + 32} + 14 * n + program ELSE before END AS BIGINT) AS after, CAST(NULL AS VARCHAR) AS error FROM b"""

_ALL = {
    "o15_1_builder": (built, BUILT),
    "o10_8_collapse": (collapsed, COLLAPSED),
    "o1_6_external_store": (external_store, EXTERNAL_STORE),
    "o1_2_external_fetch": (external_fetch, EXTERNAL_FETCH),
    "o11_7_store_logs": (store_logs, STORE_LOGS),
    "o1_19_store_put_get": (store_put_get, STORE_PUT_GET),
    "o1_7_mark_quantized": (marks, MARKS),
    "o11_8_record_digests": (record_digests, RECORD_DIGESTS),
    "o1_20_manifests": (manifests, MANIFESTS),
    "o11_11_layered_status": (layered_status, LAYERED_STATUS),
    "o12_1_packetize": (packetize, PACKETIZE),
    "o12_7_prefix_digests": (prefix_digests, PREFIX_DIGESTS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
