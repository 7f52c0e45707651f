"""Queries of the multi-plane domain and of its prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, court, paint, store, transport
from .adapters import BOXES, FRAMES, HEIGHT, WIDTH, boxes, frames, read
from .search import COURT


def plane_paint(spark, sf_dir):
    """Boxes on a 10-bit picture whose second and third plane are halved: every plane is painted by the same operator."""
    planes = F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), F.lit(s).alias("s")) for p, s in ((0, 0), (1, 1), (2, 1))]))
    cut = lambda c: F.call_function("shiftright", F.col(c), F.col("s")).cast("long")
    rows = boxes(spark, sf_dir).withColumn("p", planes).select("*", "p.plane", "p.s")
    rows = rows.withColumns({"x": cut("x"), "y": cut("y"), "w": scalar.plane_length(F.col("w"), F.col("s")), "h": scalar.plane_length(F.col("h"), F.col("s")), "v": F.col("v") * 4 + F.col("plane")})
    top = paint.fill_paint(rows.filter("plane = 0"), (0, 0, WIDTH, HEIGHT), ["stream_id", "plane"]).unionByName(paint.fill_paint(rows.filter("plane > 0"), (0, 0, WIDTH // 2, HEIGHT // 2), ["stream_id", "plane"]))
    return paint.checksum(top, ["stream_id", "plane"], WIDTH)


PLANE_PAINT = f"""WITH {BOXES}, p(plane, d) AS (VALUES (0, 1), (1, 2), (2, 2)), b AS (SELECT stream_id, plane, d, z, CAST(floor(x / d) AS BIGINT) AS x, CAST(floor(y / d) AS BIGINT) AS y, CAST(ceil(w / d) AS BIGINT) AS w, CAST(ceil(h / d) AS BIGINT) AS h, v * 4 + plane AS v FROM bx, p),
w AS (SELECT b.stream_id, plane, px, py, arg_max(v, z) AS v FROM b, range(0, 64) a(px), range(0, 48) c(py) WHERE px >= x AND px < x + w AND py >= y AND py < y + h AND px < 64 // d AND py < 48 // d GROUP BY ALL)
SELECT stream_id, plane, count(*) AS n, CAST(sum(v * (py * 64 + px + 1)) AS BIGINT) AS weighted FROM w GROUP BY ALL"""


def registry(spark, sf_dir):
    """Sources of one map at 8, 12 and 16 fractional bits."""
    k = F.col("p_partkey")
    x, y = k % 64, k * 3 % 48
    rows = [F.shiftright(((1 << s) - 3) * x + (k % 9 - 4) * y + (k * 101 % 4096 - 2048), s).alias(f"q{s}") for s in (8, 12, 16)]
    return read(spark, sf_dir, "part").select("p_partkey", *rows)


REGISTRY = "SELECT p_partkey, " + ", ".join(f"CAST(floor(({(1 << s) - 3} * (p_partkey % 64) + (p_partkey % 9 - 4) * (p_partkey * 3 % 48) + (p_partkey * 101 % 4096 - 2048)) / {1 << s}) AS BIGINT) AS q{s}" for s in (8, 12, 16)) + " FROM part"


def precision(spark, sf_dir):
    """The cheapest precision of a map: finer ones cost more bytes and leave fewer samples to correct; ties go to the coarser."""
    k = F.col("p_partkey")
    tries = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), (30 + s // 4 * 2 + 10 * F.greatest(F.lit(0), k % 40 - 2 * s)).cast("long").alias("bytes")) for s in (8, 12, 16)])).alias("t"))
    return tries.groupBy("p_partkey").agg(F.min(F.struct("t.bytes", "t.shift")).alias("b")).select("p_partkey", "b.shift", "b.bytes")


PRECISION = """WITH t AS (SELECT p_partkey, s, CAST(30 + s // 4 * 2 + 10 * greatest(0, p_partkey % 40 - 2 * s) AS BIGINT) AS bytes FROM part, (VALUES (8), (12), (16)) v(s))
SELECT p_partkey, CAST(arg_min(s, bytes * 100 + s) AS INTEGER) AS shift, min(bytes) AS bytes FROM t GROUP BY p_partkey"""


def floor_ingest(spark, sf_dir):
    """Residual (10 bytes a sample and 64) against replacement (the plane and 90): the residual must be strictly cheaper."""
    rows = compare.with_previous(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 5))).filter("frame > 0").groupBy("stream_id", "frame").agg(F.count(F.when(F.col("v") != F.col("prev"), 1)).alias("k"))
    residual, whole = 10 * F.col("k") + 64, F.lit(64 + 90)
    pick = F.when(F.col("k") == 0, "repeat").when(residual < whole, "residual").otherwise("raster")
    return rows.groupBy("stream_id", pick.alias("pick")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("k") == 0, 12).when(residual < whole, residual).otherwise(whole)).cast("long").alias("bytes"))


FLOOR_INGEST = f"""WITH {FRAMES}, d AS (SELECT a.stream_id, a.frame, count(*) FILTER (a.v // 32 <> b.v // 32) AS k FROM fr a JOIN fr b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND b.x = a.x AND b.y = a.y GROUP BY ALL),
c AS (SELECT stream_id, CASE WHEN k = 0 THEN 'repeat' WHEN k < 9 THEN 'residual' ELSE 'raster' END AS pick, CASE WHEN k = 0 THEN 12 WHEN k < 9 THEN 10 * k + 64 ELSE 154 END AS b FROM d)
SELECT stream_id, pick, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM c GROUP BY ALL"""


def family_totals(spark, sf_dir):
    return court.winners(court.candidates(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 5)), 64)).groupBy("family").agg(F.count("*").alias("frames"), F.sum("payload").alias("bytes"))


FAMILY_TOTALS = f"""WITH {COURT}, w AS (SELECT family, payload FROM c WHERE valid QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY payload, ord) = 1)
SELECT family, count(*) AS frames, CAST(sum(payload) AS BIGINT) AS bytes FROM w GROUP BY family"""


def labels(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", transport.label(F.col("p_partkey") % 24 + 0x1F, transport.EVENTS).alias("event"), transport.label(F.col("p_partkey") % 7, transport.KINDS).alias("kind"))
    return rows.groupBy("event", "kind").agg(F.count("*").alias("n"))


_EVENTS = ", ".join(f"({k}, '{v}')" for k, v in transport.EVENTS.items())
_KINDS = ", ".join(f"({k}, '{v}')" for k, v in transport.KINDS.items())
LABELS = f"""WITH e(t, event) AS (VALUES {_EVENTS}), k(t, kind) AS (VALUES {_KINDS})
SELECT coalesce(event, 'unknown') AS event, coalesce(kind, 'unknown') AS kind, count(*) AS n FROM part LEFT JOIN e ON e.t = p_partkey % 24 + 31 LEFT JOIN k ON k.t = p_partkey % 7 GROUP BY ALL"""


def identities(spark, sf_dir):
    """Canonical ids of objects, and how often each content is declared."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(store.content_id(k % 3, k % 5, k % 2, F.col("p_brand").cast("binary")).alias("cid"))
    return rows.groupBy("cid").agg(F.count("*").alias("declared"))


IDENTITIES = "SELECT sha256((p_partkey % 3) || ':' || (p_partkey % 5) || ':' || (p_partkey % 2) || ':' || p_brand) AS cid, count(*) AS declared FROM part GROUP BY cid"


def trailers(spark, sf_dir):
    """Payloads with a digest at their end, every tenth damaged: which still verify."""
    k = F.col("doc_id")
    body = F.coalesce("text", F.lit("")).cast("binary")
    sealed = F.concat(F.when(k % 10 == 3, F.concat(body, F.lit("x").cast("binary"))).otherwise(body), F.unhex(F.sha2(body, 256)))
    rows = read(spark, sf_dir, "documents").select("doc_id", sealed.alias("s"))
    good = F.sha2(F.expr("substring(s, 1, octet_length(s) - 32)"), 256) == F.lower(F.hex(F.expr("substring(s, octet_length(s) - 31, 32)")))
    return rows.select("doc_id", good.alias("intact"))


TRAILERS = "SELECT doc_id, doc_id % 10 <> 3 AS intact FROM documents"

_ALL = {
    "o3_11_plane_paint": (plane_paint, PLANE_PAINT),
    "o4_3_map_registry": (registry, REGISTRY),
    "o8_16_precision_pricing": (precision, PRECISION),
    "o8_17_floor_ingest": (floor_ingest, FLOOR_INGEST),
    "o8_19_family_totals": (family_totals, FAMILY_TOTALS),
    "o11_1_canonical_ids": (identities, IDENTITIES),
    "o11_12_trailer_verify": (trailers, TRAILERS),
    "o12_9_event_labels": (labels, LABELS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
