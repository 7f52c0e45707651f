"""Queries of identity, transport, regions, lossy coding, codecs and media geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import codec, lossy, media, region, store, transport
from .adapters import ALL_PACKETS, BLOBS, FRAMES, LOG, PACKETS, blobs, frames, log, packets, read


def dedup(spark, sf_dir):
    return store.contents(blobs(spark, sf_dir))


DEDUP = f"WITH {BLOBS} SELECT cid, count(*) AS declared, min(seq) AS first, max(bytes) AS bytes FROM bl GROUP BY cid"


def publish(spark, sf_dir):
    return store.published(blobs(spark, sf_dir))


PUBLISH = f"""WITH {BLOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY seq) = 1 AS new FROM bl)
SELECT root, count(*) FILTER (new) AS new, count(*) FILTER (NOT new) AS reused, CAST(coalesce(sum(bytes) FILTER (new), 0) AS BIGINT) AS stored FROM n GROUP BY root"""


def accounting(spark, sf_dir):
    return store.accounting(blobs(spark, sf_dir))


ACCOUNTING = f"""WITH {BLOBS}, u AS (SELECT DISTINCT cid, bytes FROM bl) SELECT CAST((SELECT sum(bytes) FROM bl) AS BIGINT) AS declared_bytes, CAST(sum(bytes) AS BIGINT) AS unique_bytes, count(*) AS objects,
CAST(sum(bytes + 40) AS BIGINT) AS physical_bytes, CAST(greatest(0, (SELECT sum(bytes) FROM bl) - sum(bytes)) AS BIGINT) AS saved_bytes FROM u"""


def collect(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    live = rows.select("root").distinct().filter("root IN ('src1', 'src5', 'src9')")
    return store.collected(rows, live).groupBy("live").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))


COLLECT = f"""WITH {BLOBS}, c AS (SELECT cid, any_value(bytes) AS bytes, bool_or(root IN ('src1', 'src5', 'src9')) AS live FROM bl GROUP BY cid)
SELECT live, count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY live"""


def missing(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    return store.missing(rows, rows.filter("seq % 3 <> 0")).select("root", "seq")


MISSING = f"WITH {BLOBS} SELECT root, seq FROM bl a WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE b.cid = a.cid AND b.seq % 3 <> 0)"


def offsets(spark, sf_dir):
    rows = blobs(spark, sf_dir).select(F.col("root").alias("stream_id"), F.col("seq").alias("ord"), (F.col("bytes") + 13).alias("length"))
    return store.record_index(rows)


OFFSETS = f"WITH {BLOBS} SELECT a.root AS stream_id, a.seq AS ord, a.bytes + 13 AS length, CAST((SELECT coalesce(sum(b.bytes + 13), 0) FROM bl b WHERE b.root = a.root AND b.seq < a.seq) AS BIGINT) AS \"offset\" FROM bl a"


def merge(spark, sf_dir):
    return store.merged(blobs(spark, sf_dir)).filter("seq <> keeps").select("root", "seq", "keeps")


MERGE = f"WITH {BLOBS} SELECT a.root, a.seq, min(b.seq) AS keeps FROM bl a JOIN bl b ON a.root = b.root AND a.cid = b.cid WHERE b.seq < a.seq GROUP BY ALL"


def verify(spark, sf_dir):
    want = blobs(spark, sf_dir).select(F.col("root").alias("stream_id"), F.col("seq").alias("ord"), F.col("cid").alias("digest"))
    got = want.filter("ord % 211 <> 7").withColumn("digest", F.when(F.col("ord") % 97 == 5, "changed").otherwise(F.col("digest")))
    return store.verified(want, got)


VERIFY = f"""WITH {BLOBS} SELECT root AS stream_id, min(seq) FILTER (seq % 211 = 7 OR seq % 97 = 5) AS first_bad,
coalesce(arg_min(CASE WHEN seq % 211 = 7 THEN 'missing' ELSE 'different' END, seq) FILTER (seq % 211 = 7 OR seq % 97 = 5), 'complete') AS status FROM bl GROUP BY root"""


def promote(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", F.expr("t div 4 + event_id % 2").cast("string").alias("digest"), (F.lit(9) + 9 * (F.col("stream_id") % 5)).alias("bytes"))
    return store.promoted(rows).groupBy("stream_id").agg(F.count("*").alias("runs"), F.sum("saved").cast("long").alias("saved"))


PROMOTE = f"""WITH {LOG}, r AS (SELECT stream_id, t, t // 4 + event_id % 2 AS d, 9 + 9 * (stream_id % 5) AS bytes FROM ev),
n AS (SELECT r.*, CASE WHEN p.d IS DISTINCT FROM r.d THEN 1 ELSE 0 END AS fresh FROM r LEFT JOIN r p ON p.stream_id = r.stream_id AND p.t = r.t - 1),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY t) AS isl FROM n),
g AS (SELECT stream_id, isl, count(*) AS n, any_value(bytes) AS bytes FROM i GROUP BY ALL HAVING count(*) >= 2)
SELECT stream_id, count(*) AS runs, CAST(sum((n - 1) * (5 + bytes)) AS BIGINT) AS saved FROM g GROUP BY stream_id"""


def gaps(spark, sf_dir):
    return transport.gaps(packets(spark, sf_dir))


GAPS = f"""WITH {PACKETS}, m AS (SELECT stream_id, count(*) AS received, max(seq) AS last FROM pk GROUP BY stream_id),
h AS (SELECT m.stream_id, min(s) AS gap FROM m, LATERAL (SELECT unnest(range(0, m.last + 1)) AS s) WHERE (stream_id, s) NOT IN (SELECT (stream_id, seq) FROM pk) GROUP BY m.stream_id)
SELECT stream_id, coalesce(gap, received) AS applied, received, gap AS gap_at FROM m LEFT JOIN h USING (stream_id)"""


def prefix(spark, sf_dir):
    return transport.playable(packets(spark, sf_dir)).filter("applied").groupBy("stream_id").agg(F.sum(F.col("size") + transport.OVERHEAD).cast("long").alias("bytes"), F.count("*").alias("frames"))


PREFIX = f"""WITH {PACKETS}, g AS (SELECT a.*, (SELECT count(*) FROM pk b WHERE b.stream_id = a.stream_id AND b.seq < a.seq) AS before FROM pk a)
SELECT stream_id, CAST(sum(size + 13) AS BIGINT) AS bytes, count(*) AS frames FROM g WHERE before = seq GROUP BY stream_id"""
TAG = {"click": 0x22, "purchase": 0x26, "view": 0x27, "signup": 0x2A, "error": 0x29}


def profile(spark, sf_dir):
    tag = F.create_map(*[F.lit(x) for kv in TAG.items() for x in kv])[F.col("op")]
    rows = log(spark, sf_dir).select("stream_id", F.expr("t div 5").alias("t"), transport.label(tag, transport.EVENTS).alias("label"), (F.col("k") % 20 + 5).cast("long").alias("bytes"))
    return transport.profile(rows)


PROFILE = f"""WITH {LOG} SELECT stream_id, t // 5 AS t, CAST(sum(k % 20 + 5) AS BIGINT) AS bytes, CAST(sum(k % 20 + 5) + 13 AS BIGINT) AS framed, count(*) AS events,
CAST(coalesce(sum(k % 20 + 5) FILTER (op = 'signup'), 0) AS BIGINT) AS residual FROM ev GROUP BY ALL"""


def framing(spark, sf_dir):
    """Frames of packets, parsed again; every 50th frame is cut short."""
    rows = packets(spark, sf_dir, lossy=False).select("stream_id", "ident", transport.frame(F.lit(4), F.col("seq"), F.col("ident").cast("string").cast("binary")).alias("frame"))
    rows = rows.withColumn("frame", F.when(F.col("ident") % 50 == 0, F.expr("substring(frame, 1, octet_length(frame) - 1)")).otherwise(F.col("frame")))
    return transport.parsed(rows).select("ident", "error", "kind", "seq", F.col("body").cast("string").alias("body"))


FRAMING = f"""WITH {ALL_PACKETS} SELECT ident, CASE WHEN ident % 50 = 0 THEN 'bad frame length' END AS error, CASE WHEN ident % 50 <> 0 THEN 4 END AS kind, CASE WHEN ident % 50 <> 0 THEN seq END AS seq,
CASE WHEN ident % 50 <> 0 THEN CAST(ident AS VARCHAR) END AS body FROM pk"""


def ordering(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "o_orderkey")
    kind = F.when(F.col("seq") == 0, "header").when(F.col("seq") <= 2, "object").when(F.col("seq") == 3, F.when(F.col("o_orderkey") % 5 == 0, "interval").otherwise("checkpoint")).when(F.col("o_orderkey") % 23 == 0, "checkpoint").when(F.col("o_orderkey") % 29 == 0, "object").otherwise("interval")
    return transport.order_errors(rows.withColumn("kind", kind))


ORDERING = """WITH o AS (SELECT o_custkey AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey AS k FROM orders),
p AS (SELECT stream_id, seq, CASE WHEN seq = 0 THEN 'header' WHEN seq <= 2 THEN 'object' WHEN seq = 3 THEN CASE WHEN k % 5 = 0 THEN 'interval' ELSE 'checkpoint' END WHEN k % 23 = 0 THEN 'checkpoint' WHEN k % 29 = 0 THEN 'object' ELSE 'interval' END AS kind FROM o),
c AS (SELECT stream_id, min(seq) AS cp FROM p WHERE kind = 'checkpoint' GROUP BY stream_id),
e AS (SELECT p.stream_id, seq, CASE kind WHEN 'object' THEN 'declaration after checkpoint' WHEN 'checkpoint' THEN 'second checkpoint' ELSE 'interval before checkpoint' END AS error FROM p LEFT JOIN c USING (stream_id)
 WHERE kind = 'object' AND cp < seq OR kind = 'checkpoint' AND cp < seq OR kind = 'interval' AND coalesce(cp > seq, true))
SELECT stream_id, min(seq) AS seq, arg_min(error, seq) AS error FROM e GROUP BY stream_id"""


def _spans(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("stream_id"), (k * 7 % 20).alias("y"), (k * 13 % 90).alias("x0"), (k * 13 % 90 + 1 + k % 9).alias("x1"))


SPANS = "sp AS (SELECT CAST(p_size AS INTEGER) AS stream_id, p_partkey * 7 % 20 AS y, p_partkey * 13 % 90 AS x0, p_partkey * 13 % 90 + 1 + p_partkey % 9 AS x1 FROM part)"


def span_merge(spark, sf_dir):
    return region.merged(_spans(spark, sf_dir), ["stream_id", "y"])


SPAN_MERGE = f"""WITH {SPANS}, c AS (SELECT DISTINCT stream_id, y, unnest(range(x0, x1)) AS x FROM sp), g AS (SELECT *, x - row_number() OVER (PARTITION BY stream_id, y ORDER BY x) AS grp FROM c)
SELECT stream_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY stream_id, y, grp"""


def span_cut(spark, sf_dir):
    """Cells inside and outside a rectangle."""
    rows = region.merged(_spans(spark, sf_dir), ["stream_id", "y"])
    size = F.sum(F.col("x1") - F.col("x0")).cast("long")
    a = region.intersected(rows, 20, 5, 60, 15).groupBy("stream_id").agg(size.alias("inside"))
    b = region.subtracted(rows, 20, 5, 60, 15).groupBy("stream_id").agg(size.alias("outside"))
    return a.join(b, "stream_id", "full_outer")


SPAN_CUT = f"""WITH {SPANS}, c AS (SELECT DISTINCT stream_id, y, unnest(range(x0, x1)) AS x FROM sp)
SELECT stream_id, nullif(count(*) FILTER (x >= 20 AND x < 60 AND y >= 5 AND y < 15), 0) AS inside, nullif(count(*) FILTER (NOT (x >= 20 AND x < 60 AND y >= 5 AND y < 15)), 0) AS outside FROM c GROUP BY stream_id"""


def demand(spark, sf_dir):
    """Samples that a view of the ninth frame reads of each frame before, through the copies of every stream's log."""
    k = F.col("k").cast("long")
    copies = log(spark, sf_dir).select("stream_id", "t", (F.col("event_id") % 16).alias("sx"), (k % 12).alias("sy"), F.when(F.col("op").isin("purchase", "click"), 8).otherwise(0).alias("w"), F.lit(6).alias("h"), F.expr("event_id div 16 % 16").alias("dx"), F.expr("k div 12 % 12").alias("dy"))
    spans = region.demands(copies, (4, 4, 20, 16), 9, 32, 24)
    return spans.groupBy("stream_id", "t").agg(F.sum(F.col("x1") - F.col("x0")).alias("cells"), F.count("*").alias("spans"))


DEMAND = f"""WITH RECURSIVE {LOG}, c AS (SELECT stream_id, t, event_id % 16 AS sx, k % 12 AS sy, event_id // 16 % 16 AS dx, k // 12 % 12 AS dy FROM ev WHERE op IN ('purchase', 'click') AND t <= 9),
n AS (SELECT s.stream_id, CAST(9 AS BIGINT) AS t, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT DISTINCT stream_id FROM ev) s, range(4, 20) a(x), range(4, 16) b(y)
UNION SELECT n.stream_id, n.t - 1, n.x + sx - dx, n.y + sy - dy FROM n JOIN c ON c.stream_id = n.stream_id AND c.t = n.t WHERE n.x >= dx AND n.x < dx + 8 AND n.y >= dy AND n.y < dy + 6)
SELECT stream_id, t, CAST(count(*) AS BIGINT) AS cells, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n m WHERE m.stream_id = n.stream_id AND m.t = n.t AND m.y = n.y AND m.x = n.x - 1)) AS spans FROM n GROUP BY stream_id, t"""


def quantized(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("k", (F.col("x") % 8).cast("int"))
    return rows.groupBy("stream_id", "k").agg(F.sum(scalar.quantize(F.col("v"), F.col("k"))).cast("long").alias("half_up"), F.sum(scalar.quantize(F.col("v"), F.col("k"), False)).cast("long").alias("dead_zone"))


QUANTIZED = f"""WITH {FRAMES} SELECT stream_id, CAST(x % 8 AS INTEGER) AS k, CAST(sum(CASE WHEN x % 8 = 0 THEN v ELSE least(255, (v + (1 << (x % 8 - 1))) // (1 << (x % 8)) * (1 << (x % 8))) END) AS BIGINT) AS half_up,
CAST(sum(v // (1 << (x % 8)) * (1 << (x % 8))) AS BIGINT) AS dead_zone FROM fr GROUP BY ALL"""


def boxed(spark, sf_dir):
    return lossy.box3(frames(spark, sf_dir)).groupBy("stream_id", "frame").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


BOXED = f"""WITH {FRAMES} SELECT a.stream_id, a.frame, CAST(sum((l.v + 2 * a.v + r.v + 2) // 4 * (a.y * 8 + a.x + 1)) AS BIGINT) AS weighted FROM fr a
JOIN fr l ON l.vec_id = a.vec_id AND l.y = a.y AND l.x = greatest(0, a.x - 1) JOIN fr r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = least(7, a.x + 1) GROUP BY ALL"""


def distortion(spark, sf_dir):
    return lossy.distortion(frames(spark, sf_dir).withColumn("q", scalar.quantize(F.col("v"), 3)), ["stream_id", "frame"])


DISTORTION = f"""WITH {FRAMES}, q AS (SELECT stream_id, frame, v - least(255, (v + 4) // 8 * 8) AS d FROM fr)
SELECT stream_id, frame, CAST(1000 * sum(abs(d)) // count(*) AS BIGINT) AS mae_x1000, CAST(sum(d * d) // count(*) AS BIGINT) AS mse, CAST(max(abs(d)) AS BIGINT) AS peak, count(*) AS n FROM q GROUP BY ALL"""


def rates(spark, sf_dir):
    return lossy.ladder(frames(spark, sf_dir), [0, 1, 2, 3, 4])


LADDER = f"""{FRAMES}, q AS (SELECT stream_id, frame, y, x, CAST(k AS INTEGER) AS shift, v, CASE WHEN k = 0 THEN v ELSE least(255, (v + (1 << (k - 1))) // (1 << k) * (1 << k)) END AS q FROM fr, range(0, 5) r(k)),
la AS (SELECT stream_id, shift, CAST(1000 * sum(abs(v - q)) // count(*) AS BIGINT) AS mae_x1000, CAST(sum((v - q) * (v - q)) // count(*) AS BIGINT) AS mse, CAST(max(abs(v - q)) AS BIGINT) AS peak, count(*) AS n FROM q GROUP BY ALL),
sz AS (SELECT a.stream_id, a.shift, 18 + 9 * count(*) FILTER (b.q IS DISTINCT FROM a.q) AS bytes FROM q a LEFT JOIN q b ON b.stream_id = a.stream_id AND b.frame = a.frame AND b.y = a.y AND b.x = a.x - 1 AND b.shift = a.shift GROUP BY ALL)"""
RATES = f"WITH {LADDER} SELECT * FROM la JOIN sz USING (stream_id, shift)"


def choose(spark, sf_dir):
    return lossy.chosen(rates(spark, sf_dir), F.col("stream_id") * 3000)


CHOOSE = f"""WITH {LADDER}, r AS (SELECT *, bytes <= stream_id * 3000 AS fits FROM la JOIN sz USING (stream_id, shift)), m AS (SELECT stream_id, bool_or(fits) AS met FROM r GROUP BY stream_id)
SELECT stream_id, shift, bytes, met FROM r JOIN m USING (stream_id) WHERE fits OR NOT met QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN met THEN mse ELSE shift END, mae_x1000, peak, bytes, shift) = 1"""


def choose_smallest(spark, sf_dir):
    return lossy.chosen(rates(spark, sf_dir), None)


CHOOSE_SMALLEST = f"WITH {LADDER} SELECT stream_id, shift, bytes, true AS met FROM la JOIN sz USING (stream_id, shift) QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY bytes, mse, mae_x1000, peak, shift) = 1"


def byte_model(spark, sf_dir):
    return codec.byte_model(codec.byte_counts(read(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id")


BYTE_MODEL = """WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), b AS (SELECT item_id, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS sym FROM h, LATERAL (SELECT unnest(range(0, len(h.h) // 2)) AS i)),
c AS (SELECT item_id, sym, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT item_id, sum(n) AS tot, 16384 - count(*) AS ex FROM c GROUP BY item_id),
s AS (SELECT c.*, 1 + n * ex // tot AS f, n * ex % tot AS r FROM c JOIN t USING (item_id)), l AS (SELECT item_id, 16384 - sum(f) AS left FROM s GROUP BY item_id)
SELECT item_id, sym, n, CAST(f + CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY r DESC, sym) <= l.left THEN 1 ELSE 0 END AS BIGINT) AS freq FROM s JOIN l USING (item_id)"""


def _sum16():
    return sum(((k + 1) * F.col(f"s{k}") for k in range(1, 16)), F.col("s0"))


def dct(spark, sf_dir):
    out = codec.transform(codec.blocks4(frames(spark, sf_dir)))
    return out.select("stream_id", "frame", F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx"), F.col("s0").alias("dc"), _sum16().alias("weighted"))


def _dct_sql() -> str:
    """The transform one line at a time, each of its steps a nested query over one line of four."""

    def line(src: str, key: str, at: str, other: str) -> str:
        even = f"SELECT *, v0 + v3 AS p, v1 + v2 AS q, v0 - v3 AS r, v1 - v2 AS t FROM (SELECT {key}, {other}, max(v) FILTER ({at} = 0) AS v0, max(v) FILTER ({at} = 1) AS v1, max(v) FILTER ({at} = 2) AS v2, max(v) FILTER ({at} = 3) AS v3 FROM {src} GROUP BY {key}, {other})"
        one = f"SELECT *, p + CAST(floor(106 * q / 256) AS BIGINT) AS u, r + CAST(floor(51 * t / 256) AS BIGINT) AS z FROM ({even})"
        two = f"SELECT *, q + CAST(floor(-181 * u / 256) AS BIGINT) AS o2, t + CAST(floor(-98 * z / 256) AS BIGINT) AS o3 FROM ({one})"
        return f"SELECT {key}, {other}, unnest([0, 1, 2, 3]) AS {at}, unnest([u + CAST(floor(106 * o2 / 256) AS BIGINT), z + CAST(floor(51 * o3 / 256) AS BIGINT), o2, o3]) AS v FROM ({two})"

    key = "stream_id, frame, qy, qx"
    return f"""WITH {FRAMES}, b AS (SELECT stream_id, frame, y // 4 AS qy, x // 4 AS qx, y % 4 AS i, x % 4 AS j, v FROM fr), r AS ({line("b", key, "j", "i")}), c AS ({line("r", key, "i", "j")})
SELECT stream_id, frame, qy AS by, qx AS bx, CAST(max(v) FILTER (i = 0 AND j = 0) AS BIGINT) AS dc, CAST(sum(v * (4 * i + j + 1)) AS BIGINT) AS weighted FROM c GROUP BY ALL"""


DCT = _dct_sql()


def undct(spark, sf_dir):
    """The transform and back: the blocks as they were."""
    out = codec.untransform(codec.transform(codec.blocks4(frames(spark, sf_dir))))
    return out.select("stream_id", "frame", F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx"), _sum16().alias("weighted"))


UNDCT = f"WITH {FRAMES} SELECT stream_id, frame, y // 4 AS by, x // 4 AS bx, CAST(sum(v * (y % 4 * 4 + x % 4 + 1)) AS BIGINT) AS weighted FROM fr GROUP BY ALL"


def zigzag(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 2001 - 1000).alias("v"))
    return rows.select("p_partkey", "v", scalar.zigzag(F.col("v")).alias("z"), scalar.unzigzag(scalar.zigzag(F.col("v"))).alias("back"))


ZIGZAG = "SELECT p_partkey, v, xor(v << 1, v >> 63) AS z, v AS back FROM (SELECT p_partkey, p_partkey * 7919 % 2001 - 1000 AS v FROM part) WHERE v >= 0 UNION ALL SELECT p_partkey, v, -2 * v - 1, v FROM (SELECT p_partkey, p_partkey * 7919 % 2001 - 1000 AS v FROM part) WHERE v < 0"


def rans(spark, sf_dir):
    return codec.blocks_of(read(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "n", "exact")


RANS = "SELECT item_id, CAST(strlen(text) AS BIGINT) AS n, true AS exact FROM benchmark"


def _pictures(spark, sf_dir):
    names = F.array(*map(F.lit, media.LAYOUTS))
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (k % 16 + 1).cast("int")).alias("layout"), (1 + k * 7 % 1921).alias("width"), (1 + k * 5 % 1081).alias("height"), F.when(k % 3 == 0, 10).otherwise(8).alias("depth"))


def geometry(spark, sf_dir):
    out = media.planes(_pictures(spark, sf_dir), media.layouts(spark))
    return out.groupBy("layout").agg(F.count("*").alias("planes"), F.sum("w").cast("long").alias("w"), F.sum("h").cast("long").alias("h"), F.sum("bytes").cast("long").alias("bytes"))


_VALUES = ", ".join(f"({i}, '{n}', {p}, {a}, {b})" for i, (n, (p, a, b)) in enumerate(media.LAYOUTS.items()))
GEOMETRY = f"""WITH l(i, layout, n, a, b) AS (VALUES {_VALUES}), p AS (SELECT layout, 1 + p_partkey * 7 % 1921 AS w, 1 + p_partkey * 5 % 1081 AS h, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS d,
 unnest(range(0, n)) AS q, n, a, b FROM part JOIN l ON l.i = p_partkey % 16), s AS (SELECT layout, d, CASE WHEN n >= 3 AND q IN (1, 2) THEN CAST(ceil(w / (1 << a)) AS BIGINT) ELSE w END AS w,
 CASE WHEN n >= 3 AND q IN (1, 2) THEN CAST(ceil(h / (1 << b)) AS BIGINT) ELSE h END AS h FROM p)
SELECT layout, count(*) AS planes, CAST(sum(w) AS BIGINT) AS w, CAST(sum(h) AS BIGINT) AS h, CAST(sum(w * h * d) AS BIGINT) AS bytes FROM s GROUP BY layout"""


def times(spark, sf_dir):
    """Order times against 1001/24000 ticks, and in that base where they are whole."""
    k = F.col("o_orderkey").cast("long")
    c = lambda x: F.lit(x).cast("long")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (k * 1001).alias("a"), (k * 24 + F.when(k % 3 == 0, 0).otherwise(k % 3 - 2)).alias("b"))
    return rows.select("o_orderkey", scalar.compare_times(F.col("a"), c(1), c(24000), F.col("b") * 1001, c(1), c(576000)).cast("int").alias("cmp"), scalar.rescale(F.col("b") * 7, c(1), c(48), c(1001), c(24000)).alias("ticks"))


TIMES = """WITH r AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) AS k, o_orderkey * 24 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 3 - 2 END AS b FROM orders)
SELECT o_orderkey, CAST(sign(k * 1001 * 576000 - b::HUGEINT * 1001 * 24000) AS INTEGER) AS cmp, CASE WHEN b::HUGEINT * 7 * 24000 % (48 * 1001) = 0 THEN CAST(b::HUGEINT * 7 * 24000 // (48 * 1001) AS BIGINT) END AS ticks FROM r"""


def _observations(spark, sf_dir):
    rows = log(spark, sf_dir)
    return rows.select("stream_id", F.col("t").alias("obs"), (F.col("t") * 40 + F.when(F.col("event_id") % 50 == 0, -90).otherwise(F.col("k") % 7)).cast("long").alias("pts"))


OBSERVATIONS = f"{LOG}, ob AS (SELECT stream_id, t AS obs, t * 40 + CASE WHEN event_id % 50 = 0 THEN -90 ELSE k % 7 END AS pts FROM ev)"


def vfr(spark, sf_dir):
    return media.durations(_observations(spark, sf_dir))


VFR = f"WITH {OBSERVATIONS} SELECT a.stream_id, a.obs, a.pts, b.pts - a.pts AS duration, coalesce(b.pts <= a.pts, false) AS error FROM ob a LEFT JOIN ob b ON b.stream_id = a.stream_id AND b.obs = a.obs + 1"


def epochs(spark, sf_dir):
    obs = _observations(spark, sf_dir)
    marks = obs.filter("obs % 10 = 1").select("stream_id", F.expr("obs div 10").alias("epoch_id"), F.col("obs").alias("o")).select("stream_id", "epoch_id", (F.col("o") * 40 - 100).alias("begin"))
    return media.epoch_of(obs, marks).groupBy("stream_id", "epoch_id").agg(F.count("*").alias("n"), F.sum("pts").alias("total"))


EPOCHS = f"""WITH {OBSERVATIONS}, e AS (SELECT stream_id, obs // 10 AS epoch_id, obs * 40 - 100 AS b FROM ob WHERE obs % 10 = 1)
SELECT ob.stream_id, e.epoch_id, count(*) AS n, CAST(sum(pts) AS BIGINT) AS total FROM ob ASOF LEFT JOIN e ON ob.stream_id = e.stream_id AND ob.pts >= e.b GROUP BY ALL"""


def aspect(spark, sf_dir):
    rows = _pictures(spark, sf_dir)
    w, h = media.display_aspect(F.col("width"), F.col("height"), 1 + F.col("p_partkey") % 40, 1 + F.col("p_partkey") % 33)
    return rows.select("p_partkey", w.alias("w"), h.alias("h"))


ASPECT = """WITH r AS (SELECT p_partkey, (1 + p_partkey * 7 % 1921) * (1 + p_partkey % 40) AS a, (1 + p_partkey * 5 % 1081) * (1 + p_partkey % 33) AS b FROM part)
SELECT p_partkey, a // gcd(a, b) AS w, b // gcd(a, b) AS h FROM r"""


def _pairs(spark, sf_dir):
    """Rows of eight samples as four pairs."""
    return frames(spark, sf_dir).groupBy(F.col("vec_id").alias("id"), "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s")).select("id", "y", F.transform("s", lambda s: s["v"]).alias("data"))


def unpack(spark, sf_dir):
    return media.unpacked_pairs(_pairs(spark, sf_dir)).groupBy("id", "plane").agg(F.sum(F.col("v") * (F.col("y") * 4 + F.col("x") + 1)).cast("long").alias("weighted"))


UNPACK = f"WITH {FRAMES} SELECT vec_id AS id, CAST(x % 2 + 1 AS INTEGER) AS plane, CAST(sum(v * (y * 4 + x // 2 + 1)) AS BIGINT) AS weighted FROM fr GROUP BY ALL"


def repack(spark, sf_dir):
    out = media.packed_pairs(media.unpacked_pairs(_pairs(spark, sf_dir)))
    return out.select("id", "y", F.array_join(F.transform("data", lambda v: v.cast("string")), " ").alias("row"))


REPACK = f"WITH {FRAMES} SELECT vec_id AS id, y, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY x) AS row FROM fr GROUP BY ALL"


def unpack_422(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    a = media.unpacked_422(rows).withColumn("order", F.lit("yuyv"))
    b = media.unpacked_422(rows, False).withColumn("order", F.lit("uyvy"))
    return a.unionByName(b).groupBy("id", "order", "plane").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


UNPACK_422 = f"""WITH {FRAMES}, p AS (SELECT vec_id AS id, 'yuyv' AS "order", CASE x % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS plane, y, x, v FROM fr
UNION ALL SELECT vec_id, 'uyvy', CASE x % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END, y, x, v FROM fr)
SELECT id, "order", CAST(plane AS INTEGER) AS plane, CAST(sum(v * (y * 8 + (CASE WHEN plane = 0 THEN x // 2 ELSE x // 4 END) + 1)) AS BIGINT) AS weighted FROM p GROUP BY ALL"""


def plane_checks(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", (k % 18).cast("int").alias("depth"), (k % 9).alias("w"), (k % 5 + 1).alias("h"), F.when(k % 7 == 0, 3).otherwise((k % 9) * (k % 5 + 1)).alias("n_samples"), (k % 700).alias("top"))
    return media.plane_errors(rows).groupBy("error").agg(F.count("*").alias("n"))


PLANE_CHECKS = """WITH r AS (SELECT p_partkey % 18 AS d, p_partkey % 9 AS w, p_partkey % 5 + 1 AS h, CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE (p_partkey % 9) * (p_partkey % 5 + 1) END AS n, p_partkey % 700 AS t FROM part)
SELECT CASE WHEN d < 1 OR d > 16 THEN 'depth' WHEN w < 1 THEN 'empty' WHEN n <> w * h THEN 'length' WHEN t >= 2 ** d THEN 'sample out of range' END AS error, count(*) AS n FROM r GROUP BY ALL"""


def features(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", (F.col("event_id") % 113 == 0).alias("external"), (F.col("k") % 61 == 0).alias("quantized"), (F.col("op") == "purchase").alias("moving"), (F.col("event_id") % 89 == 0).alias("warped"))
    return media.feature_bits(rows)


FEATURES = f"""WITH {LOG} SELECT stream_id, CAST(max(CASE WHEN event_id % 113 = 0 THEN 1 ELSE 0 END) | max(CASE WHEN k % 61 = 0 THEN 2 ELSE 0 END) | max(CASE WHEN op = 'purchase' THEN 4 ELSE 0 END)
 | max(CASE WHEN event_id % 89 = 0 THEN 8 ELSE 0 END) AS INTEGER) AS bits FROM ev GROUP BY stream_id"""


def programs(spark, sf_dir):
    k = F.col("p_partkey")
    seg = lambda a, b, c: F.struct((a % 3).alias("vx"), (a % 2).alias("vy"), b.alias("ax"), F.lit(0).cast("long").alias("ay"), c.alias("steps"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array(seg(k, k % 2, k % 11), seg(k + k % 4 * 3, k % 3 % 2, k % 13), seg(k * 2, F.lit(0).cast("long"), k % 5 + 1)).alias("segments"))
    return media.program_errors(rows).select("p_partkey", "error")


PROGRAMS = """WITH s AS (SELECT p_partkey AS k, unnest([1, 2, 3]) AS i, unnest([p_partkey, p_partkey + p_partkey % 4 * 3, p_partkey * 2]) AS a, unnest([p_partkey % 2, p_partkey % 3 % 2, 0]) AS ax, unnest([p_partkey % 11, p_partkey % 13, p_partkey % 5 + 1]) AS st FROM part),
e AS (SELECT a.k, max(CASE WHEN a.st < 1 THEN 1 ELSE 0 END) AS short, max(CASE WHEN a.ax = 0 AND b.ax = 0 AND a.a % 3 = b.a % 3 AND a.a % 2 = b.a % 2 THEN 1 ELSE 0 END) AS same FROM s a LEFT JOIN s b ON a.k = b.k AND b.i = a.i + 1 GROUP BY a.k)
SELECT k AS p_partkey, CASE WHEN short = 1 THEN 'steps' WHEN same = 1 THEN 'unmerged' END AS error FROM e"""

_ALL = {
    "o1_16_unpack_semi_planar": (unpack, UNPACK),
    "o1_16_unpack_packed_422": (unpack_422, UNPACK_422),
    "o1_17_repack_roundtrip": (repack, REPACK),
    "o1_2_missing_references": (missing, MISSING),
    "o4_10_zigzag": (zigzag, ZIGZAG),
    "o4_12_plane_geometry": (geometry, GEOMETRY),
    "o4_14_pts_compare_rescale": (times, TIMES),
    "o4_27_display_aspect": (aspect, ASPECT),
    "o6_1_byte_model": (byte_model, BYTE_MODEL),
    "o6_2_rans_roundtrip": (rans, RANS),
    "o6_4_dct_forward": (dct, DCT),
    "o6_4_dct_roundtrip": (undct, UNDCT),
    "o10_4_residual_promotion": (promote, PROMOTE),
    "o10_6_duplicate_merge": (merge, MERGE),
    "o11_2_content_dedup": (dedup, DEDUP),
    "o11_3_publish_new_reused": (publish, PUBLISH),
    "o11_4_archive_accounting": (accounting, ACCOUNTING),
    "o11_6_gc_live_dead": (collect, COLLECT),
    "o11_8_record_offsets": (offsets, OFFSETS),
    "o11_11_verify_first_bad": (verify, VERIFY),
    "o12_2_frame_parse": (framing, FRAMING),
    "o12_3_packet_gaps": (gaps, GAPS),
    "o12_4_order_rules": (ordering, ORDERING),
    "o12_5_playable_prefix": (prefix, PREFIX),
    "o12_8_interval_profile": (profile, PROFILE),
    "o13_2_span_merge": (span_merge, SPAN_MERGE),
    "o13_2_span_intersect_subtract": (span_cut, SPAN_CUT),
    "o13_3_plan_demands": (demand, DEMAND),
    "o14_1_quantize": (quantized, QUANTIZED),
    "o14_1_box3": (boxed, BOXED),
    "o14_2_distortion": (distortion, DISTORTION),
    "o14_4_rate_ladder": (rates, RATES),
    "o14_5_choose_rd": (choose, CHOOSE),
    "o14_5_choose_smallest": (choose_smallest, CHOOSE_SMALLEST),
    "o15_3_plane_checks": (plane_checks, PLANE_CHECKS),
    "o15_4_epoch_asof": (epochs, EPOCHS),
    "o15_5_vfr_durations": (vfr, VFR),
    "o15_7_program_checks": (programs, PROGRAMS),
    "o15_8_feature_bits": (features, FEATURES),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
