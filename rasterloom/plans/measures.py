"""Queries of scalar functions by themselves, of motion programs and of search plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import govern, trajectory
from .adapters import FRAMES, LOG, frames, log, read


def translations(spark, sf_dir):
    """Maps at 8 bits, of which some are pure translations."""
    k = F.col("p_partkey")
    lit = lambda n: F.lit(n).cast("long")
    found = scalar.translation_of(F.when(k % 3 == 0, 255).otherwise(256), F.when(k % 5 == 0, 1).otherwise(0), (k * 128 % 4096 - 2048), lit(0), lit(256), -256 * (k % 9), 8)
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("o")).select("p_partkey", "o.x", "o.y")


TRANSLATIONS = """SELECT p_partkey, CASE WHEN ok THEN CAST((p_partkey * 128 % 4096 - 2048) // 256 AS BIGINT) END AS x, CASE WHEN ok THEN -(p_partkey % 9) END AS y
FROM (SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AS ok FROM part)"""


def coefficients(spark, sf_dir):
    """Prices as coefficients of maps at 8, 12 and 16 bits; large ones saturate."""
    v = F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) / 64
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[scalar.map_coefficient(v, s).alias(f"q{s}") for s in (8, 12, 16)])


COEFFICIENTS = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(CASE WHEN abs(v) * {1 << s} >= 16777216 THEN sign(v) * 16777216 ELSE sign(v) * floor(abs(v) * {1 << s} + 0.5) END AS BIGINT) AS q{s}" for s in (8, 12, 16)) + " FROM (SELECT *, l_extendedprice * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) / 64 AS v FROM lineitem)"


def times(spark, sf_dir):
    """Sums, spans, frame lengths and tick rates on time bases, where they are whole."""
    k = F.col("o_orderkey")
    lit = lambda n: F.lit(n).cast("long")
    num, den = 1 + k % 4, F.when(k % 3 == 0, lit(24000)).when(k % 3 == 1, lit(90000)).otherwise(lit(1000))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", scalar.ticks_per_second(num, den).alias("per_second"), scalar.later(k, num, den, F.lit(7), num, F.when(k % 5 == 0, lit(1)).otherwise(den)).alias("later"),
        scalar.span(k * 100, num, den, k % 50, lit(1), lit(1000)).alias("span"), scalar.frame_ticks(24 + k % 2 * 6, lit(1), num, den).alias("frame"),
    )


TIMES = """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) AS k, 1 + o_orderkey % 4 AS num, CASE o_orderkey % 3 WHEN 0 THEN 24000 WHEN 1 THEN 90000 ELSE 1000 END AS den FROM orders)
SELECT o_orderkey, CASE WHEN den % num = 0 THEN CAST(den // num AS BIGINT) END AS per_second, CASE WHEN k % 5 <> 0 THEN CAST(k + 7 AS BIGINT) END AS later,
CASE WHEN (k % 50) * den % (num * 1000) = 0 AND k * 100 > (k % 50) * den // (num * 1000) THEN CAST(k * 100 - (k % 50) * den // (num * 1000) AS BIGINT) END AS span,
CASE WHEN den % (num * (24 + k % 2 * 6)) = 0 THEN CAST(den // (num * (24 + k % 2 * 6)) AS BIGINT) END AS frame FROM o"""


def wire_lengths(spark, sf_dir):
    """Bytes of the log's transitions, by tag: placements, velocities, patches, programs, palettes."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select((k % 18 + 0x20).alias("tag"), (k % 6).alias("parts"), F.when(k % 18 == 11, k % 6 % 3).otherwise(0).alias("accelerated"))
    rows = rows.withColumn("bytes", scalar.wire_length(F.col("tag"), F.col("parts"), F.col("accelerated")))
    return rows.groupBy("tag").agg(F.count("bytes").alias("known"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


WIRE_LENGTHS = """WITH r AS (SELECT p_partkey % 18 + 32 AS tag, p_partkey % 6 AS n FROM part), b AS (SELECT tag, CASE tag
 WHEN 33 THEN 1 + 4 + 4 + 4 + 4 WHEN 34 THEN 1 + 4 + 4 + 4 WHEN 35 THEN 1 + 4 + n * (4 + 4 + 1) WHEN 36 THEN 1 + 6 * 4 WHEN 37 THEN 1 + 6 * 4 WHEN 38 THEN 1 + 3 * 4 WHEN 39 THEN 1 WHEN 40 THEN 1 WHEN 41 THEN 1
 WHEN 42 THEN 1 + 4 + n WHEN 43 THEN 1 + 4 + 4 + (n - n % 3) * (1 + 2 * 4 + 8) + (n % 3) * (1 + 4 * 4 + 8) WHEN 44 THEN 1 WHEN 45 THEN 1 + 4 + 4 + n WHEN 46 THEN 1 + 4 + 4 + 2 * n WHEN 47 THEN 1 + 4 + 4 WHEN 48 THEN 1 + 4 + 6 * 4 END AS bytes FROM r)
SELECT tag, count(bytes) AS known, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM b GROUP BY tag"""


def fractions(spark, sf_dir):
    """Procedural share of orders as if they were streams: prices of some lines are residuals, of others rasters."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", cents).otherwise(0)).alias("r"), F.sum(F.when(F.col("l_returnflag") == "A", cents).otherwise(0)).alias("a"), F.sum(F.when(F.col("l_linestatus") == "F", cents).otherwise(0)).alias("t"))
    return sums.select("l_orderkey", F.round(scalar.procedural_fraction(F.col("r"), F.col("a"), F.col("t")), 9).alias("share"))


FRACTIONS = """WITH s AS (SELECT l_orderkey, sum(c) FILTER (l_returnflag IN ('R', 'A')) AS g, sum(c) FILTER (l_linestatus = 'F') AS t FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN coalesce(t, 0) = 0 THEN 0.0 ELSE round(1 - coalesce(g, 0) / t, 9) END AS share FROM s"""


def names(spark, sf_dir):
    """Names of lossy profiles and classes of side data."""
    k = F.col("p_partkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("mastering_display", "content_light_level", "timecode", "captions", "unknown")]), (k % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(scalar.profile_label(k % 8, k % 2 == 0, k % 3 == 0).alias("profile"), scalar.side_data_class(kinds).alias("side"))
    return rows.groupBy("profile", "side").agg(F.count("*").alias("n"))


NAMES = """SELECT format('q{}:{}{}', p_partkey % 8, ['halfup', 'deadzone'][p_partkey % 2 + 1], [':box3', '', ''][p_partkey % 3 + 1]) AS profile,
['typed', 'typed', 'typed', 'unsupported', 'unsupported'][p_partkey % 5 + 1] AS side, count(*) AS n FROM part GROUP BY ALL"""


def row_hashes(spark, sf_dir):
    """FNV-1a of each row of each frame, and how many rows of the frame before have the same."""
    rows = frames(spark, sf_dir).withColumn("v", F.shiftright("v", 6)).groupBy("stream_id", "frame", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s"))
    hashed = rows.select("stream_id", "frame", "y", scalar.fnv1a(F.unhex(F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), ""))).alias("h"))
    return hashed.groupBy("stream_id", "h").agg(F.count("*").alias("n"))


ROW_HASHES = f"""WITH {FRAMES}, l AS (SELECT stream_id, frame, y, list(CAST(v // 64 AS UHUGEINT) ORDER BY x) AS s FROM fr GROUP BY ALL),
h AS (SELECT stream_id, list_reduce(list_prepend(CAST('14695981039346656037' AS UHUGEINT), s), lambda a, b: xor(a, b) * CAST(1099511628211 AS UHUGEINT) % CAST('18446744073709551616' AS UHUGEINT)) AS h FROM l)
SELECT stream_id, lpad(lower(to_hex(CAST(h AS UBIGINT))), 16, '0') AS h, count(*) AS n FROM h GROUP BY ALL"""


def _programs(spark, sf_dir):
    """The log as motion: clicks place, purchases attach a program of two segments, views advance."""
    k = F.col("k").cast("long")
    seg = lambda vx, vy, ax, ay, n: F.struct(*[F.coalesce(c.cast("long"), F.lit(0)).alias(a) for c, a in zip((vx, vy, ax, ay, n), ("vx", "vy", "ax", "ay", "steps"))])
    zero = F.lit(0)
    program = F.array(seg(k % 5 - 2, k % 3 - 1, zero, zero, 1 + k % 3), seg(k % 7 - 3, zero, k % 2, F.lit(1), 1 + k % 4))
    kind = F.when(F.col("op") == "click", "place").when(F.col("op") == "purchase", "attach").when(F.col("op") == "view", "advance").otherwise("none")
    rows = log(spark, sf_dir).withColumns({"kind": kind, "px": F.col("event_id") % 64, "py": k % 48})
    return rows.withColumn("segments", F.when(F.col("op") == "purchase", F.when(k % 10 == 9, F.slice(program, 1, 0)).otherwise(program)))


def program_positions(spark, sf_dir):
    return trajectory.positions(_programs(spark, sf_dir)).select("stream_id", "t", "x", "y")


PROGRAM_POSITIONS = f"""WITH RECURSIVE {LOG}, r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(NULL AS INTEGER) AS p, 0 AS n FROM ev
UNION ALL SELECT e.stream_id, e.t,
 CAST(CASE WHEN op = 'click' THEN event_id % 64 WHEN op <> 'view' OR p IS NULL THEN x WHEN n < 1 + p % 3 THEN x + p % 5 - 2 WHEN n < 2 + p % 3 + p % 4 THEN x + p % 7 - 3 + p % 2 * (n - 1 - p % 3) ELSE x END AS BIGINT),
 CAST(CASE WHEN op = 'click' THEN k % 48 WHEN op <> 'view' OR p IS NULL THEN y WHEN n < 1 + p % 3 THEN y + p % 3 - 1 WHEN n < 2 + p % 3 + p % 4 THEN y + (n - 1 - p % 3) ELSE y END AS BIGINT),
 CASE WHEN op <> 'purchase' THEN p WHEN k % 10 = 9 THEN NULL ELSE k END, CASE WHEN op = 'purchase' THEN 0 WHEN op = 'view' THEN n + 1 ELSE n END
 FROM r JOIN ev e ON e.stream_id = r.stream_id AND e.t = r.t + 1)
SELECT stream_id, t, x, y FROM r WHERE t > 0"""


def program_fits(spark, sf_dir):
    """Runs of placements that follow a line, a curve, two lines or nothing: the cheapest program of each."""
    p, k = F.col("p_partkey"), F.col("k")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), 2 + p % 9)).alias("k"))
    x = F.when(p % 4 == 0, 5 + (p % 7 - 3) * k).when(p % 4 == 1, p % 5 * k + (1 + p % 3) * F.expr("k * (k - 1) div 2")).when(p % 4 == 2, F.when(k <= 3, 2 * k).otherwise(9 - k)).otherwise(k * k * k % 17)
    rows = rows.select("p_partkey", "k", x.alias("x"), F.when(p % 4 == 2, 0).otherwise(p % 3 * k).cast("long").alias("y"))
    return trajectory.fitted(rows).select("p_partkey", "n", "segments", "program", "bytes", "worth")


PROGRAM_FITS = """WITH r AS (SELECT p_partkey AS p, unnest(range(0, 3 + p_partkey % 9)) AS k FROM part),
q AS (SELECT p, k, CASE p % 4 WHEN 0 THEN 5 + (p % 7 - 3) * k WHEN 1 THEN p % 5 * k + (1 + p % 3) * (k * (k - 1) // 2) WHEN 2 THEN least(2 * k, 9 - k) ELSE k * k * k % 17 END AS x, CASE WHEN p % 4 = 2 THEN 0 ELSE p % 3 * k END AS y FROM r),
d AS (SELECT a.p, list({'x': b.x - a.x, 'y': b.y - a.y} ORDER BY a.k) AS d FROM q a JOIN q b ON a.p = b.p AND b.k = a.k + 1 GROUP BY a.p),
e AS (SELECT p, d, [{'x': d[i + 1].x - d[i].x, 'y': d[i + 1].y - d[i].y} FOR i IN range(1, len(d))] AS a FROM d),
f AS (SELECT p, len(d) AS n, 1 + len(list_filter(a, lambda v: v.x <> 0 OR v.y <> 0)) AS segments, len(a) >= 1 AND len(list_distinct(a)) = 1 AND (a[1].x <> 0 OR a[1].y <> 0) AS curve FROM e),
g AS (SELECT p, n, segments, CASE WHEN segments = 1 THEN 'linear' WHEN curve AND 34 <= 9 + 17 * segments THEN 'accelerated' ELSE 'piecewise' END AS program FROM f)
SELECT p AS p_partkey, n, CAST(segments AS BIGINT) AS segments, program, CAST(b AS BIGINT) AS bytes, n >= 3 AND 14 * n + b + 1 < 26 * n AS worth
FROM (SELECT *, CASE program WHEN 'linear' THEN 26 WHEN 'accelerated' THEN 34 ELSE 9 + 17 * segments END AS b FROM g)"""


def family_plans(spark, sf_dir):
    """Winners that wander among families, and the plan that follows from each: off, probe or full for every family."""
    family = F.element_at(F.array(*[F.lit(x) for x in ("sparse", "translation", "copy_rect", "regions", "transform_residual", "generator")]), (F.col("k") % 40 / 8).cast("int") + 1)
    wins = log(spark, sf_dir).select("stream_id", F.col("t").alias("frame"), family.alias("family"), (F.col("cents") % 4000 + 10).alias("payload"))
    plans = govern.family_plans(wins)
    return plans.groupBy("plan", *govern.MODES).agg(F.count("*").alias("frames"))


def _modes() -> str:
    has = lambda *fs: "len(list_intersect(active, [" + ", ".join(f"'{f}'" for f in fs) + "])) > 0"
    sweep = {"translation": "full", "copies": "probe", "regions": "probe", "transform": "probe", "generators": "probe"}
    trust = {"translation": (("translation",), "full"), "copies": (("copy_rect", "copy_residual"), "probe"), "regions": (("regions",), "full"), "transform": (("transform_residual",), "full"), "generators": (("generator", "generator_residual"), "full")}
    out = ["CASE WHEN alpha THEN 'full' ELSE 'off' END AS clears"]
    out += [f"CASE WHEN alpha THEN 'full' WHEN {has(*fs)} THEN '{mode}' WHEN frame % 6 = 0 THEN '{sweep[m]}' ELSE 'off' END AS {m}" for m, (fs, mode) in trust.items()]
    return ", ".join(out)


FAMILY_PLANS = f"""WITH {LOG}, w AS (SELECT stream_id, t AS frame, ['sparse', 'translation', 'copy_rect', 'regions', 'transform_residual', 'generator'][CAST(floor(k % 40 / 8) AS INTEGER) + 1] AS family, cents % 4000 + 10 AS payload FROM ev),
h AS (SELECT *, list(family) OVER r AS active, list(family) OVER b AS before, list_sort(list(payload) OVER r) AS pays FROM w WINDOW r AS (PARTITION BY stream_id ORDER BY frame ROWS 11 PRECEDING), b AS (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, (coalesce(len(before), 0) > 0 AND NOT list_contains(before, family)) OR (len(pays) >= 5 AND pays[len(pays) // 2 + 1] > 0 AND payload > 3.0 * pays[len(pays) // 2 + 1]) AS alpha FROM h),
m AS (SELECT CASE WHEN alpha THEN 'broaden' WHEN frame % 6 = 0 THEN 'sweep' ELSE 'trusted' END AS plan, {_modes()} FROM a)
SELECT *, count(*) AS frames FROM m GROUP BY ALL"""

_ALL = {
    "o4_4_as_translation": (translations, TRANSLATIONS),
    "o4_5_quantize_map": (coefficients, COEFFICIENTS),
    "o4_15_time_arithmetic": (times, TIMES),
    "o4_19_wire_lengths": (wire_lengths, WIRE_LENGTHS),
    "o4_20_procedural_fraction": (fractions, FRACTIONS),
    "o4_21_profile_labels": (names, NAMES),
    "o4_24_fnv_row_hashes": (row_hashes, ROW_HASHES),
    "o2_6_program_positions": (program_positions, PROGRAM_POSITIONS),
    "o10_3_program_fits": (program_fits, PROGRAM_FITS),
    "o9_1_family_plans": (family_plans, FAMILY_PLANS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
