"""Queries of comparing, fitting, choosing and governing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, court, govern
from .adapters import FRAMES, LOG, frames, log, read

COARSE = "c8 AS (SELECT stream_id, vec_id, frame, y, x, v // 8 * 8 AS v FROM fr)"


def _coarse(spark, sf_dir):
    """Frames on a coarse lattice, so that samples repeat."""
    return frames(spark, sf_dir).withColumn("v", (F.shiftright("v", 3) * 8).cast("int"))


def diff(spark, sf_dir):
    return compare.diff_points(_coarse(spark, sf_dir)).select("stream_id", "frame", "ord", "x", "y", "v")


DIFF = f"""WITH {FRAMES}, {COARSE} SELECT a.stream_id, a.frame, row_number() OVER (PARTITION BY a.stream_id, a.frame ORDER BY a.x, a.y) - 1 AS ord, a.x, a.y, a.v
FROM c8 a LEFT JOIN c8 b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND a.x = b.x AND a.y = b.y WHERE a.v <> coalesce(b.v, 0)"""


def uniform(spark, sf_dir):
    """Rows of frames at 2 bits."""
    return compare.uniform(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 6)), ["stream_id", "frame", "y"])


UNIFORM = f"""WITH {FRAMES} SELECT stream_id, frame, y, count(DISTINCT v // 64) = 1 AS uniform, CASE WHEN count(DISTINCT v // 64) = 1 THEN any_value(v // 64) END AS value FROM fr GROUP BY ALL"""


def _fields(spark, sf_dir):
    z = F.col("p_partkey")
    grid = F.explode(F.sequence(F.lit(0), F.lit(63)))
    rows = read(spark, sf_dir, "part").select(z.alias("z"), grid.alias("p")).select("z", (F.col("p") % 8).alias("x"), F.shiftright("p", 3).alias("y"))
    z, x, y = F.col("z"), F.col("x").cast("long"), F.col("y").cast("long")
    noise = (z * 7 + x * x * 31 + y * y * y * 17) % 256
    v = F.when(z % 4 == 0, scalar.gradient(z % 256, z % 11, z % 7, x, y)).when(z % 4 == 1, scalar.checker(z % 200, z % 200 + 9, F.when(z % 8 == 1, 1).otherwise(2).cast("long"), x, y)).otherwise(noise)
    return rows.withColumn("v", v)


FIELDS = """g AS (SELECT p_partkey AS z, CAST(p % 8 AS BIGINT) AS x, CAST(p // 8 AS BIGINT) AS y FROM part, range(0, 64) r(p)),
fl AS (SELECT z, x, y, CASE z % 4 WHEN 0 THEN (z % 256 + z % 11 * x + z % 7 * y) % 256
  WHEN 1 THEN CASE WHEN (x // (CASE WHEN z % 8 = 1 THEN 1 ELSE 2 END) + y // (CASE WHEN z % 8 = 1 THEN 1 ELSE 2 END)) % 2 = 0 THEN z % 200 ELSE z % 200 + 9 END
  ELSE (z * 7 + x * x * 31 + y * y * y * 17) % 256 END AS v FROM g)"""


def gradients(spark, sf_dir):
    return compare.fit_gradient(_fields(spark, sf_dir), ["z"])


GRADIENTS = f"""WITH {FIELDS}, s AS (SELECT *, (v - lag(v) OVER (PARTITION BY z, y ORDER BY x) + 256) % 256 AS dx, (v - lag(v) OVER (PARTITION BY z, x ORDER BY y) + 256) % 256 AS dy FROM fl)
SELECT z, CAST(min(v) FILTER (x = 0 AND y = 0) AS BIGINT) AS base, CAST(min(dx) AS BIGINT) AS sx, CAST(min(dy) AS BIGINT) AS sy FROM s GROUP BY z HAVING min(dx) = max(dx) AND min(dy) = max(dy)"""


def checkers(spark, sf_dir):
    return compare.fit_checker(_fields(spark, sf_dir), ["z"])


CHECKERS = f"""WITH {FIELDS}, t AS (SELECT z, c, (x // c + y // c) % 2 AS odd, list(DISTINCT v) AS vs FROM fl, (VALUES (1), (2), (4)) k(c) GROUP BY ALL)
SELECT a.z, CAST(a.c AS INTEGER) AS cell, a.vs[1] AS a, b.vs[1] AS b FROM t a JOIN t b ON a.z = b.z AND a.c = b.c AND a.odd = 0 AND b.odd = 1
WHERE len(a.vs) = 1 AND len(b.vs) = 1 AND a.vs <> b.vs QUALIFY row_number() OVER (PARTITION BY a.z ORDER BY a.c) = 1"""


def _path(spark, sf_dir):
    """Points that go at one speed for some steps, then at another."""
    t = F.col("t")
    seg = F.expr("t div 6")
    return log(spark, sf_dir).select("stream_id", "t", (t * (1 + (F.col("stream_id") + seg) % 3) + F.when(t % 17 == 0, 5).otherwise(0)).alias("x"), (t * ((seg * 5) % 2)).alias("y"))


PATH = f"""{LOG}, pt AS (SELECT stream_id, t, t * (1 + (stream_id + t // 6) % 3) + CASE WHEN t % 17 = 0 THEN 5 ELSE 0 END AS x, t * ((t // 6 * 5) % 2) AS y FROM ev),
d AS (SELECT a.stream_id, a.t, a.x - b.x AS dx, a.y - b.y AS dy FROM pt a JOIN pt b ON a.stream_id = b.stream_id AND b.t = a.t - 1)"""


def runs(spark, sf_dir):
    return compare.linear_runs(_path(spark, sf_dir)).select("stream_id", "first", "last", "dx", "dy", "steps")


ISLANDS = f"""WITH {PATH}, n AS (SELECT a.*, CASE WHEN b.t IS NULL OR a.dx <> b.dx OR a.dy <> b.dy THEN 1 ELSE 0 END AS fresh FROM d a LEFT JOIN d b ON a.stream_id = b.stream_id AND b.t = a.t - 1),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY t) AS isl FROM n),
r AS (SELECT stream_id, isl, min(t) AS first, max(t) AS last, any_value(dx) AS dx, any_value(dy) AS dy, count(*) AS steps FROM i GROUP BY ALL HAVING count(*) >= 3)
"""
RUNS = ISLANDS + "SELECT stream_id, first, last, dx, dy, steps FROM r"


def collapse(spark, sf_dir):
    """Bytes that runs of placements save as one velocity and as one program; only gains count."""
    found = compare.linear_runs(_path(spark, sf_dir))
    n = F.col("steps")
    gain = found.withColumns({"velocity": F.greatest(F.lit(0), 13 * n - (13 + n)), "program": F.greatest(F.lit(0), 26 * n - (14 * n + 18))})
    return gain.groupBy("stream_id").agg(F.sum("velocity").alias("velocity"), F.sum("program").alias("program"), F.count(F.when(F.col("velocity") > 0, 1)).alias("runs"))


COLLAPSE = ISLANDS + """SELECT stream_id, CAST(sum(CASE WHEN 13 + steps < 13 * steps THEN 12 * steps - 13 ELSE 0 END) AS BIGINT) AS velocity,
 CAST(sum(CASE WHEN 14 * steps + 18 < 26 * steps THEN 12 * steps - 18 ELSE 0 END) AS BIGINT) AS program, count(*) FILTER (13 + steps < 13 * steps) AS runs FROM r GROUP BY stream_id"""


def accelerated(spark, sf_dir):
    t = F.col("t")
    pts = log(spark, sf_dir).select("stream_id", "t", F.when(t < 20, t * (t - 1)).otherwise(3 * t + 320).alias("x"), (t * (F.col("stream_id") % 3)).alias("y"))
    return compare.accelerations(pts).select("stream_id", "first", "ax", "ay", "steps")


ACCELERATED = f"""WITH {LOG}, pt AS (SELECT stream_id, t, CASE WHEN t < 20 THEN t * (t - 1) ELSE 3 * t + 320 END AS x, t * (stream_id % 3) AS y FROM ev),
s AS (SELECT a.stream_id, a.t, a.x - 2 * b.x + c.x AS ax, a.y - 2 * b.y + c.y AS ay FROM pt a JOIN pt b ON a.stream_id = b.stream_id AND b.t = a.t - 1 JOIN pt c ON a.stream_id = c.stream_id AND c.t = a.t - 2),
n AS (SELECT s.*, CASE WHEN p.t IS NULL OR p.ax <> s.ax OR p.ay <> s.ay THEN 1 ELSE 0 END AS fresh FROM s LEFT JOIN s p ON p.stream_id = s.stream_id AND p.t = s.t - 1),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY t) AS isl FROM n)
SELECT stream_id, min(t) AS first, any_value(ax) AS ax, any_value(ay) AS ay, count(*) AS steps FROM i GROUP BY stream_id, isl HAVING count(*) >= 3 AND (any_value(ax) <> 0 OR any_value(ay) <> 0)"""


def indexes(spark, sf_dir):
    mapped = compare.index_map(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 3)), 9)
    return mapped.groupBy("stream_id", "frame").agg(F.max(F.size("palette")).alias("size"), F.sum(F.col("idx") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


INDEXES = f"""WITH {FRAMES}, q AS (SELECT stream_id, frame, y, x, v // 8 AS v FROM fr), r AS (SELECT *, dense_rank() OVER (PARTITION BY stream_id, frame ORDER BY v) - 1 AS idx FROM q)
SELECT stream_id, frame, CAST(count(DISTINCT v) AS INTEGER) AS size, CAST(sum(idx * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM r GROUP BY ALL HAVING count(DISTINCT v) <= 9"""


def displacement(spark, sf_dir):
    return compare.best_displacement(frames(spark, sf_dir), 2)


DISPLACEMENT = f"""WITH {FRAMES}, m AS (SELECT a.stream_id, a.frame, CAST(j AS INTEGER) AS dy, CAST(i AS INTEGER) AS dx, sum(abs(a.v - b.v)) AS sad, count(*) AS n
 FROM fr a JOIN range(-2, 3) r(i) ON true JOIN range(-2, 3) s(j) ON true JOIN fr b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND b.x = a.x - i AND b.y = a.y - j GROUP BY ALL)
SELECT stream_id, frame, dy, dx, CAST(sad AS BIGINT) AS sad FROM m QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY sad * 1000000 // n, dy, dx) = 1"""


def matches(spark, sf_dir):
    """Moves of the frame before that match exactly, at 1 bit."""
    out = compare.displaced(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 7)), 1)
    return out.filter("n >= 49").groupBy("stream_id").agg(F.min("mismatches").alias("least"), F.count(F.when(F.col("mismatches") <= 20, 1)).alias("near"))


MATCHES = f"""WITH {FRAMES}, m AS (SELECT a.stream_id, a.frame, i, j, count(*) FILTER (a.v // 128 <> b.v // 128) AS bad FROM fr a JOIN range(-1, 2) r(i) ON true JOIN range(-1, 2) s(j) ON true
 JOIN fr b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND b.x = a.x - i AND b.y = a.y - j GROUP BY ALL)
SELECT stream_id, min(bad) AS least, count(*) FILTER (bad <= 20) AS near FROM m GROUP BY stream_id"""


def backgrounds(spark, sf_dir):
    return compare.backgrounds(_coarse(spark, sf_dir), 8, 8)


BACKGROUNDS = f"""WITH {FRAMES}, {COARSE} SELECT stream_id, v FROM c8 WHERE frame = 0 AND x IN (0, 7) AND y IN (0, 7)
UNION SELECT stream_id, v FROM (SELECT stream_id, v, count(*) AS n FROM c8 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, v DESC) = 1
UNION SELECT DISTINCT stream_id, unnest([0, 255]) FROM c8"""


def _sparse(spark, sf_dir):
    """Frames at 1 bit: changes form areas."""
    return frames(spark, sf_dir).withColumn("v", F.when(F.col("v") > 140, 1).otherwise(0))


def changed(spark, sf_dir):
    return compare.changed_boxes(_sparse(spark, sf_dir))


CHANGED = f"""WITH RECURSIVE {FRAMES}, b AS (SELECT stream_id, frame, y, x, v > 140 AS v FROM fr),
c AS (SELECT a.stream_id, a.frame, a.y, a.x, a.y * 8 + a.x AS id FROM b a JOIN b p ON p.stream_id = a.stream_id AND p.frame = a.frame - 1 AND p.x = a.x AND p.y = a.y WHERE p.v <> a.v),
r AS (SELECT stream_id, frame, id, id AS root FROM c UNION SELECT r.stream_id, r.frame, d.id, r.root FROM r JOIN c e ON e.stream_id = r.stream_id AND e.frame = r.frame AND e.id = r.id
  JOIN c d ON d.stream_id = r.stream_id AND d.frame = r.frame AND abs(d.x - e.x) + abs(d.y - e.y) = 1),
l AS (SELECT stream_id, frame, id, min(root) AS root FROM r GROUP BY ALL),
x AS (SELECT stream_id, frame, root, min(id % 8) AS x, min(id // 8) AS y, max(id % 8) - min(id % 8) + 1 AS w, max(id // 8) - min(id // 8) + 1 AS h FROM l GROUP BY ALL)
SELECT CAST(stream_id AS INTEGER) AS stream_id, frame, CAST(row_number() OVER (PARTITION BY stream_id, frame ORDER BY w * h DESC, root) - 1 AS INTEGER) AS nth, x, y, w, h FROM x
QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY w * h DESC, root) <= 4"""


def same_rows(spark, sf_dir):
    return compare.row_hash_matches(_sparse(spark, sf_dir))


SAME_ROWS = f"""WITH {FRAMES}, r AS (SELECT stream_id, frame, y, string_agg(CASE WHEN v > 140 THEN '1' ELSE '0' END, '' ORDER BY x) AS s FROM fr GROUP BY ALL)
SELECT a.stream_id, a.frame, a.y, b.y AS from_y FROM r a JOIN r b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND a.s = b.s"""


def _court(spark, sf_dir):
    return court.candidates(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 5)), 64)


COURT = f"""{FRAMES}, q AS (SELECT stream_id, frame, y, x, v // 32 AS v FROM fr), f AS (SELECT a.stream_id, a.frame, count(*) FILTER (a.v <> b.v) AS k, count(DISTINCT a.v) = 1 AS flat
  FROM q a JOIN q b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND b.x = a.x AND b.y = a.y GROUP BY ALL),
c AS (SELECT stream_id, frame, 'unchanged' AS family, 0 AS ord, 13 AS payload, k = 0 AS valid FROM f UNION ALL SELECT stream_id, frame, 'fill', 1, 28, flat FROM f
 UNION ALL SELECT stream_id, frame, 'sparse', 2, 18 + 9 * k, k > 0 FROM f UNION ALL SELECT stream_id, frame, 'residual', 3, 27 + 9 * k, k > 0 FROM f
 UNION ALL SELECT stream_id, frame, 'prev_diff', 4, 38 + CASE WHEN k > 0 THEN 14 + 9 * k ELSE 0 END, true FROM f UNION ALL SELECT stream_id, frame, 'raw', 5, 109, true FROM f)"""


def winner(spark, sf_dir):
    return court.winners(_court(spark, sf_dir))


WINNER = f"WITH {COURT} SELECT stream_id, frame, family, CAST(payload AS BIGINT) AS payload FROM c WHERE valid QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY payload, ord) = 1"


def stats(spark, sf_dir):
    return court.family_stats(_court(spark, sf_dir))


STATS = f"WITH {COURT} SELECT family, count(*) AS evaluated, count(*) FILTER (valid) AS valid, CAST(coalesce(min(payload) FILTER (valid), 0) AS BIGINT) AS best FROM c GROUP BY family"
BUCKETS = ("placement", "velocity", "overlay", "advance", "clear")
BUCKET_OF = {"click": "placement", "purchase": "velocity", "signup": "overlay", "view": "advance", "error": "clear"}
BYTES_OF = {"click": 13, "purchase": 13, "signup": 14, "view": 1, "error": 1}


def buckets(spark, sf_dir):
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("op")]
    return court.cost_buckets(log(spark, sf_dir).select("stream_id", pick(BUCKET_OF).alias("bucket"), (pick(BYTES_OF) + 13).cast("long").alias("bytes")), BUCKETS)


BUCKETS_SQL = f"""WITH {LOG} SELECT stream_id, 26 * count(*) FILTER (op = 'click') AS placement, 26 * count(*) FILTER (op = 'purchase') AS velocity, 27 * count(*) FILTER (op = 'signup') AS overlay,
14 * count(*) FILTER (op = 'view') AS advance, 14 * count(*) FILTER (op = 'error') AS clear, 26 * count(*) FILTER (op IN ('click', 'purchase')) + 27 * count(*) FILTER (op = 'signup') + 14 * count(*) FILTER (op IN ('view', 'error')) AS total FROM ev GROUP BY stream_id"""


def _wins(spark, sf_dir):
    return log(spark, sf_dir).select("stream_id", F.col("t").alias("frame"), F.col("op").alias("family"), F.col("cents").alias("payload"))


WINS = f"""{LOG}, w AS (SELECT stream_id, t AS frame, op AS family, cents AS payload FROM ev),
o AS (SELECT a.*, (SELECT list(b.payload ORDER BY b.payload) FROM w b WHERE b.stream_id = a.stream_id AND b.frame BETWEEN a.frame - 11 AND a.frame) AS ps,
 (SELECT count(*) FROM w b WHERE b.stream_id = a.stream_id AND b.family = a.family AND b.frame BETWEEN a.frame - 11 AND a.frame) AS mine,
 (SELECT count(*) FROM w b WHERE b.stream_id = a.stream_id AND b.family = a.family AND b.frame BETWEEN a.frame - 12 AND a.frame - 1) AS seen FROM w a),
al AS (SELECT *, frame > 1 AND seen = 0 OR len(ps) >= 5 AND ps[len(ps) // 2 + 1] > 0 AND payload > 3 * ps[len(ps) // 2 + 1] AS alpha FROM o)"""


def governed(spark, sf_dir):
    return govern.observed(_wins(spark, sf_dir)).select("stream_id", "frame", "phi", "median", "alpha", "since")


GOVERNED = f"""WITH {WINS} SELECT stream_id, frame, mine / len(ps) AS phi, ps[len(ps) // 2 + 1] AS median, alpha,
 frame - coalesce((SELECT max(b.frame) FROM al b WHERE b.stream_id = al.stream_id AND b.alpha AND b.frame <= al.frame), 0) AS since FROM al"""


def omega(spark, sf_dir):
    return govern.drift(_wins(spark, sf_dir)).select("stream_id", "frame", "omega")


OMEGA = f"""WITH RECURSIVE {WINS}, fams AS (SELECT DISTINCT family FROM w),
s AS (SELECT a.stream_id, a.frame, f.family, (SELECT count(*) FROM w b WHERE b.stream_id = a.stream_id AND b.family = f.family AND b.frame BETWEEN a.frame - 11 AND a.frame) / least(12, a.frame) AS p FROM w a, fams f),
dl AS (SELECT a.stream_id, a.frame, sum(abs(a.p - coalesce(b.p, 0))) AS d FROM s a LEFT JOIN s b ON b.stream_id = a.stream_id AND b.family = a.family AND b.frame = a.frame - 1 WHERE a.p > 0 GROUP BY ALL),
om AS (SELECT stream_id, frame, d AS omega FROM dl WHERE frame = 1 UNION ALL SELECT dl.stream_id, dl.frame, 0.5 * d + 0.5 * omega FROM om JOIN dl ON dl.stream_id = om.stream_id AND dl.frame = om.frame + 1)
SELECT stream_id, frame, omega FROM om"""


def plan(spark, sf_dir):
    return govern.plans(_wins(spark, sf_dir))


PLAN = f"""WITH {WINS} SELECT stream_id, frame, CASE WHEN alpha THEN 'broaden' WHEN frame % 6 = 0 THEN 'sweep' ELSE 'trusted' END AS plan,
 (SELECT string_agg(DISTINCT b.family, ',' ORDER BY b.family) FROM w b WHERE b.stream_id = al.stream_id AND b.frame BETWEEN al.frame - 11 AND al.frame) AS trusted FROM al"""

_ALL = {
    "o7_1_frame_diff": (diff, DIFF),
    "o7_2_uniform_rows": (uniform, UNIFORM),
    "o7_3_fit_gradient": (gradients, GRADIENTS),
    "o7_3_fit_checker": (checkers, CHECKERS),
    "o7_5_fit_motion_runs": (runs, RUNS),
    "o7_5_fit_accelerations": (accelerated, ACCELERATED),
    "o7_7_palette_index_map": (indexes, INDEXES),
    "o7_8_changed_boxes": (changed, CHANGED),
    "o7_10_row_hash_matches": (same_rows, SAME_ROWS),
    "o7_11_blit_matches": (matches, MATCHES),
    "o7_12_search_translation": (displacement, DISPLACEMENT),
    "o7_17_background_candidates": (backgrounds, BACKGROUNDS),
    "o8_family_winner": (winner, WINNER),
    "o8_18_family_stats": (stats, STATS),
    "o8_20_cost_buckets": (buckets, BUCKETS_SQL),
    "o9_2_governor_phi_alpha": (governed, GOVERNED),
    "o9_5_governor_omega": (omega, OMEGA),
    "o9_7_governor_plan": (plan, PLAN),
    "o10_2_velocity_collapse_gain": (collapse, COLLAPSE),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
