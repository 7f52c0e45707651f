"""Queries of scalar functions, remaining fits, gates and prices, and round trips of sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import codec, compare, court, lossy, media
from ..sources import container, script
from ..sources import frames as raw
from ..streaming import receiver
from .adapters import FRAMES, LOG, PACKETS, frames, log, packets, read
from .search import FIELDS, _fields


def trajectories(spark, sf_dir):
    """Where programs of three segments are after n steps, in closed form; null beyond their end."""
    k = F.col("p_partkey")
    seg = lambda v, w, a, n: F.struct(v.cast("long").alias("vx"), w.cast("long").alias("vy"), a.cast("long").alias("a"), n.cast("long").alias("steps"))
    rows = read(spark, sf_dir, "part").select("p_partkey", (k % 23).alias("n"), F.array(seg(k % 7 - 3, k % 5, F.lit(0), 1 + k % 4), seg(k % 3, k % 11 - 5, k % 4 - 1, 2 + k % 6), seg(F.lit(2), F.lit(-1), F.lit(0), 1 + k % 9)).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("n").cast("long").alias("left"))

    def go(acc, s):
        m = F.least(acc["left"], s["steps"])
        ramp = s["a"] * F.shiftright(m * (m - 1), 1)
        return F.struct((acc["x"] + m * s["vx"] + ramp).alias("x"), (acc["y"] + m * s["vy"] + ramp).alias("y"), (acc["left"] - m).alias("left"))

    out = rows.withColumn("o", F.aggregate("s", start, go))
    here = lambda c: F.when(F.col("o.left") == 0, F.col(f"o.{c}")).alias(c)
    return out.select("p_partkey", here("x"), here("y"))


TRAJECTORIES = """WITH s AS (SELECT p_partkey AS k, p_partkey % 23 AS n, unnest([1, 2, 3]) AS i, unnest([p_partkey % 7 - 3, p_partkey % 3, 2]) AS vx, unnest([p_partkey % 5, p_partkey % 11 - 5, -1]) AS vy,
 unnest([0, p_partkey % 4 - 1, 0]) AS a, unnest([1 + p_partkey % 4, 2 + p_partkey % 6, 1 + p_partkey % 9]) AS m FROM part),
e AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY i, j) AS t, vx + a * j AS vx, vy + a * j AS vy FROM s, LATERAL (SELECT unnest(range(0, s.m)) AS j))
SELECT k AS p_partkey, CASE WHEN any_value(n) <= count(*) THEN CAST(coalesce(sum(vx) FILTER (t <= n), 0) AS BIGINT) END AS x, CASE WHEN any_value(n) <= count(*) THEN CAST(coalesce(sum(vy) FILTER (t <= n), 0) AS BIGINT) END AS y FROM e GROUP BY k"""


def scalars(spark, sf_dir):
    """Clips, depths, wire lengths, labels and tests of maps, a column each."""
    k = F.col("p_partkey")
    x, w = k * 7 % 90 - 20, 1 + k % 30
    a, c = F.when(k % 2 == 0, 256).otherwise(255), k * 37 % 1024 - 512
    kind = k % 5
    length = F.when(kind == 0, 13).when(kind == 1, 5 + 9 * (k % 9)).when(kind == 2, 9 + 17 * (k % 3)).when(kind == 3, 1).otherwise(9 + 2 * (k % 7))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.greatest(F.lit(0), F.least(F.lit(64), x + w) - F.greatest(F.lit(0), x)).cast("long").alias("clip"), scalar.depth_top((1 + k % 16).cast("int")).cast("int").alias("top"), length.cast("long").alias("wire"),
        F.when((a == 256) & (F.pmod(c, F.lit(256)) == 0), F.expr("cast((p_partkey * 37 % 1024 - 512) / 256 as long)")).alias("shift"), F.when(k % 8 == 0, "exact").otherwise(F.concat(F.lit("q"), (k % 8).cast("string"), F.when(k % 3 == 0, ":deadzone").otherwise(":halfup"), F.when(k % 2 == 0, ":box3").otherwise(""))).alias("label"),
        F.when((24000 * (1 + k % 3)) % (1 + k % 7) == 0, (24000 * (1 + k % 3) / (1 + k % 7)).cast("long")).alias("ticks"), F.when(k % 4 == 0, "typed").when(k % 4 == 1, "opaque").otherwise("unsupported").alias("side"),
        (1 - (k % 50 + k % 20) / (100 + k % 77)).cast("double").alias("procedural"), F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"),
    )


SCALARS = """SELECT p_partkey, CAST(len(list_filter(range(p_partkey * 7 % 90 - 20, p_partkey * 7 % 90 - 20 + 1 + p_partkey % 30), lambda i: i >= 0 AND i < 64)) AS BIGINT) AS clip, CAST(2 ** (1 + p_partkey % 16) - 1 AS INTEGER) AS top,
CASE p_partkey % 5 WHEN 0 THEN 13 WHEN 1 THEN 5 + 9 * (p_partkey % 9) WHEN 2 THEN 9 + 17 * (p_partkey % 3) WHEN 3 THEN 1 ELSE 9 + 2 * (p_partkey % 7) END AS wire,
CASE WHEN p_partkey % 2 = 0 AND p_partkey * 37 % 1024 IN (0, 256, 512, 768) THEN p_partkey * 37 % 1024 // 256 - 2 END AS shift,
CASE WHEN p_partkey % 8 = 0 THEN 'exact' ELSE 'q' || p_partkey % 8 || (CASE WHEN p_partkey % 3 = 0 THEN ':deadzone' ELSE ':halfup' END) || (CASE WHEN p_partkey % 2 = 0 THEN ':box3' ELSE '' END) END AS label,
CASE WHEN 24000 * (1 + p_partkey % 3) % (1 + p_partkey % 7) = 0 THEN 24000 * (1 + p_partkey % 3) // (1 + p_partkey % 7) END AS ticks, ['typed', 'opaque', 'unsupported', 'unsupported'][p_partkey % 4 + 1] AS side,
1 - (p_partkey % 50 + p_partkey % 20) / (100 + p_partkey % 77) AS procedural, sha256(p_name) AS digest FROM part"""


def lifting(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", (k * 31 % 511 - 255).alias("a"), (k * 57 % 511 - 255).alias("b"))
    w, v = scalar.rotate(F.col("a"), F.col("b"), scalar.ODD)
    out = rows.withColumns({"w": w, "v": v})
    a2, b2 = scalar.unrotate(F.col("w"), F.col("v"), scalar.ODD)
    return out.select("p_partkey", "w", "v", ((a2 == F.col("a")) & (b2 == F.col("b"))).alias("exact"))


LIFTING = """WITH r AS (SELECT p_partkey, p_partkey * 31 % 511 - 255 AS a, p_partkey * 57 % 511 - 255 AS b FROM part), u AS (SELECT *, a + CAST(floor(51 * b / 256) AS BIGINT) AS u FROM r),
v AS (SELECT *, b + CAST(floor(-98 * u / 256) AS BIGINT) AS v FROM u) SELECT p_partkey, u + CAST(floor(51 * v / 256) AS BIGINT) AS w, v, true AS exact FROM v"""


def region_grid(spark, sf_dir):
    """Replacing changed tiles of 4, 2 or 1: 13 for the group, 17 and 13 and the samples for each tile; the cheapest size wins."""
    changed = compare.with_previous(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 6))).filter("frame > 0 AND v <> prev")
    sizes = changed.withColumn("side", F.explode(F.array(F.lit(4), F.lit(2), F.lit(1))))
    tiles = sizes.select("stream_id", "frame", "side", F.expr("y div side").alias("ty"), F.expr("x div side").alias("tx")).distinct()
    cost = tiles.groupBy("stream_id", "frame", "side").agg((13 + F.count("*") * (30 + F.col("side") * F.col("side"))).alias("bytes"))
    return cost.groupBy("stream_id", "frame").agg(F.min(F.struct("bytes", (-F.col("side")).alias("s"))).alias("b")).select("stream_id", "frame", (-F.col("b.s")).alias("side"), F.col("b.bytes").cast("long").alias("bytes"))


REGION_GRID = f"""WITH {FRAMES}, c AS (SELECT a.stream_id, a.frame, a.y, a.x FROM fr a JOIN fr b ON b.stream_id = a.stream_id AND b.frame = a.frame - 1 AND a.x = b.x AND a.y = b.y WHERE a.v // 64 <> b.v // 64),
s AS (SELECT stream_id, frame, k AS side, 13 + count(DISTINCT (y // k) * 8 + x // k) * (30 + k * k) AS bytes FROM c, (VALUES (4), (2), (1)) t(k) GROUP BY stream_id, frame, k)
SELECT stream_id, frame, CAST(side AS INTEGER) AS side, CAST(bytes AS BIGINT) AS bytes FROM s QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY bytes, side DESC) = 1"""


def background_sweep(spark, sf_dir):
    """For each stream the background that leaves frame 0 the fewest points; of equals the smallest value."""
    own = frames(spark, sf_dir).withColumn("v", (F.shiftright("v", 4) * 16).cast("int"))
    tries = own.filter("frame = 0").join(compare.backgrounds(own, 8, 8).withColumnRenamed("v", "bg"), "stream_id")
    cost = tries.groupBy("stream_id", "bg").agg((18 + 9 * F.count(F.when(F.col("v") != F.col("bg"), 1))).alias("bytes"))
    return cost.groupBy("stream_id").agg(F.min(F.struct("bytes", "bg")).alias("b")).select("stream_id", "b.bg", F.col("b.bytes").cast("long").alias("bytes"))


BACKGROUND_SWEEP = f"""WITH {FRAMES}, q AS (SELECT stream_id, frame, x, y, v // 16 * 16 AS v FROM fr), m AS (SELECT stream_id, v FROM (SELECT stream_id, v, count(*) AS n FROM q GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, v DESC) = 1),
c AS (SELECT stream_id, v FROM m UNION SELECT stream_id, v FROM q WHERE frame = 0 AND x IN (0, 7) AND y IN (0, 7) UNION SELECT stream_id, unnest([0, 255]) FROM m)
SELECT c.stream_id, c.v AS bg, CAST(18 + 9 * count(*) FILTER (q.v <> c.v) AS BIGINT) AS bytes FROM c JOIN q ON q.stream_id = c.stream_id AND q.frame = 0 GROUP BY c.stream_id, c.v QUALIFY row_number() OVER (PARTITION BY c.stream_id ORDER BY bytes, bg) = 1"""


def substitution(spark, sf_dir):
    """Bytes saved where a raster is exactly a program: 77 as samples; 23 as a ramp, 20 as a checkerboard (the cheaper that fits)."""
    own = _fields(spark, sf_dir)
    ramps = compare.fit_gradient(own, ["z"]).select("z", F.lit("gradient").alias("kind"), F.lit(54).alias("saved"), F.lit(1).alias("ord"))
    boards = compare.fit_checker(own, ["z"]).select("z", F.lit("checker").alias("kind"), F.lit(57).alias("saved"), F.lit(0).alias("ord"))
    return ramps.unionByName(boards).groupBy("z").agg(F.min_by("kind", "ord").alias("kind"), F.max("saved").cast("long").alias("saved"))


SUBSTITUTION = f"""WITH {FIELDS}, s AS (SELECT *, (v - lag(v) OVER (PARTITION BY z, y ORDER BY x) + 256) % 256 AS dx, (v - lag(v) OVER (PARTITION BY z, x ORDER BY y) + 256) % 256 AS dy FROM fl),
ramp AS (SELECT z FROM s GROUP BY z HAVING min(dx) = max(dx) AND min(dy) = max(dy)), t AS (SELECT z, c, (x // c + y // c) % 2 AS odd, min(v) AS lo, max(v) AS hi FROM fl, (VALUES (1), (2), (4)) k(c) GROUP BY ALL),
b AS (SELECT DISTINCT p.z FROM t p JOIN t q ON p.z = q.z AND p.c = q.c AND p.odd = 0 AND q.odd = 1 WHERE p.lo = p.hi AND q.lo = q.hi AND p.lo <> q.lo)
SELECT z, 'checker' AS kind, CAST(57 AS BIGINT) AS saved FROM b UNION ALL SELECT z, 'gradient', 54 FROM ramp WHERE z NOT IN (SELECT z FROM b)"""


def frame_hashes(spark, sf_dir):
    rows = frames(spark, sf_dir).groupBy("stream_id", "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    return rows.select("stream_id", "frame", F.sha2(F.unhex(F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")), 256).alias("digest"))


FRAME_HASHES = f"WITH {FRAMES} SELECT stream_id, frame, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x))) AS digest FROM fr GROUP BY ALL"


def lossy_proof(spark, sf_dir):
    """Quantising what is quantised changes nothing, with and without the filter's first pass."""
    own = frames(spark, sf_dir)
    once = lossy.box3(own).withColumn("q", scalar.quantize(F.col("v"), 3))
    return once.withColumn("again", scalar.quantize(F.col("q"), 3)).groupBy("stream_id").agg(F.bool_and(F.col("q") == F.col("again")).alias("exact"), F.sum("q").cast("long").alias("total"))


LOSSY_PROOF = f"""WITH {FRAMES}, b AS (SELECT stream_id, (coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v) + 2) // 4 AS v FROM fr WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))
SELECT stream_id, true AS exact, CAST(sum(least(255, (v + 4) // 8 * 8)) AS BIGINT) AS total FROM b GROUP BY stream_id"""


def raw_reader(spark, sf_dir):
    """Frames packed back to back, sixteen a file, cut again."""
    rows = frames(spark, sf_dir).groupBy("stream_id", F.expr("frame div 16").alias("part")).agg(F.sort_array(F.collect_list(F.struct("frame", "y", "x", "v"))).alias("s"))
    files = rows.select(F.concat_ws("/", "stream_id", "part").alias("path"), F.unhex(F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")).alias("content"))
    return raw.dense(raw.raw_frames(files, 8, 8).filter("error IS NULL").drop("error"), 8).groupBy("path", "frame").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("weighted"))


RAW_READER = f"WITH {FRAMES} SELECT stream_id || '/' || frame // 16 AS path, frame % 16 AS frame, CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM fr GROUP BY ALL"


def container_files(spark, sf_dir):
    """Each stream's log as a container of its own: path, content."""
    rows = log(spark, sf_dir).select("stream_id", "t", "op", (F.col("event_id") % 64).alias("x"), (F.col("k") % 48).alias("y"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        make = {"click": lambda x, y: (0x22, [1, x, y], b""), "purchase": lambda x, y: (0x26, [1, x, y], b""), "view": lambda x, y: (0x27, [], b""), "signup": lambda x, y: (0x23, [x, y, 9], b""), "error": lambda x, y: (0x29, [], b"")}
        pdf = pdf.sort_values("t")
        groups = [(int(t), [make[op](int(x), int(y))]) for t, op, x, y in zip(pdf["t"], pdf["op"], pdf["x"], pdf["y"])]
        data = container.write(64, 48, [(container.FILL, [1, 8, 6, 200], b""), (container.CHECKPOINT, [0, 1, 1, 0, 0], b"")], groups)
        return pd.DataFrame({"path": [str(pdf["stream_id"].iloc[0])], "content": [data]})

    return rows.groupBy("stream_id").applyInPandas(build, "path string, content binary")


def containers(spark, sf_dir):
    """The containers read back: transitions by tag, and the last byte read."""
    parsed = container.from_binary(container_files(spark, sf_dir))
    count = lambda tag: F.count(F.when(F.col("tag") == tag, 1))
    return parsed.groupBy("path").agg(F.count("error").alias("errors"), count(0x22).alias("place"), count(0x26).alias("velocity"), count(0x27).alias("advance"), count(0x23).alias("patch"), count(0x29).alias("clear"), F.max(F.col("offset") + F.col("length")).alias("bytes"))


_HEAD = len(container.header(1, 1)) + 14 + 22
CONTAINERS = f"""WITH {LOG} SELECT CAST(stream_id AS VARCHAR) AS path, 0 AS errors, count(*) FILTER (op = 'click') AS place, count(*) FILTER (op = 'purchase') AS velocity, count(*) FILTER (op = 'view') AS advance,
count(*) FILTER (op = 'signup') AS patch, count(*) FILTER (op = 'error') AS clear, CAST({_HEAD} + 13 * count(*) + 13 * count(*) FILTER (op IN ('click', 'purchase')) + 14 * count(*) FILTER (op = 'signup') + count(*) FILTER (op IN ('view', 'error')) AS BIGINT) AS bytes FROM ev GROUP BY stream_id"""


def scripts(spark, sf_dir):
    """A script for each part, compiled and read back; every ninth has an object of no known kind."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    kind = F.when(k % 9 == 0, "cone").otherwise("fill")
    text = F.concat(F.lit("# part\ncanvas 64 48 background "), s(k % 256), F.lit(" object 1 "), kind, F.lit(" 4 3 "), s(k % 200), F.lit("\ninstance 1 1 "), s(k % 60), F.lit(" 0 at 1 move 1 "), s(k % 64), F.lit(" 2 advance at "), s(2 + k % 3), F.lit(" clear_overlay"))
    built = script.compiled(read(spark, sf_dir, "part").select(s(k).alias("name"), text.alias("text")))
    rows = container.from_binary(built.filter("error IS NULL").select(F.col("name").alias("path"), F.col("data").alias("content")))
    good = rows.groupBy(F.col("path").alias("name")).agg(F.count("*").alias("records"), F.max("t").alias("last"))
    return built.select("name", F.col("error").isNotNull().alias("wrong")).join(good, "name", "left")


SCRIPTS = "SELECT CAST(p_partkey AS VARCHAR) AS name, p_partkey % 9 = 0 AS wrong, CASE WHEN p_partkey % 9 <> 0 THEN 8 END AS records, CASE WHEN p_partkey % 9 <> 0 THEN 2 + p_partkey % 3 END AS last FROM part"


def receiver_states(spark, sf_dir):
    """The receiver over packets with gaps: what it applies and refuses."""
    kind = F.when(F.col("seq") == 0, "header").when(F.col("seq") == 1, "object").when(F.col("seq") == 2, "checkpoint").otherwise("interval")
    rows = packets(spark, sf_dir).select("stream_id", F.col("seq").alias("arrival"), "seq", kind.alias("kind"), F.when(F.col("seq") > 2, F.col("seq") - 2).alias("t"))
    return receiver.received_batch(rows).groupBy("stream_id").agg(F.count(F.when(F.col("status") == "applied", 1)).alias("applied"), F.count(F.when(F.col("status") == "gap", 1)).alias("refused"), F.max("playable").alias("playable"))


RECEIVER_STATES = f"""WITH {PACKETS}, g AS (SELECT a.*, (SELECT count(*) FROM pk b WHERE b.stream_id = a.stream_id AND b.seq < a.seq) AS before FROM pk a)
SELECT stream_id, count(*) FILTER (before = seq) AS applied, count(*) FILTER (before <> seq) AS refused, CAST(greatest(0, count(*) FILTER (before = seq) - 2) AS BIGINT) AS playable FROM g GROUP BY stream_id"""


def strategies(spark, sf_dir):
    """Searching all families against the last two winners only: bytes and candidates, for each stream."""
    cands = court.candidates(frames(spark, sf_dir).withColumn("v", F.shiftright("v", 5)), 64)
    best = court.winners(cands)
    order = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(-2, -1)
    trusted = best.withColumn("trusted", F.collect_set("family").over(order)).select("stream_id", "frame", "trusted", F.col("payload").alias("full"))
    # the raw frame is always tried, so that a guided search never lacks a winner
    tried = cands.join(trusted, ["stream_id", "frame"]).filter((F.size("trusted") == 0) | F.expr("array_contains(trusted, family)") | (F.col("family") == "raw"))
    guided = tried.groupBy("stream_id", "frame").agg(F.count("*").alias("n"), F.min(F.when(F.col("valid"), F.col("payload"))).alias("guided"), F.max("full").alias("full"))
    return guided.groupBy("stream_id").agg(F.sum("n").alias("guided_candidates"), (6 * F.count("*")).alias("all_candidates"), F.sum("guided").alias("guided_bytes"), F.sum("full").alias("full_bytes"))


STRATEGIES = """WITH {COURT}, w AS (SELECT stream_id, frame, family, payload FROM c WHERE valid QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY payload, ord) = 1),
t AS (SELECT c.stream_id, c.frame, count(*) AS n, min(c.payload) FILTER (c.valid) AS guided FROM c WHERE c.family = 'raw' OR c.frame = 1 OR EXISTS (SELECT 1 FROM w WHERE w.stream_id = c.stream_id AND w.frame BETWEEN c.frame - 2 AND c.frame - 1 AND w.family = c.family) GROUP BY ALL)
SELECT t.stream_id, CAST(sum(n) AS BIGINT) AS guided_candidates, 6 * count(*) AS all_candidates, CAST(sum(guided) AS BIGINT) AS guided_bytes, CAST(sum(w.payload) AS BIGINT) AS full_bytes FROM t JOIN w ON w.stream_id = t.stream_id AND w.frame = t.frame GROUP BY t.stream_id"""


def affine_budget(spark, sf_dir):
    """Work of affine instances against a cap, before anything is painted."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("stream_id"), (1 + k % 300).alias("width"), (1 + k % 200).alias("height"))
    return media.work_within(rows, 500000).select("stream_id", "work", (~F.col("ok")).alias("over"))


AFFINE_BUDGET = "SELECT CAST(p_size AS INTEGER) AS stream_id, CAST(sum((1 + p_partkey % 300) * (1 + p_partkey % 200)) AS BIGINT) AS work, sum((1 + p_partkey % 300) * (1 + p_partkey % 200)) > 500000 AS over FROM part GROUP BY p_size"


def transform_blocks(spark, sf_dir):
    """Blocks of frame differences that a transform codes: how many are not all zero, and the sum of their coded magnitudes."""
    diff = compare.with_previous(frames(spark, sf_dir)).filter("frame > 0").withColumn("v", F.col("v") - F.col("prev"))
    out = codec.transform(codec.blocks4(diff))
    size = sum((scalar.zigzag(F.col(f"s{k}")) for k in range(16)), F.lit(0))
    return out.withColumn("z", size).groupBy("stream_id", "frame").agg(F.count(F.when(F.col("z") > 0, 1)).alias("coded"), F.sum(F.when(F.col("s0") >= 0, F.col("s0") * 2).otherwise(-F.col("s0") * 2 - 1)).cast("long").alias("dc"))


def _transform_blocks_sql() -> str:
    from .media import DCT

    inner = DCT.replace(f"WITH {FRAMES}, b AS (SELECT stream_id, frame, y // 4 AS qy, x // 4 AS qx, y % 4 AS i, x % 4 AS j, v FROM fr)", f"WITH {FRAMES}, b AS (SELECT a.stream_id, a.frame, a.y // 4 AS qy, a.x // 4 AS qx, a.y % 4 AS i, a.x % 4 AS j, a.v - p.v AS v FROM fr a JOIN fr p ON p.stream_id = a.stream_id AND p.frame = a.frame - 1 AND p.x = a.x AND p.y = a.y)")
    head = inner[: inner.rindex("SELECT stream_id, frame, qy AS by")]
    return head + "SELECT stream_id, frame, count(DISTINCT qy * 2 + qx) FILTER (v <> 0) AS coded, CAST(sum(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END) FILTER (i = 0 AND j = 0) AS BIGINT) AS dc FROM c GROUP BY ALL"


def _strategies_sql() -> str:
    from .search import COURT

    return STRATEGIES.replace("{COURT}", COURT)


_ALL = {
    "o1_1_container_roundtrip": (containers, CONTAINERS),
    "o1_8_raw_frames": (raw_reader, RAW_READER),
    "o1_11_script_reader": (scripts, SCRIPTS),
    "o3_7_affine_budget": (affine_budget, AFFINE_BUDGET),
    "o4_1_trajectory_closed_form": (trajectories, TRAJECTORIES),
    "o4_11_lifting_rotation": (lifting, LIFTING),
    "o4_scalar_functions": (scalars, SCALARS),
    "o6_5_transform_blocks": (transform_blocks, _transform_blocks_sql()),
    "o8_11_region_grid": (region_grid, REGION_GRID),
    "o8_12_background_sweep": (background_sweep, BACKGROUND_SWEEP),
    "o9_8_strategy_comparison": (strategies, _strategies_sql()),
    "o10_5_generator_substitution": (substitution, SUBSTITUTION),
    "o11_9_frame_hashes": (frame_hashes, FRAME_HASHES),
    "o12_6_receiver_states": (receiver_states, RECEIVER_STATES),
    "o14_3_lossy_proof": (lossy_proof, LOSSY_PROOF),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: o for k, (_, o) in _ALL.items()}
