"""Queries of the state operators over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from .adapters import LOG, log


def _e():
    return F.col("event_id")


def _k():
    return F.col("k")


def _op(mapping: dict[str, str]):
    out = None
    for event, op in mapping.items():
        out = F.when(F.col("op") == event, op) if out is None else out.when(F.col("op") == event, op)
    return out.otherwise("none")


def positions(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", _op({"click": "place", "purchase": "velocity", "view": "advance"}).alias("op"), (_e() % 64).alias("px"), (_k() % 48).cast("long").alias("py"), (_k() % 5 - 2).cast("long").alias("pvx"), (_e() % 5 - 2).alias("pvy"))
    return state.positions(rows).select("stream_id", "t", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy"))


POSITIONS = f"""WITH RECURSIVE {LOG},
st AS (SELECT stream_id, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS vx, CAST(0 AS BIGINT) AS vy FROM ev GROUP BY stream_id
 UNION ALL
 SELECT st.stream_id, ev.t, CASE op WHEN 'click' THEN event_id % 64 WHEN 'view' THEN x + vx ELSE x END,
  CASE op WHEN 'click' THEN k % 48 WHEN 'view' THEN y + vy ELSE y END,
  CASE op WHEN 'purchase' THEN k % 5 - 2 ELSE vx END, CASE op WHEN 'purchase' THEN event_id % 5 - 2 ELSE vy END
 FROM st JOIN ev ON ev.stream_id = st.stream_id AND ev.t = st.t + 1)
SELECT stream_id, t, x, y, vx, vy FROM st WHERE t > 0"""


def position_asof(spark, sf_dir):
    rows = log(spark, sf_dir)
    at = lambda c, a: state.latest(c, F.col("op") == "click", ["stream_id"]).cast("long").alias(a)
    return rows.select("stream_id", "t", at(_e() % 64, "x"), at(_k() % 48, "y"))


POSITION_ASOF = f"""WITH {LOG}, c AS (SELECT stream_id, t, event_id % 64 AS x, CAST(k % 48 AS BIGINT) AS y FROM ev WHERE op = 'click')
SELECT ev.stream_id, ev.t, c.x, c.y FROM ev ASOF LEFT JOIN c ON ev.stream_id = c.stream_id AND ev.t >= c.t"""


def motion(spark, sf_dir):
    kinds = ["place", "velocity", "program", "affine", "advance", "advance_program", "advance_program", "advance", "program_end"]
    which = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(_e() * 7 + _k(), F.lit(9)) + 1).cast("int"))
    rows = log(spark, sf_dir).withColumn("which", which)
    long = lambda c, a: c.cast("long").alias(a)
    rows = rows.select("stream_id", "t", F.when(F.col("which") == "program_end", "program").otherwise(F.col("which")).alias("op"), long(_e() % 64, "px"), long(_k() % 48, "py"), long(_k() % 3 - 1, "pvx"), long(_e() % 3 - 1, "pvy"), long(F.col("cents") % 2, "pax"), long(_e() % 2, "pay"), long(F.when(F.col("which") == "program_end", 0).otherwise(1 + _e() % 4), "steps"), long((_k() % 3 == 0).cast("int"), "identity"))
    return state.motion(rows).select("stream_id", "t", "x", "y", "mode")


MOTION = f"""WITH RECURSIVE {LOG},
op AS (SELECT *, ['place','velocity','program','affine','advance','advance_program','advance_program','advance','program_end'][(event_id * 7 + k) % 9 + 1] AS o FROM ev),
st AS (SELECT stream_id, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, 'still' AS mode, CAST(0 AS BIGINT) AS vx, CAST(0 AS BIGINT) AS vy,
  CAST(0 AS BIGINT) AS ax, CAST(0 AS BIGINT) AS ay, CAST(0 AS BIGINT) AS todo FROM ev GROUP BY stream_id
 UNION ALL
 SELECT st.stream_id, op.t,
  CASE WHEN o = 'place' THEN event_id % 64 WHEN o = 'advance' AND mode = 'velocity' OR o = 'advance_program' AND mode = 'program' THEN x + vx ELSE x END,
  CASE WHEN o = 'place' THEN k % 48 WHEN o = 'advance' AND mode = 'velocity' OR o = 'advance_program' AND mode = 'program' THEN y + vy ELSE y END,
  CASE WHEN o = 'velocity' THEN (CASE WHEN k % 3 = 1 AND event_id % 3 = 1 THEN 'still' ELSE 'velocity' END) WHEN o = 'program' THEN 'program'
   WHEN o = 'program_end' THEN (CASE WHEN mode = 'program' THEN 'still' ELSE mode END) WHEN o = 'affine' THEN (CASE WHEN k % 3 = 0 THEN 'still' ELSE 'affine' END)
   WHEN o = 'advance_program' AND mode = 'program' AND todo = 1 THEN 'still' ELSE mode END,
  CASE WHEN o IN ('velocity', 'program') THEN k % 3 - 1 WHEN o = 'advance_program' AND mode = 'program' THEN vx + ax ELSE vx END,
  CASE WHEN o IN ('velocity', 'program') THEN event_id % 3 - 1 WHEN o = 'advance_program' AND mode = 'program' THEN vy + ay ELSE vy END,
  CASE WHEN o = 'program' THEN cents % 2 ELSE ax END, CASE WHEN o = 'program' THEN event_id % 2 ELSE ay END,
  CASE WHEN o = 'program' THEN 1 + event_id % 4 WHEN o = 'advance_program' AND mode = 'program' THEN todo - 1 ELSE todo END
 FROM st JOIN op ON op.stream_id = st.stream_id AND op.t = st.t + 1)
SELECT stream_id, t, x, y, mode FROM st WHERE t > 0"""


def overlay(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", _op({"signup": "patch", "error": "clear"}).alias("op"), (_e() % 64).alias("x"), (_k() % 48).cast("long").alias("y"), (F.col("cents") % 256).alias("v"))
    return state.overlay(rows)


OVERLAY = f"""WITH {LOG}, p AS (SELECT stream_id, t, event_id % 64 AS x, CAST(k % 48 AS BIGINT) AS y, cents % 256 AS v FROM ev a WHERE op = 'signup'
  AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.stream_id = a.stream_id AND b.op = 'error' AND b.t > a.t))
SELECT stream_id, x, y, v FROM p QUALIFY row_number() OVER (PARTITION BY stream_id, x, y ORDER BY t DESC) = 1"""


def palette(spark, sf_dir):
    entries = F.array(*[((_e() * (j + 1) + _k()) % 256).cast("long") for j in range(4)])
    rows = log(spark, sf_dir).select("stream_id", "t", _op({"purchase": "set", "signup": "patch"}).alias("op"), entries.alias("entries"), (_e() % 4).cast("int").alias("idx"), (F.col("cents") % 256).alias("v"))
    return state.palette(rows)


PALETTE = f"""WITH RECURSIVE {LOG},
st AS (SELECT stream_id, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT[]) AS p FROM ev GROUP BY stream_id
 UNION ALL
 SELECT st.stream_id, ev.t, CASE WHEN op = 'purchase' THEN [CAST((event_id * j + k) % 256 AS BIGINT) for j in range(1, 5)]
  WHEN op = 'signup' AND p IS NOT NULL THEN [CASE WHEN j = event_id % 4 + 1 THEN cents % 256 ELSE p[j] END for j in range(1, 5)] ELSE p END
 FROM st JOIN ev ON ev.stream_id = st.stream_id AND ev.t = st.t + 1)
SELECT stream_id, CAST(i AS INTEGER) AS idx, p[i + 1] AS v
FROM (SELECT st.stream_id, p, unnest(range(0, 4)) AS i FROM st JOIN (SELECT stream_id, max(t) AS t FROM ev GROUP BY stream_id) m USING (stream_id, t) WHERE p IS NOT NULL)"""


def instances(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", _op({"signup": "create", "error": "clear"}).alias("op"), (_k() % 6).cast("long").alias("id"))
    return state.instances(rows)


INSTANCES = f"""WITH {LOG}, c AS (SELECT stream_id, t, CAST(k % 6 AS BIGINT) AS id, (SELECT count(*) FROM ev b WHERE b.stream_id = a.stream_id AND b.op = 'error' AND b.t < a.t) AS life FROM ev a WHERE op = 'signup')
SELECT stream_id, life, id, t, (SELECT count(*) FROM c d WHERE d.stream_id = c.stream_id AND d.t < c.t) AS z,
  EXISTS (SELECT 1 FROM c d WHERE d.stream_id = c.stream_id AND d.life = c.life AND d.id = c.id AND d.t < c.t) AS duplicate FROM c"""


def bindings(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", _op({"view": "bind", "click": "bind", "error": "clear"}).alias("op"), (_k() % 6).cast("long").alias("id"), (_e() % 4).alias("palette"))
    return state.bindings(rows)


BINDINGS = f"""WITH {LOG}, b AS (SELECT stream_id, t, CAST(k % 6 AS BIGINT) AS id, event_id % 4 AS palette FROM ev WHERE op IN ('view', 'click')),
z AS (SELECT stream_id, max(t) AS t FROM ev WHERE op = 'error' GROUP BY stream_id)
SELECT * FROM (SELECT b.stream_id, id, arg_max(palette, b.t) AS palette FROM b LEFT JOIN z USING (stream_id) WHERE b.t > coalesce(z.t, 0) GROUP BY ALL) WHERE palette <> 0"""


def ingest_order(spark, sf_dir):
    rows = log(spark, sf_dir).select("stream_id", "t", F.when(_e() % 37 == 0, F.col("t") - 2).otherwise(F.col("t")).alias("at"))
    return state.first_error(rows)


INGEST_ORDER = f"""WITH {LOG}, a AS (SELECT stream_id, t, CASE WHEN event_id % 37 = 0 THEN t - 2 ELSE t END AS at FROM ev),
e AS (SELECT a.stream_id, a.t, CASE WHEN a.at < 1 THEN 'time below one' ELSE 'time goes back' END AS error FROM a LEFT JOIN a p ON p.stream_id = a.stream_id AND p.t = a.t - 1 WHERE a.at < 1 OR a.at < p.at)
SELECT stream_id, min(t) AS t, arg_min(error, t) AS error FROM e GROUP BY stream_id"""

QUERIES = {
    "o2_3_state_position_asof": position_asof,
    "o2_5_state_velocity_advance": positions,
    "o2_7_state_motion_setters": motion,
    "o2_12_overlay_latest": overlay,
    "o2_9_palette_patch_asof": palette,
    "o2_13_instance_life": instances,
    "o2_10_palette_bindings": bindings,
    "o15_2_ingest_time_order": ingest_order,
}
ORACLES = {
    "o2_3_state_position_asof": POSITION_ASOF,
    "o2_5_state_velocity_advance": POSITIONS,
    "o2_7_state_motion_setters": MOTION,
    "o2_12_overlay_latest": OVERLAY,
    "o2_9_palette_patch_asof": PALETTE,
    "o2_13_instance_life": INSTANCES,
    "o2_10_palette_bindings": BINDINGS,
    "o15_2_ingest_time_order": INGEST_ORDER,
}
