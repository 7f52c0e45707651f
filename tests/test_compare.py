import random

from pyspark.sql import functions as F
from rasterloom.operators import compare


def test_moves_of_odd_frames(spark):
    """Frames with gaps, of unequal shape, and streams with a missing frame."""
    rng = random.Random(2)
    rows = [(s, f, y, x, rng.randrange(4)) for s in range(2) for f in (0, 1, 2, 4, 5) for y in range(-1, 3 + f % 2) for x in range(4) if rng.random() < 0.8]
    at = {r[:4]: r[4] for r in rows}
    want = {}
    for (s, f, y, x), v in at.items():
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if (prev := at.get((s, f - 1, y - dy, x - dx))) is not None:
                    sad, n, bad = want.get((s, f, dy, dx), (0, 0, 0))
                    want[s, f, dy, dx] = sad + abs(v - prev), n + 1, bad + (v != prev)
    got = compare.displaced(spark.createDataFrame(rows, "stream_id int, frame long, y int, x int, v int"), 1)
    assert {tuple(r[:4]): tuple(r[4:]) for r in got.collect()} == want


def test_samples_are_not_broadcast(spark):
    """Sizes of exploded samples are underrated by the planner; tables of them must not reach the driver."""
    cells = spark.range(50).select(F.lit(1).alias("stream_id"), F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    cells = cells.select("stream_id", "frame", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).alias("x"), ((F.col("p") * 3 + F.col("frame")) % 256).cast("int").alias("v"))
    for df in (compare.displaced(cells, 1), compare.best_displacement(cells, 1), compare.fit_gradient(cells.withColumnRenamed("frame", "z"), ["z"])):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
