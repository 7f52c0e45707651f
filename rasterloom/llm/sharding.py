"""Resharding by minimum-cost flow: old shard sizes and new capacities give the block transfers that move the fewest bytes."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows above this size are placed first; the others even out what whole rows leave over.
FILLER = 1024
#: Rows of one block of an old shard, about.
BLOCK_ROWS = 16384


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest transport of all supply to demand (equal sums), by successive shortest paths with potentials.

    cost(i, j) is the price of one byte from i to j. Equal paths go to the lowest numbers, so a plan is reproducible.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, room: int, price: int) -> None:
        graph[u].append([v, room, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
        for j in range(m):
            arc(i, n + j, x, cost(i, j))
    for j, x in enumerate(demand):
        arc(n + j, sink, x, 0)
    potential = [0] * (n + m + 2)
    while True:
        best: list[int | None] = [None] * (n + m + 2)
        came: list[tuple[int, int] | None] = [None] * (n + m + 2)
        best[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for k, (v, room, price, _) in enumerate(graph[u]):
                there = d + price + potential[u] - potential[v]
                if room > 0 and (best[v] is None or there < best[v]):
                    best[v], came[v] = there, (u, k)
                    heapq.heappush(heap, (there, v))
        if best[sink] is None:
            break
        potential = [p + (b if b is not None else 0) for p, b in zip(potential, best)]
        push, v = None, sink
        while v != source:
            u, k = came[v]
            push = graph[u][k][1] if push is None else min(push, graph[u][k][1])
            v = u
        v = sink
        while v != source:
            u, k = came[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return {(i, v - n): graph[v][back][1] for i in range(n) for v, _, _, back in graph[i] if n <= v < n + m and graph[v][back][1] > 0}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(old_sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one. Old shard i stays in new shard i as far as that has room; a moved byte costs one."""
    return min_cost_flow(old_sizes, capacities, lambda i, j: int(i != j))


def _pieces(amounts: dict[tuple[int, int], int], i: int) -> list[tuple[int, int]]:
    """(new shard, bytes) along old shard i: first what stays, then by new shard."""
    return sorted(((j, x) for (a, j), x in amounts.items() if a == i), key=lambda p: (p[0] != i, p[0]))


def _choose(old: Column, middle: Column, cuts: dict[int, list[tuple[int, int]]]) -> Column:
    """New shard of a row from twice its middle offset in its old shard."""
    out = F.lit(None).cast("int")
    for i, parts in sorted(cuts.items(), reverse=True):
        pick, at = F.lit(parts[-1][0]), sum(x for _, x in parts)
        for j, x in reversed(parts):
            pick = F.when(middle < 2 * at, F.lit(j)).otherwise(pick)
            at -= x
        out = F.when(old == i, pick).otherwise(out)
    return out


def _offsets(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds 'before', the sum of size over the rows before each within keys. Blocks are summed first; a task holds one block."""
    block = Window.partitionBy(*keys, "block")
    sums = df.groupBy(*keys, "block").agg(F.sum("size").alias("in_block"))
    run = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "block", F.coalesce(F.sum("in_block").over(run), F.lit(0)).alias("upto"))
    inner = F.coalesce(F.sum("size").over(block.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("inner", inner).join(sums, [*keys, "block"]).withColumn("before", F.col("upto") + F.col("inner")).drop("inner", "upto")


def reshard(rows: DataFrame, old_shards: int, shards: int, filler: int = FILLER, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (old int, doc_id long, size long, and more) with shard int and slot long, sizes of the new shards nearly equal.

    The plan (min_cost_flow over shard sizes, old_shards + shards numbers) is solved on the driver; rows are placed by prefix
    sums of block sizes. Larger rows go first, by their middle; rows of at most `filler` bytes then fill each transfer up to
    its planned bytes. Slots are gapless in each shard. Repeated rows are rows of their own; a null doc_id sorts first; an
    empty table gives an empty result.
    """
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    spread = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1000003)) * 7919, F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", spread).withColumn("small", (F.col("size") <= filler).cast("int"))
    totals = {(r["old"], r["small"]): r["s"] for r in rows.groupBy("old", "small").agg(F.sum("size").alias("s")).collect()}
    sizes = [totals.get((i, 0), 0) + totals.get((i, 1), 0) for i in range(old_shards)]
    plan = transfers(sizes, even(sum(sizes), shards))
    placed = common.written(_offsets(rows, ["old", "small"], ["doc_id", "size", *[c for c in rows.columns if c == "text_crc32"]]))
    middle = 2 * F.col("before") + F.col("size")
    cuts = {}
    for i in range(old_shards):
        left, big, parts = sizes[i], totals.get((i, 0), 0), _pieces(plan, i)
        ends, at = [], 0
        for _, x in parts:
            at += x
            ends.append(at * big // left)
        if parts:
            cuts[i] = [(j, b - a) for (j, _), a, b in zip(parts, [0, *ends[:-1]], ends)]
    big = placed.filter("small = 0").withColumn("shard", _choose(F.col("old"), middle, cuts))
    done = {(r["old"], r["shard"]): r["s"] for r in big.groupBy("old", "shard").agg(F.sum("size").alias("s")).collect()}
    rest = {}
    for i in range(old_shards):
        if parts := [(j, max(0, x - done.get((i, j), 0))) for j, x in _pieces(plan, i)]:
            rest[i] = parts
    small = placed.filter("small = 1").withColumn("shard", _choose(F.col("old"), middle, rest))
    out = common.written(big.unionByName(small))
    counts = out.groupBy("shard", "old", "small", "block").agg(F.count("*").alias("n"))
    run = Window.partitionBy("shard").orderBy("old", "small", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "old", "small", "block", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("from"))
    inner = Window.partitionBy("shard", "old", "small", "block").orderBy("before", "doc_id")
    return out.withColumn("nth", F.row_number().over(inner) - 1).join(counts, ["shard", "old", "small", "block"]).withColumn("slot", (F.col("from") + F.col("nth")).cast("long")).drop("from", "nth", "block", "small", "before")


def affected(plan: dict[tuple[int, int], int], old_shards: int, shards: int) -> set[int]:
    """New shards whose files change: those that lose or receive bytes, or are new."""
    moved = {k for (i, j), x in plan.items() if i != j and x for k in (i, j)}
    return {j for j in moved if j < shards} | set(range(old_shards, shards))


def rewrite(old_path: str, placed: DataFrame, docs: DataFrame | None, keys: list[str], out_path: str, unique: bool = False) -> DataFrame:
    """Writes the rows whose shard changed, or whose shard others join, as out_path/shard=N.

    placed is what reshard() returned. Rows come from old_path/shard=N, N being `old`, or with an empty old_path from docs, by its
    column `old` if it has one; old shards that give no row to a written shard are not read. keys, which may be null, must tell
    rows of different size apart; rows equal in all of them are numbered and get one slot each (with unique=True none are equal, and
    the texts are not dealt out for that). Returns the shards written and their rows.
    """
    spark = placed.sparkSession
    changed = placed.filter("old <> shard")
    touched = [r["shard"] for r in changed.select(F.explode(F.array("old", "shard")).alias("shard")).distinct().collect()]  # at most one a shard
    moving = placed.filter(F.col("shard").isin(touched))
    sources = [r["old"] for r in moving.select("old").distinct().collect()]
    if old_path:
        paths = [f"{old_path}/shard={i}" for i in sorted(sources)]
        if paths:
            docs = spark.read.option("basePath", old_path).parquet(*paths).withColumnRenamed("shard", "old")
        else:
            docs = spark.createDataFrame([], placed.select(*keys).schema)
    elif "old" in docs.columns:
        docs = docs.filter(F.col("old").isin(sources))
    nth = F.lit(1) if unique else F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    moving = moving.select(*[F.col(k).alias(f"__{k}") for k in keys], "shard", "slot", nth.alias("__m"))
    same = F.col("__n") == F.col("__m")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    full = docs.withColumn("__n", nth).join(moving, same).drop("__n", "__m", *[f"__{k}" for k in keys])
    full.repartition("shard", F.floor(F.col("slot") / 100000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(out_path)
    return spark.read.schema(full.schema).parquet(out_path).groupBy("shard").agg(F.count("*").alias("rows"))


def old_layout(source: Column, shards: int = 12) -> Column:
    """The layout before: one of 12 shards by crc32 of the source, so a hot source makes one shard far too large."""
    return F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law `bytes`; the shards that change are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    row = {"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}  # tells every row from all others
    columns = ["doc_id", "size", "text_crc32", "old"]
    docs = docs.withColumns(row | {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "old": old_layout(F.col("source"))})
    out = common.written(reshard(common.written(docs.select(*columns, *row)), 12, 16))
    path = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}"
    rewrite("", out, docs, list(row), path, unique=True)
    files = spark.read.schema(out.select(*columns, "slot", "shard").schema).parquet(path)
    kept = out.join(F.broadcast(files.select("shard").distinct()), "shard", "left_anti")
    out = files.unionByName(kept.select(*files.columns))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
