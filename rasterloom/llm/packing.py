"""Best-fit packing into bins of several permitted lengths.

Pieces are placed in falling order of length, each in the open bin, of whatever size, that it leaves the least room in. If none
has room, a bin is opened: the permitted length with the least cost for each token that it can still be filled with, which
weighs all lengths jointly against what is left to pack. In the end every bin shrinks to the shortest length that holds it.

A document is `words + 1` tokens (the end of the document counts, so an empty or null text is one token); one longer than the
longest bin is cut into pieces of that length and a rest. Rows are dealt by a hash of their place in the table, so that repeated
rows spread too, into groups of about GROUP pieces; groups are packed apart from each other, so a group fits a task and nothing
grows with the table. Where each piece is dealt is written before it is packed, so that a task that is run again packs alike.

Defined results: repeated rows and rows with null in any column are packed each; a very long text gives many pieces; an empty
table has no bins; other columns of docs, whatever their names, are not carried along.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Of a bin, in tokens: its length and what every bin costs on top.
OVERHEAD = 32
GROUP = 16384


def cost(length: int) -> float:
    return length + OVERHEAD


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """For each size, in the order given, its bin and its place there; and the length of each bin."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = sum(sizes)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    bins, places = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            if size > lengths[-1]:
                raise ValueError(f"a piece of {size} is longer than every bin")
            open_ = min((x for x in lengths if x >= size), key=lambda x: (price(x) / min(x, left), x))
            free, b = open_, len(used)
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    return bins, places, [next(x for x in lengths if x >= u) for u in used]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, first, size, dealt): docs (doc_id, text) cut to at most `longest` tokens."""
    tokens = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
    cut = docs.select("doc_id", tokens.alias("tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("dealt"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / longest))).alias("piece"))
    first = F.col("piece") * longest
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), first.alias("first"), F.least(F.col("tokens") - first, F.lit(longest)).cast("long").alias("size"), F.xxhash64("dealt", "piece").alias("dealt"))


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, piece, first token, size, pack_group, bin, place of its first token in it, bin_length."""
    cut = common.written(pieces(docs, max(lengths)))
    groups = max(1, -(-cut.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "dealt", "piece"], ascending=[False, True, True], kind="stable")
        bins, places, chosen = pack(pdf["size"].tolist(), lengths, price)
        return pdf.assign(bin=bins, place=places, bin_length=[chosen[b] for b in bins])[["doc_id", "piece", "first", "size", "pack_group", "bin", "place", "bin_length"]]

    dealt = cut.withColumn("pack_group", F.pmod("dealt", F.lit(groups)).cast("int"))
    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("pack_group").applyInPandas(run, f"doc_id {kind}, piece int, first long, size long, pack_group int, bin int, place long, bin_length int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
