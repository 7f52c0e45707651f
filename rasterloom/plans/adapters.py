"""Domain tables from relational ones, once as DataFrames and once as SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all tasks: where each is much work, a table of few bytes must not be one task's."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition log: stream_id, t (1, 2, ... within the stream), event_id, op, k, cents."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(order).cast("long").alias("t"), "event_id", F.col("event_type").alias("op"), k.alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"))


LOG = """ev AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_id,
  event_type AS op, CAST(props->>'$.k' AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames: stream_id, frame (0, 1, ...), y, x, v."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("stream_id"), "vec_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), "embedding")
    dense = rows.select("stream_id", "vec_id", "frame", F.posexplode("embedding").alias("p", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 128).cast("int")))
    return dense.select("stream_id", "vec_id", "frame", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), v.alias("v"))


FRAMES = """fr AS (SELECT label AS stream_id, vec_id, frame, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 128) AS INTEGER))) AS v FROM (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, unnest(embedding) AS e,
  unnest(range(0, len(embedding))) AS p FROM embeddings))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill instances on a 64 x 48 canvas for each part: stream_id, z, x, y, w, h, v; some reach over the edge."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("stream_id"), k.alias("z"), (k % 70 - 3).alias("x"), (k * 7 % 54 - 3).alias("y"), (2 + k % 7).alias("w"), (1 + k % 5).alias("h"), (k * 13 % 256).cast("int").alias("v"))


BOXES = """bx AS (SELECT CAST(p_size AS INTEGER) AS stream_id, p_partkey AS z, p_partkey % 70 - 3 AS x, p_partkey * 7 % 54 - 3 AS y,
  2 + p_partkey % 7 AS w, 1 + p_partkey % 5 AS h, CAST(p_partkey * 13 % 256 AS INTEGER) AS v FROM part)"""
WIDTH, HEIGHT = 64, 48


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by content: root (the source), seq (publishing order), cid, bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("root"), F.col("doc_id").alias("seq"), F.sha2(text, 256).alias("cid"), F.octet_length(text).cast("long").alias("bytes"))


BLOBS = """bl AS (SELECT coalesce(source, '') AS root, doc_id AS seq, sha256(coalesce(text, '')) AS cid,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents)"""


def packets(spark: SparkSession, sf_dir: str, lossy: bool = True) -> DataFrame:
    """Packets of a stream for each customer: stream_id, seq, ident, size. For what deals with losses every 17th order is lost."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("o_orderkey").alias("ident"), (F.col("o_orderkey") % 97 + 9).alias("size"))
    return rows.filter("ident % 17 <> 0") if lossy else rows


ALL_PACKETS = """pk AS (SELECT o_custkey AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
  o_orderkey AS ident, o_orderkey % 97 + 9 AS size FROM orders)"""
PACKETS = ALL_PACKETS.removesuffix(")") + " QUALIFY ident % 17 <> 0)"
