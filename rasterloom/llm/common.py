"""What the operators of this subpackage share: tables, the shared folder, batches of text, hashes of words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
#: Text is worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 2 << 20
#: Rows go to Python workers in batches of about so many bytes: 10,000 rows of text (Spark's bound) are some 20 MB, held several times
#: by the JVM outside its heap and again by the worker.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """spark, with batches of BATCH bytes unless the session names another size."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return spark


def local(spark: SparkSession, **columns: tuple[list, pa.DataType]) -> DataFrame:
    """A small table of values that the driver has. By Arrow: from a list of rows Spark starts Python workers of another kind, which
    stay on the executors beside those of the operators."""
    return spark.createDataFrame(pa.table({k: pa.array(*v) for k, v in columns.items()}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where unset, and Spark runs in one process, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Removes the shuffle files of a write when it has ended; until then a lost executor's are made again.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and lost executors cost no recomputation.

    Nothing reads the shuffles behind a written table again, so they go with the write and do not add up over an operator's steps.
    """
    spark = bounded(df.sparkSession)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables that written() has made, once all that reads them is itself written."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sliced(batches, column: str = "text", limit: int | None = None):
    """Batches cut into slices of about limit bytes (SLICE) of one string column."""
    limit = limit or SLICE
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = offsets_of(batch.column(at))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def offsets_of(arr) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def bytes_of(arr) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    ends = offsets_of(arr)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def words_of(data: np.ndarray, ends: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each row (one more entry than rows)."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any run of items by differences of prefix sums, in wrapping 64-bit arithmetic."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = -(-n // 262144) * 262144
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.down[lo])


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


class WordHash:
    """64-bit hashes of the words of a slice of text: eight bytes at a time, each step a bijection of what it takes in.

    Words of up to eight bytes and one length never share a hash; others do by chance alone, about once in 2**64 pairs.
    """

    def __init__(self, lower: bool = False):
        self.lower = lower

    def __call__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = LOWER_TABLE[data] if self.lower else data
        lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
        size = stops - starts
        h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(size <= LONG_WORD)
        done = 0
        while len(at):
            lane = np.ascontiguousarray(lanes[starts[at] + done]).view("<u8").ravel()
            h[at] = mixed(h[at] ^ (lane & TAIL[np.minimum(size[at] - done, 8)])) + np.uint64(done)
            done += 8
            at = at[size[at] > done]
        for k in np.flatnonzero(size > LONG_WORD):
            h[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : stops[k]].tobytes())
        return h


def single_spaced(data: np.ndarray, ends: np.ndarray, separator: np.ndarray = WHITE):
    """The words of a slice with one space between any two of a row, and start and end of each there, and the first word of each row."""
    starts, stops, first = words_of(data, ends, separator)
    keep = ~separator[data]
    after = stops[stops < len(data)]
    keep[after] = True  # the byte behind a word: white space, or the next row's first
    flat = data[keep].copy()
    flat[separator[flat]] = 0x20
    begin = (np.cumsum(keep, dtype=np.int32)[starts] - 1).astype(np.int64) if len(starts) else starts
    return flat, begin, begin + (stops - starts), first
