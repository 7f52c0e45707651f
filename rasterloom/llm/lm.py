"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = a[b] c(v w) / c(v) + u[b] c(w) / N + o[b] / (V + 1), where b is the bucket of the context's frequency (powers of two).
The weights come from expectation-maximisation on held-out counts: each training token is scored with its own occurrence deleted
from all counts. The training set is every row but the held-out ones; all counts cover all of it.

Counts travel in blocks. A block (some MB of text) is coded once as numbers of its distinct tokens; it asks each bucket of the
key space for its distinct n-grams in one message, the bucket adds up what all blocks sent and answers in the same order. So
an n-gram costs a few bytes for each block that has it, not a row for each place, and no task holds more than a bucket. A block
asks at most FAN buckets and a bucket is asked by at most some FAN blocks: where the corpus has more of either, FAN blocks' asks
for one bucket are merged, cut into FAN finer buckets and asked on from there (`totals`), level by level. The messages of every
level are in proportion to the corpus.

Words are told apart by 64-bit hashes that take in every byte (common.WordHash), pairs by hashes of those; among V distinct words
about V**2 / 2**65 pairs share one. Defined results: a null or empty text is one end token; a null doc_id counts as an empty text
for the split; repeated rows are documents of their own; a very long text is a block of its own; an empty table has no rows;
without training rows every known count is 0 and all weight is on the uniform estimate; other columns are not carried along.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The hashes of the end of a text and of what stands before its first token.
END, BEGIN = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Tokens of the corpus for each bucket of the key space, about.
BUCKET_TOKENS = 4_000_000
#: Buckets that one block asks, blocks that are merged.
FAN = 256
BUCKETS, STEPS = 40, 8  # context-frequency buckets; steps of an octave in the histogram of ratios
RATIOS = 64 * STEPS
ROUNDS = 60


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8")


def packed_keys(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc_id, text, held): ids, token numbers per row, and tokens as numbers of the block's vocabulary."""

    def run(batches):
        hasher = common.WordHash(lower=True)
        for batch in common.sliced(batches):
            data, ends = common.bytes_of(batch.column("text"))
            starts, stops, first = common.words_of(data, ends)
            count = np.diff(first)
            tokens = np.full(len(starts) + len(count), END, np.uint64)
            tokens[np.arange(len(starts)) + np.repeat(np.arange(len(count)), count)] = hasher(data, starts, stops)
            words, number = np.unique(tokens, return_inverse=True)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
            train = int((count + 1)[held == 0].sum())
            ids = batch.column("doc_id")
            held |= ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1  # a second bit: no id
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([packed(ids.fill_null(0).to_numpy().view(np.uint64))]), pa.array([packed(count + 1)]), pa.array([packed(held)]), pa.array([packed_keys(words)]), pa.array([packed(number)]), pa.array([len(tokens)], pa.int64()), pa.array([train], pa.int64())],
                names=["block", "ids", "counts", "held", "words", "tokens", "n", "train"],
            )

    return docs.mapInArrow(run, "block string, ids binary, counts binary, held binary, words binary, tokens binary, n long, train long")


class Block:
    """A coded block: its tokens, contexts, and for each order its distinct n-grams."""

    def __init__(self, counts: bytes, held: bytes, words: bytes, tokens: bytes):
        self.counts, self.held = unpacked(counts).astype(np.int64), (unpacked(held) & np.uint64(1)).astype(bool)
        self.words, self.number = unpacked_keys(words), unpacked(tokens).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.train = np.repeat(~self.held, self.counts)
        tokens = self.words[self.number]
        context = np.roll(tokens, 1)
        context[self.first] = BEGIN
        pair = common.mixed(common.mixed(context) + tokens)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def orders(self):
        return ((1, self.words, self.number), (2, self.pairs, self.pair))


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the key space begins in sorted keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["counts"], r["held"], r["words"], r["tokens"])
                for order, keys, number in b.orders():
                    n = np.bincount(number[b.train], minlength=len(keys))
                    at = bounds(keys, buckets)
                    full = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["block"]] * len(full)), pa.array(full, pa.int32()), pa.array([order] * len(full), pa.int32()), pa.array([packed_keys(keys[at[k] : at[k + 1]]) for k in full], pa.binary()), pa.array([packed(n[at[k] : at[k + 1]]) for k in full], pa.binary())],
                        names=["block", "bucket", "order", "keys", "counts"],
                    )

    return blocks.select("block", "counts", "held", "words", "tokens").mapInArrow(run, "block string, bucket int, order int, keys binary, counts binary")


def answered(asked: DataFrame) -> DataFrame:
    """For each message the corpus counts of its n-grams. v: distinct n-grams with training tokens, on a bucket's first message."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [unpacked_keys(x) for x in pdf["keys"]]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        keys = np.concatenate(keys)
        counts = np.concatenate([unpacked(x) for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts[order], first)
        total = np.empty_like(counts)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        v = np.zeros(len(pdf), np.int64)
        v[0] = int((sums > 0).sum())
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "order": pdf["order"].to_numpy(), "totals": [packed(x) for x in np.split(total, cuts)], "v": v})

    return asked.groupBy("bucket", "order").applyInPandas(run, "block string, bucket int, order int, totals binary, v long")


def sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several lists, and the sum of each one's counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def totals(asked: DataFrame, blocks: int, buckets: list[int]) -> DataFrame:
    """Answers, written, to what `blocks` blocks ask of the first of several finer and finer numbers of buckets, each a multiple of the one before."""
    if len(buckets) == 1:
        return common.written(answered(asked))
    groups, finer = max(1, -(-blocks // FAN)), buckets[1]
    asked = common.written(asked.withColumn("src", F.concat_ws("/", F.pmod(F.xxhash64("block"), F.lit(groups)), "bucket")))

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = sums([unpacked_keys(x) for x in pdf["keys"]], [unpacked(x) for x in pdf["counts"]])
        at = bounds(keys, finer)
        full = np.flatnonzero(np.diff(at))
        return pd.DataFrame({"block": key[0], "bucket": full, "order": key[1], "keys": [packed_keys(keys[at[k] : at[k + 1]]) for k in full], "counts": [packed(counts[at[k] : at[k + 1]]) for k in full]})

    def answer(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_keys(x) for x in own["keys"]]
        every = np.unique(np.concatenate(keys))
        got = got.sort_values("bucket")
        total = np.concatenate([unpacked(x) for x in got["totals"]])
        v = np.zeros(len(own), np.int64)
        v[0] = int(got["v"].sum())
        return pd.DataFrame({"block": own["block"].to_numpy(), "bucket": own["bucket"].to_numpy(), "order": own["order"].to_numpy(), "totals": [packed(total[np.searchsorted(every, k)]) for k in keys], "v": v})

    on = asked.groupBy("src", "order").applyInPandas(ask, "block string, bucket int, order int, keys binary, counts binary")
    got = totals(on, groups, buckets[1:])
    both = asked.groupBy("src", "order").cogroup(got.withColumnRenamed("block", "src").groupBy("src", "order"))
    out = common.written(both.applyInPandas(answer, "block string, bucket int, order int, totals binary, v long"))
    common.removed(asked, got)
    return out


def levels(buckets: int) -> list[int]:
    """Numbers of buckets from the coarsest level to the finest. What FAN blocks ask of one of FAN buckets is as much as one block
    asks of all, so every level but the last has as many as a block may ask."""
    out = [min(buckets, FAN)]
    while out[-1] < buckets:
        out.append(out[-1] * min(FAN, -(-buckets // out[-1])))
    return out


def counted(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """For each block its rows and the corpus counts of each token, of the pair it ends and of its context."""

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        b = Block(r["counts"], r["held"], r["words"], r["tokens"])
        got = got.sort_values("bucket")
        c = {}
        for order, keys, number in b.orders():
            totals = np.concatenate([unpacked(x) for x in got.loc[got["order"] == order, "totals"]])
            if len(totals) != len(keys):
                raise RuntimeError(f"{len(totals)} counts for {len(keys)} n-grams of block {r['block']}")
            c[order] = totals[number]
        v = int(got.loc[got["order"] == 1, "v"].sum())
        return pd.DataFrame({"ids": [r["ids"]], "counts": [r["counts"]], "held": [r["held"]], "c1": [packed(c[1])], "c2": [packed(c[2])], "v": [v]})

    return blocks.select("block", "ids", "counts", "held", "words", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "ids binary, counts binary, held binary, c1 binary, c2 binary, v long")


def terms(r: dict):
    """Of a counted block: tokens of each row, held rows, and for each token c(w), c(v w) and c(v)."""
    counts, held = unpacked(r["counts"]).astype(np.int64), (unpacked(r["held"]) & np.uint64(1)).astype(bool)
    c1, c2 = unpacked(r["c1"]).astype(np.int64), unpacked(r["c2"]).astype(np.int64)
    first = np.cumsum(counts) - counts
    before = np.roll(c1, 1)
    before[first] = c1[first + counts - 1]  # texts begin as often as they end
    return counts, held, first, c1, c2, before


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def ratio(p: np.ndarray) -> np.ndarray:
    """Steps of an octave of an estimate over the uniform one; 0 for nothing."""
    step = np.clip(np.rint(np.log2(np.where(p > 0, p, 1)) * STEPS).astype(np.int64) + RATIOS // 2, 1, RATIOS - 1)
    return np.where(p > 0, step, 0)


def histogram(counted: DataFrame, n: int, v: int) -> dict[int, int]:
    """How often training tokens, each deleted from the counts, have a context bucket and a pair of ratios. At most
    BUCKETS * RATIOS**2 numbers in theory, some thousand in practice, whatever the corpus."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts, held, _, c1, c2, before = terms(r)
                train = np.repeat(~held, counts)
                c1, c2, before = c1[train] - 1, c2[train] - 1, before[train] - 1
                p1 = c1 * (v + 1.0) / max(1, n - 1)
                p2 = np.where(before > 0, c2 * (v + 1.0) / np.maximum(before, 1), 0)
                key, times = np.unique((bucket(before) * RATIOS + ratio(p2)) * RATIOS + ratio(p1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(times)], names=["key", "times"])

    rows = counted.mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times")).collect()
    return {r["key"]: r["times"] for r in rows}


def weights(histogram: dict[int, int]) -> np.ndarray:
    """BUCKETS x (pair, token, uniform), by expectation-maximisation. A bucket without tokens has the weights of the one below."""
    out = np.full((BUCKETS, 3), 1 / 3)
    key = np.array(sorted(histogram), np.int64)
    times = np.array([histogram[k] for k in key.tolist()], float)
    step = lambda s: np.where(s > 0, 2.0 ** ((s - RATIOS // 2) / STEPS), 0)
    p = np.stack([step(key // RATIOS % RATIOS), step(key % RATIOS), np.ones(len(key))], axis=1)
    of = key // RATIOS**2
    for b in range(BUCKETS):
        mine = of == b
        if not mine.any():
            out[b] = out[b - 1] if b else (0, 0, 1)
            continue
        w = np.array([0, 0.5, 0.5]) if b == 0 else out[b]
        for _ in range(ROUNDS):
            share = w * p[mine]
            share *= (times[mine] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / times[mine].sum()
        w = np.maximum(w, [0, 0, 1e-7])
        out[b] = w / w.sum()
    return out


def scores(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    blocks = common.written(encode(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))))
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    n, buckets = size["train"], levels(max(1, -(-size["n"] // BUCKET_TOKENS)))
    answers = totals(asked(blocks, buckets[0]), size["blocks"], buckets)  # the messages to the buckets go before the blocks move
    counts = common.written(counted(blocks, answers))
    common.removed(answers, blocks)
    v = counts.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()["v"]
    w = weights(histogram(counts, n, v))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts, held, first, c1, c2, before = terms(r)
                lam = w[bucket(before)]
                p = lam[:, 0] * c2 / np.maximum(before, 1) + lam[:, 1] * c1 / max(1, n) + lam[:, 2] / (v + 1)
                by_row = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpacked(r["ids"]).view(np.int64), mask=(unpacked(r["held"]) > 1)), pa.array(held), pa.array(counts), pa.array(by_row((c1 > 0).astype(np.int64))), pa.array(np.full(len(counts), n)), pa.array(by_row(np.log10((c1 + 1) / (n + v + 1)))), pa.array(by_row(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, F.pmod(common.id_crc(F.col("doc_id")), F.lit(7)) == 2)

