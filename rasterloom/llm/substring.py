"""Substring dedup by seed and extend: documents meet on winnowed anchors, matches are extended both ways, repeats stay if long.

Of the eight-word grams of every window of 35 words the one with the smallest hash is the window's anchor (the seed).
Consecutive windows with one anchor form a run (about 14 windows); equal windows have equal anchors at equal offsets, so any
repeat meets in its anchor's group. Groups of one run go. In the others a match is first extended as far as the run goes, left
and right of the anchor: runs equal in all words that their windows reach repeat whole. Runs that differ there hold the edge of
a repeat; one copy of each is extended word by word in both directions: its windows are compared with those of the group's
other runs. Neighbouring marked windows join into the maximal repeats, which are `spans`. No step pairs the members of a group.

Runs and windows are told apart by BLAKE2b digests of 128 bits of their words; hashes of words only choose anchors, and anchors
that collide only share a group. Documents are told apart by 92 bits of the SHA-256 of doc_id and text.

Work is done when the function is called, step by step; each step is a table in the shared folder, so a lost executor costs one
step. Tables that only steps read are removed. Defined results: null and empty texts have no words; rows equal in doc_id and
text are documents of their own, so all copies go; texts shorter than a window keep all words; a null doc_id is an id like any
other; a text may have up to 2**27 words; columns named like a result are replaced by it, all others are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, GRAM = 35, 8
PLACE = np.uint64((1 << 28) - 1)


class Winnow:
    """Runs of windows of a slice of texts."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        if not 0 < gram <= window or window - gram >= 31:
            raise ValueError("a run's windows are a mask of 31 bits: window - gram must be under 31")
        self.window, self.gram = window, gram
        self.words, self.grams = common.WordHash(), common.Rolling(0x9FB21C651E98DF25)

    def load(self, data: np.ndarray, ends: np.ndarray) -> None:
        flat, self.begin, self.end, self.first = common.single_spaced(data, ends)
        self.h = self.words(flat, self.begin, self.end)
        self.flat = flat.tobytes()

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the words lo to hi - 1, as two numbers of 64 bits."""
        flat, new = self.flat, hashlib.blake2b
        out = b"".join([new(flat[a:b], digest_size=16).digest() for a, b in zip(self.begin[lo].tolist(), self.end[hi - 1].tolist())])
        return np.frombuffer(out, np.int64).reshape(-1, 2)

    def runs(self):
        """Row, first window (counted in the row), number of windows, anchor and digest of each run."""
        n, span = len(self.h) - self.window + 1, self.window - self.gram + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.view(np.uint64), none.reshape(0, 2)
        at = np.arange(len(self.h) - self.gram + 1)
        g = self.grams.runs(self.grams.sums(self.h), at, at + self.gram)
        least, width = (g & ~PLACE) | at.astype(np.uint64), 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:n], least[span - width : span - width + n])
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        s = np.flatnonzero(row[:n] == row[self.window - 1 :])
        if not len(s):
            return none, none, none, none.view(np.uint64), none.reshape(0, 2)
        a = (least[s] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (a[1:] != a[:-1])]))
        count = np.diff(np.append(new, len(s)))
        s, a = s[new], a[new]
        return row[s], s - self.first[row[s]], count, g[a], self.digests(s, s + count + self.window - 1)

    def windows(self, row: int, start: np.ndarray, count: np.ndarray):
        """Digests of the windows of some runs of one row, run after run."""
        s = np.repeat(start + self.first[row], count) + np.concatenate([np.arange(c) for c in count])
        return self.digests(s, s + self.window)


def _keyed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """did (60 bits) and tkey (32 bits) tell documents apart; rows equal in both doc_id and text share them and their fate."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), "?").otherwise(":"), F.coalesce("text", F.lit("")))
    named = docs.select(F.sha2(whole.cast("binary"), 256).alias("__key"), F.col("text").cast("string").alias("text"), *extra)
    bits = lambda first, n: F.conv(F.substring("__key", first, n), 16, 10).cast("long")
    return named.select(bits(1, 15).alias("__did"), bits(16, 8).alias("__tkey"), "text", *extra)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(__did, __tkey, __marks): for each document with repeats its runs as start * 32 + windows, and a mask of the repeated windows."""
    word = ["d1", "d2"]  # the digest of a run

    def seed(batches):
        winnow = Winnow(window, gram)
        for batch in common.sliced(batches):
            winnow.load(*common.bytes_of(batch.column("text")))
            row, start, count, anchor, digest = winnow.runs()
            did = batch.column("__did").to_numpy()[row]
            place = (batch.column("__tkey").to_numpy()[row] << 32) | (start << 5) | count
            yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(place), pa.array(anchor.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["did", "place", "anchor", *word])

    keyed = _keyed(docs, [])
    seeds = common.written(keyed.mapInArrow(seed, "did long, place long, anchor long, d1 long, d2 long"))
    # keys to join are written first: a join of two plain exchanges is one whose hot keys Spark can split
    often = common.written(seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    met = common.written(seeds.join(often, "anchor"))
    common.removed(seeds, often)
    kinds = common.written(met.groupBy("anchor", *word).agg(F.count("*").alias("n"), F.min(F.struct("did", "place")).alias("one")))
    several = common.written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"))
    edges = common.written(kinds.join(several, "anchor").select(*word, "n", "one.did", "one.place"))
    common.removed(several)

    listed = F.collect_list(F.struct("place", *word)).alias("todo")
    todo = edges.groupBy(F.col("did").alias("__did"), F.shiftrightunsigned("place", 32).alias("__tkey")).agg(listed)
    there = keyed.join(todo, ["__did", "__tkey"])

    def extend(batches):
        winnow = Winnow(window, gram)
        for batch in common.sliced(batches):
            winnow.load(*common.bytes_of(batch.column("text")))
            out = [[], [], [], []]
            for row, todo in enumerate(batch.column("todo")):
                todo = todo.values
                place = todo.field("place").to_numpy() & 0xFFFFFFFF
                count = place & 31
                out[0].append(np.repeat(todo.field("d1").to_numpy(), count))
                out[1].append(np.repeat(todo.field("d2").to_numpy(), count))
                out[2].append(np.concatenate([np.arange(c) for c in count]))
                out[3].append(winnow.windows(row, place >> 5, count))
            d1, d2, j, w = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1, d2, j, w[:, 0], w[:, 1])], names=[*word, "j", "w1", "w2"])

    # rows repeated in the table extend the same run again; the mask below is of distinct (run, j)
    wide = common.written(there.mapInArrow(extend, "d1 long, d2 long, j long, w1 long, w2 long").distinct())
    twice = common.written(wide.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"))
    partly = wide.join(twice, ["w1", "w2"]).groupBy(*word).agg(F.bit_or(F.expr("shiftleft(1L, cast(j as int))")).alias("mask"))
    whole = kinds.filter("n > 1").select(*word, F.expr("shiftleft(1L, cast(one.place & 31 as int)) - 1").alias("mask"))
    masks = common.written(whole.unionAll(partly.join(edges.filter("n = 1").select(*word), word, "left_semi")))
    common.removed(wide, twice, kinds, edges)
    # without the join's keys what follows needs a shuffle of its own, and Spark may split a run that very many documents share
    marked = met.join(masks, word).select("did", "place", "mask")
    marks = F.collect_set(F.struct(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("run"), "mask")).alias("__marks")
    out = common.written(marked.groupBy(F.col("did").alias("__did"), F.shiftrightunsigned("place", 32).alias("__tkey")).agg(marks))
    common.removed(met, masks)
    return out


def covered(n_words: int, runs: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which words a marked window covers."""
    start, bits = runs >> 5, (masks[:, None] >> np.arange(31)) & 1
    run, j = np.nonzero(bits)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start[run] + j, 1)
    np.add.at(edge, np.minimum(start[run] + j + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed, and kept (the words left, joined by one space) or with digest=True kept_sha256 instead;
    spans are the removed runs of words, [first, end)."""
    result = ("n_words", "n_removed", "kept_sha256" if digest else "kept", "spans")
    extra = ["doc_id", *[c for c in docs.columns if c not in ("doc_id", "text", *result)]]
    joined = _keyed(docs, extra).join(repeats(docs, window, gram), ["__did", "__tkey"], "left")
    schema = joined.select(*extra).schema.add("n_words", "long").add("n_removed", "long").add(result[2], "string").add("spans", T.ArrayType(T.ArrayType(T.LongType())))

    def cut(batches):
        for batch in common.sliced(batches):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("__marks")):
                words, gone = (text or "").encode().split(), []
                total = len(words)
                if marks.is_valid:
                    marks = marks.values
                    out = covered(total, marks.field("run").to_numpy(), marks.field("mask").to_numpy(), window)
                    at = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                    gone = at.reshape(-1, 2).tolist()
                    words = [words[i] for i in np.flatnonzero(~out)]
                n_words.append(total)
                n_removed.append(total - len(words))
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                spans.append(gone)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[f.name for f in schema])

    return joined.select(*extra, "text", "__marks").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM (SELECT win.r, win.i, unnest(range(0, 35)) AS j FROM win JOIN again USING (k))),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM lost)) ANTI JOIN gone USING (r, p)
  GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN lost.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
