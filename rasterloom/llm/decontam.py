"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items scans each text once.

Normal form: A-Z lower-cased, words are runs of bytes that are ASCII letters, digits or not ASCII, joined by one space. A
window is `window` consecutive words of an item; a shorter item that has words is one window.

Words are told apart exactly. Defined results: a null or empty text has no words and no hits; a very long text is scanned as a whole; an item without words has no windows; a null item_id is
named by an empty text, a null doc_id is carried along; repeated rows are each scanned; empty tables give no hits; columns named
like a result are replaced by it, all others are carried along.
"""

from __future__ import annotations

import math
import sys
import types
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Bytes of item text that one automaton may hold (some 0.5 GB); more items take more automata, one after the other.
BLOCK_BYTES = 4 << 20
#: Where the two symbols of a word begin (planes of private characters, which never meet), and those of an unknown word.
FIRST_HIGH, FIRST_LOW, UNKNOWN = 0xF0000, 0x100000, "--"
#: Upper case to lower case, bytes outside words to spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


class Machine:
    """The automaton of some items' windows.

    It runs over words, not letters: each word of the items is two symbols, so that a window is a short path and no state has many
    ways out; a word that no item has is a symbol that leads back to the start. Windows share beginnings; about 12 nodes of 40 bytes
    are kept for each word of the items.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = [(name, normal_words(text)) for name, text in items]
        vocabulary = sorted({w for _, words in texts for w in words})
        base = max(1, math.isqrt(len(vocabulary)) + 1)
        self.code = {w: chr(FIRST_HIGH + i // base) + chr(FIRST_LOW + i % base) for i, w in enumerate(vocabulary)}
        known: dict[str, set[str]] = {}
        for name, words in texts:
            for run in windows_of([self.code[w] for w in words], window):
                known.setdefault("".join(run), set()).add(name)
        self.machine = ahocorasick.Automaton()
        while known:
            key, names = known.popitem()
            self.machine.add_word(key, (len(key) // 2, tuple(sorted(names))))
        self.some = len(self.machine) > 0
        if self.some:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        hit, names = np.zeros(len(words), bool), set()
        if self.some and words:
            get = self.code.get
            for end, (n, ids) in self.machine.iter("".join([get(w, UNKNOWN) for w in words])):
                hit[end // 2 + 1 - n : end // 2 + 1] = True
                names.update(ids)
        return hit, names


def machine(name: str, items: list[tuple[str, str | None]], window: int) -> Machine:
    """The automaton of the items of that name. A worker keeps the last one it made, so that its next task does not build it again; it
    is kept outside of this module, which travels with every task."""
    kept = sys.modules.setdefault("rasterloom_kept", types.ModuleType("rasterloom_kept")).__dict__.setdefault("automata", {})
    if name not in kept:
        kept.clear()
        kept[name] = Machine(items, window)
    return kept[name]


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code points of the original text, end exclusive."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, stops, _ = common.words_of(raw, np.array([0, len(raw)]), np.frombuffer(NORMAL, np.uint8) == 32)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(points[starts[a]]), int(points[stops[b - 1]])) for a, b in zip(edges[::2], edges[1::2])]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size. A test set is small; its size is asked for first all the same."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    return [[(r["name"], r["text"]) for r in rows.filter(F.col("block") == k).collect()] for k in range(n)]


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, spans: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items (array of ids, sorted), and with spans=True hit_spans (runs in code points), to docs.

    The items of each block (small by BLOCK_BYTES) are broadcast and a worker builds their automaton once. A second block is a second
    pass over the rows, which carry their hits along as runs of words.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items", "hit_spans")]
    blocks = item_blocks(items, block_bytes)
    context = docs.sparkSession.sparkContext
    inner = docs.select(*kept).schema.add("__hits", T.ArrayType(T.IntegerType())).add("__names", T.ArrayType(T.StringType()))
    schema = docs.select(*kept).schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items", T.ArrayType(T.StringType()))
    if spans:
        schema = schema.add("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType())))

    def scanned(shared, name: str, first: bool, last: bool):
        def run(batches):
            one = None
            for batch in common.sliced(batches):
                one = one or machine(name, shared.value, window)
                n_words, n_hit, names, where = [], [], [], []
                texts = batch.column("text").to_pylist()
                before = [(None, None)] * len(texts) if first else zip(batch.column("__hits").to_pylist(), batch.column("__names").to_pylist())
                for text, (edges, found_before) in zip(texts, before):
                    words = normal_words(text)
                    hit, found = one.scan(words)
                    if edges:
                        found.update(found_before)
                        for a, b in zip(edges[::2], edges[1::2]):
                            hit[a:b] = True
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    names.append(sorted(found))
                    if not last:
                        where.append(np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist() if found else [])
                    elif spans:
                        where.append([list(x) for x in original_spans(text, hit)] if found else [])
                cols, ids = [batch.column(c) for c in kept], pa.array(names, pa.list_(pa.string()))
                if not last:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(where, pa.list_(pa.int32())), ids], names=[f.name for f in inner])
                    continue
                cols += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(where, pa.list_(pa.list_(pa.int32())))] if spans else []), names=[f.name for f in schema])

        return run

    out = docs.select(*kept)
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        out = out.mapInArrow(scanned(context.broadcast(block), uuid.uuid4().hex, k == 0, last), schema if last else inner)
    return out


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    return find(docs, items, window).filter("n_hit = 0").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dk AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT dk.doc_id, dk.i, dk.n, win.item_id FROM dk JOIN win ON dk.k = win.k AND dk.n = win.n),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
