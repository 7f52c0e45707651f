import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.llm import common, lm

from .test_substring import twins


def brute(docs):
    """The contract's columns and the model's score: all counts in dictionaries, the weights from a histogram of single tokens."""
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [None]) for i, t in docs]
    pairs = lambda ws: zip([None, *ws[:-1]], ws)
    c = Counter(w for _, held, ws in tokens if not held for w in ws)
    c2 = Counter(p for _, held, ws in tokens if not held for p in pairs(ws))
    n, v = sum(c.values()), len(c)
    level = lambda x: x.bit_length()
    step = lambda p: int(lm.ratio(np.array([p]))[0])
    hist = Counter()
    for _, held, ws in tokens:
        for a, w in pairs(ws) if not held else ():
            pair = (c2[a, w] - 1) * (v + 1) / (c[a] - 1) if c[a] > 1 else 0.0
            hist[(level(c[a] - 1) * lm.RATIOS + step(pair)) * lm.RATIOS + step((c[w] - 1) * (v + 1) / (n - 1))] += 1
    weight = lm.weights(hist)
    for i, held, ws in tokens:
        score = 0.0
        for a, w in pairs(ws):
            lam = weight[level(c[a])]
            score += math.log10((lam[0] * c2[a, w] / c[a] if c[a] else 0) + lam[1] * c[w] / n + lam[2] / (v + 1))
        yield i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), score


@pytest.mark.parametrize("fan", [256, 2])
def test_query(spark, rows, sf_dir, monkeypatch, fan):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)
    monkeypatch.setattr(lm, "FAN", fan)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    if fan == 2:
        assert len(lm.levels(9)) == 4 and lm.levels(9)[0] <= 2
    got = lm.scores(docs, F.pmod(common.id_crc(F.col("doc_id")), F.lit(7)) == 2).collect()
    got, want = sorted(tuple(r) for r in got), sorted(brute(rows[0]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_merged_asks_are_no_larger_than_one_block():
    """FAN blocks' tokens over a level's buckets, FAN of those merged over the next's, are at most a block's; only the last level may be finer."""
    for n in (1, lm.FAN, lm.FAN + 1, lm.FAN + 27, 6 * lm.FAN + 1, lm.FAN**2 + 1):
        out = lm.levels(n)
        assert out[-1] >= n and all(b % a == 0 and b <= a * lm.FAN for a, b in zip(out, out[1:]))
        assert all(a >= lm.FAN ** (k + 1) for k, a in enumerate(out[:-1]))


def test_tables_of_levels_go(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)
    monkeypatch.setattr(lm, "FAN", 2)
    folder = Path(common.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    lm.query(spark, sf_dir)
    assert len(set(folder.iterdir()) - before) == 1  # the counted blocks, which the result reads


def test_words_with_equal_polynomial_hashes(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a), (2, b), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in lm.scores(docs, F.col("doc_id") == 2).collect()}
    assert got == {1: (2, 2), 2: (2, 1), 3: (2, 2)}


def test_seen_pairs_are_likelier(spark):
    docs = spark.createDataFrame([(1, "a b a c a b"), (2, "b a"), (3, "")], "doc_id long, text string")
    ask = [(10 + k, f"a {w}".strip()) for k, w in enumerate(["a", "b", "c", "zzz"])] + [(20, "a")]
    got = {r.doc_id: r.score for r in lm.scores(docs.unionAll(spark.createDataFrame(ask, docs.schema)), F.col("doc_id") >= 10).collect()}
    first = {}  # "a x end" and "a end" share the first factor
    for k, w in enumerate(["a", "b", "c", "zzz"]):
        first[w] = 10 ** got[10 + k]
    assert all(0 < p < 1 for p in first.values())
    assert first["b"] > first["zzz"] and first["b"] > first["c"]


def test_weights_recover_a_mixture():
    rng = np.random.default_rng(1)
    # half of the draws look like the token estimate, half like the uniform one
    hist = Counter()
    one = int(lm.ratio(np.array([8.0]))[0])
    for x in rng.random(20000):
        hist[(3 * lm.RATIOS) * lm.RATIOS + (one if x < 0.5 * 8 / 9 + 0.5 * 1 / 9 else 0)] += 1
    w = lm.weights(hist)[3]
    assert abs(w.sum() - 1) < 1e-9 and w[0] == 0 and w[1] > 0.3


def test_empty(spark, empty_dir):
    assert lm.query(spark, empty_dir).count() == 0


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, "a"), (None, None)], "doc_id long, text string")
    got = lm.scores(docs, F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in got) == [(0, 1, 6), (0, 3, 6), (2**60 + 1, 2, 6)]
