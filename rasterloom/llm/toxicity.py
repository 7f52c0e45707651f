"""Toxic passages by maximum-scoring segments.

Every token has a log-odds score (toxic against clean documents, Dirichlet prior from both together); a linear scan finds all
maximal scoring segments of a text; extreme-value statistics say how often a segment so good turns up in a clean text of that
length. The expected number (E-value) of the best segment and the sum over significant ones give the document's score.

Tokens are lower-cased words; a word that was not learned backs off to its first five, then four letters, so that open word
families count. Learning uses a bounded sample of labelled rows (SAMPLE_ROWS and SAMPLE_BYTES of each label, in hash order),
near copies once. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts score as texts without any scored token; without labels of both kinds every score is the
share of toxic labels; a doc_id with several labels is toxic if one says so; null labels are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the sample for each label.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 12 << 20
#: Prior strength as a share of the sample; least |z| and log-odds of a token that is kept; score of all other tokens.
PRIOR, LEAST_Z, LEAST_ODDS, DRIFT = 1 / 18, 3.0, 1.0, -0.02
#: Largest E-value of a significant passage.
SIGNIFICANT = 0.01
WORD = re.compile(r"[^\W_]+")
BACKOFF = (5, 4)


def tokens(word: str) -> list[str]:
    """A word and what it backs off to; a mark keeps a start of a word apart from a whole word."""
    return [word, *(word[:n] + "*" for n in BACKOFF if len(word) >= n)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda of the extreme-value law
    room: float = 1.0  # its K
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def word_scores(self, text: str) -> list[float]:
        get = self.scores.get
        return [get(w) or get(w[:5] + "*") or get(w[:4] + "*") or DRIFT for w in WORD.findall(text.lower())]

    def e_value(self, score: float, n: int) -> float:
        return self.room * max(1, n) * math.exp(-min(700.0, self.decay * score))

    def judge(self, text: str) -> tuple[tuple[float, float], list[tuple[int, int, float]]]:
        """Evidence of the text, and its significant segments (first word, end, score)."""
        s = self.word_scores(text)
        found = segments(s) if s and max(s) > 0 else []
        n = len(s)
        best = max((x[2] for x in found), default=0.0)
        strong = [x for x in found if self.e_value(x[2], n) <= SIGNIFICANT]
        total = sum(self.decay * x[2] for x in strong)
        return (math.asinh(-math.log(self.e_value(best, n))), math.log1p(total)), strong

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * evidence[0] + self.weights[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def segments(s: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [first, end) in linear time: none can be made better, none overlaps a better one."""
    kept: list[list] = []  # first, end, sum before, sum after, nearest earlier one that begins lower
    total = 0.0
    for i, x in enumerate(s):
        if x <= 0:
            total += x
            continue
        first, before, total = i, total, total + x
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append([first, i + 1, before, total, j])
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def log_odds(toxic: Counter, clean: Counter) -> dict[str, float]:
    """Log-odds of tokens, counted once a document, with a Dirichlet prior of their share in both; significant ones only.

    Shares are of all counts of a label, so that longer documents of one label don't lean every common word to it.
    """
    n_toxic, n_clean, out = toxic.total(), clean.total(), {}
    n = n_toxic + n_clean
    strength = max(1.0, PRIOR * n)
    for w in toxic.keys() | clean.keys():
        t, c = toxic[w], clean[w]
        prior = strength * (t + c) / n
        d = math.log((t + prior) / (n_toxic + strength - t - prior + 1)) - math.log((c + prior) / (n_clean + strength - c - prior + 1))
        if abs(d) >= max(LEAST_ODDS, LEAST_Z * math.sqrt(1 / (t + prior) + 1 / (c + prior))):
            out[w] = d
    return out


def near_copy_keys(words: list[str]) -> list[int]:
    """Four smallest hashes of five-word shingles: a near copy shares one of them."""
    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    h = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
    return [int(common.mixed(h ^ np.uint64(k)).min()) * 4 + k for k in range(4)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """By Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], share: float) -> Model:
    """From labelled texts; share is that of toxic labels in all."""
    base = min(1 - 1e-4, max(1e-4, share))
    model = Model(weights=(math.log(base / (1 - base)), 0.0, 0.0))
    seen: set[int] = set()
    counts, labels, kept = (Counter(), Counter()), [], []
    for text, label in zip(texts, toxic):
        w = WORD.findall((text or "").lower())
        if w and not seen.intersection(keys := near_copy_keys(w)):
            seen.update(keys)
            counts[label].update({t for x in set(w) for t in tokens(x)})  # a text's words are not kept
            labels.append(label)
            kept.append(text)
    n_toxic = sum(labels)
    if not n_toxic or n_toxic == len(labels):
        return model
    model.scores = log_odds(counts[1], counts[0])
    # the extreme-value law of clean texts
    clean: Counter = Counter()
    for text, label in zip(kept, labels):
        if not label:
            clean.update(model.word_scores(text))
    for s in set(model.scores.values()):
        if s > 0:
            clean[s] += 0.1  # a token not seen in clean texts may still be there
    value, times = np.array(list(clean)), np.array(list(clean.values()), float)
    times /= times.sum()
    if (value > 0).any() and (times * value).sum() < 0:
        lo, hi = 0.0, 1.0
        while (times * np.exp(np.minimum(hi * value, 700))).sum() < 1 and hi < 64:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (times * np.exp(np.minimum(mid * value, 700))).sum() < 1 else (lo, mid)
        model.decay = hi
    sums = 0.0
    for text, label in zip(kept, labels):
        if not label:
            s = model.word_scores(text)
            sums += len(s) * math.exp(-model.decay * max((x[2] for x in segments(s)), default=0.0))
    model.room = (len(labels) - n_toxic) / max(sums, 1e-9)
    # evidence to probability, at the share that labels have outside the sample
    x = np.array([model.judge(t)[0] for t in kept])
    y = np.array(labels, float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = tuple(logistic(x, y, weight))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """From at most `rows` rows and `size` bytes of text of each label; labels (doc_id, toxic) must hold training rows only."""
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = common.written(labels.withColumn("order", F.xxhash64("doc_id")))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], 0.0)
    picked = None
    for label in (0, 1):
        some = labels.filter(F.col("toxic") == label).orderBy("order", "doc_id").limit(rows)
        picked = some if picked is None else picked.unionAll(some)
    picked = F.broadcast(common.written(picked.withColumnRenamed("doc_id", "id")))  # at most 2 * rows numbers
    found = docs.join(picked, docs.doc_id == F.col("id")).select("toxic", "order", "text", F.octet_length("text").alias("bytes"))
    found = common.written(found.filter("bytes > 0"))
    texts, marks = [], []
    for label in (0, 1):
        own = found.filter(F.col("toxic") == label)
        sizes = own.select("order", "bytes").orderBy("order", "bytes").limit(2 * rows).collect()
        left, picks = size, []
        for r in sizes:  # a row that doesn't fit the bytes left is passed over
            if r["bytes"] <= left:
                left -= r["bytes"]
                picks.append((r["order"], r["bytes"]))
        if picks:
            order, sizes = zip(*sorted(set(picks)))
            taken = common.local(docs.sparkSession, order=(order, pa.int64()), bytes=(sizes, pa.int32()))
            got = [r["text"] for r in own.join(F.broadcast(taken), ["order", "bytes"], "left_semi").orderBy("order", "text").limit(len(picks)).collect()]
            texts += got
            marks += [label] * len(got)
    return fit(texts, marks, counts.get(1, 0) / sum(counts.values()))


def judged(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """docs with score, predicted, n_passages, and with passages=True the passages as [start, end) in code points."""
    kept = [c for c in docs.columns if c not in ("score", "predicted", "n_passages", "passages")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer").add("n_passages", "integer")
    if passages:
        schema = schema.add("passages", T.ArrayType(T.ArrayType(T.IntegerType())))

    def run(batches):
        for batch in common.sliced(batches):
            score, number, where = [], [], []
            for text in batch.column("text").to_pylist():
                evidence, strong = model.judge(text or "")
                score.append(model.score(evidence))
                number.append(len(strong))
                if passages:
                    spans = [m.span() for m in WORD.finditer((text or "").lower())] if strong else []
                    where.append([[spans[a][0], spans[b - 1][1]] for a, b, _ in strong])
            cols = [batch.column(c) for c in kept] + [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(where, pa.list_(pa.list_(pa.int32())))] if passages else []), names=[f.name for f in schema])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(common.id_crc(doc_id), F.lit(5)) == 0


def trained(spark: SparkSession, sf_dir: str) -> Model:
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    return train(common.table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, trained(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")
