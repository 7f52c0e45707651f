import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from rasterloom.llm import pii
from rasterloom.llm.tagger import KINDS, Tagger

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(NAIVE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_like_the_naive_ones():
    rng = random.Random(6)
    parts = ["a.b@c.d", "@", "x@y", "a@b.c@d.e", "+1 (212) 555-0100", "+", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.04", "4111 1111 1111 1111", "4111111111111111", "5 5", " ", "-", ".", "é", "12", "\n", "%_", "(", "00000000000000", "..", "a-b.c-d"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        assert pii.patterns(text) == naive(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 100_000, "1 " * 100_000, "a." * 100_000 + "@b"):
        pii.patterns(text)


def test_gradients():
    m, rng = Tagger(hidden=3, width=2), np.random.default_rng(0)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x, y = rng.integers(0, 20, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 0], [0] * 7, [1, 2, 2, 2, 0, 0, 5]])
    _, g = m.gradients(x, y)
    for k, at in (("emb", (int(x[0, 3]), 1)), ("win", (0, 1, 5)), ("rec", (1, 2, 9)), ("bias", (1, 0, 0, 4)), ("out", (2, 1)), ("shift", (5,)), ("move", (0, 1))):
        old, ends = m.p[k][at], []
        for d in (1e-4, -1e-4):
            m.p[k][at] = old + d
            ends.append(m.gradients(x, y)[0])
        m.p[k][at] = old
        assert abs((ends[0] - ends[1]) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_best_path_by_trying_all():
    m, rng = Tagger(), np.random.default_rng(1)
    m.p["move"] = rng.standard_normal(m.p["move"].shape).astype(np.float32)
    e = rng.standard_normal((4, 4, 9)).astype(np.float32)
    move = m.p["move"] + m.fence
    for row, path in zip(e, m.paths(e)):
        score = lambda t: row[np.arange(4), list(t)].sum() + m.fence[0, t[0]] + sum(move[a, b] for a, b in zip(t, t[1:]))  # noqa: B023, E731
        assert tuple(path) == max(np.ndindex(9, 9, 9, 9), key=score)


def test_reconciled_is_the_heaviest_set():
    rng = random.Random(8)
    for _ in range(100):
        base = [(20, 0, 25)] if rng.random() < 0.5 else []
        found = {(a, rng.randrange(4), a + rng.randint(1, 8)): rng.random() for a in (rng.randrange(30) for _ in range(7))}
        got = pii.reconciled(base, found)
        assert set(base) <= set(got)
        free = lambda s: all(x[2] <= y[0] or y[2] <= x[0] for x, y in combinations(s, 2))
        best = max(sum(found[x] for x in s) for n in range(8) for s in combinations(found, n) if free([*s, *base]))
        assert free(got) and abs(sum(found[x] for x in got if x not in base) - best) < 1e-9


@pytest.fixture(scope="module")
def model():
    return pii.train([], made=600, steps=300)


def test_held_out_lines(model):
    lines = pii.made_up(300, seed=99)
    got = pii.added([t for t, _ in lines], [[] for _ in lines], model)
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, lines))
    assert right >= 0.8 * sum(len(s) for _, s in lines)
    assert right >= 0.85 * sum(map(len, got))


def test_find_and_mask(spark, rows, model):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows[0]], "doc_id long, text string, spans string")
    got = pii.find(docs, model, redact=True).collect()
    texts = {}
    for i, t in rows[0]:
        texts.setdefault(i, []).append(t)
    for r in got:
        assert r.base in [[f"{KINDS[k]}:{a}:{b}" for a, k, b in naive(t)] for t in texts[r.doc_id]]
        assert set(r.base) <= set(r.spans)
        assert (r.text is None) == (texts[r.doc_id] == [None])
    assert any("[EMAIL]" in (r.text or "") for r in got) and not any("a.b@c-d" in (r.text or "") for r in got)


def test_query(spark, rows, sf_dir):
    want = sorted((i, *(sum(s[1] == k for s in naive(t)) for k in range(4)), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in naive(t)).encode()).hexdigest()) for i, t in rows[0])
    assert sorted(tuple(r)[:6] for r in pii.query(spark, sf_dir).collect()) == want


def test_empty(spark, empty_dir, model, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda texts: model)
    assert pii.query(spark, empty_dir).count() == 0


def test_a_long_text_does_not_end_the_sample(spark):
    for long in range(3):
        texts = ["w" * (500 if i == long else 10) + str(i) for i in range(6)]
        docs = spark.createDataFrame([(t,) for t in texts], "text string")
        assert sorted(pii.sample(docs, 10, 100)) == sorted(t for i, t in enumerate(texts) if i != long)
