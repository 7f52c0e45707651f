import random

import pytest
from rasterloom.llm import toxicity


def brute_segments(s):
    """Best segment first (the shortest of equals), then on both sides of it."""
    def go(a, b):
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return go(a, i) + [(i, j, best[0])] + go(j, b)
    return go(0, len(s))


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-5.1, -3.3, -2.2, -1.7, -0.9, 1.3, 2.6, 4.19]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in brute_segments(s)]


def documents(n=900):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(10, 90))]
        toxic = int(rng.random() < 0.15)
        for _ in range(toxic * rng.randint(3, 9)):
            w.insert(rng.randrange(5, len(w)), rng.choice(["grobian", "Schuft!", "vequ" + rng.choice(words)]))
        out.append((i, " ".join(w), toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("toxic")
    rows = documents()
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5000, ""), (5001, None), (5002, "grobian " * 20000), (7, rows[7][1])], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, x) for i, _, x in rows] + [(3, 0), (4, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_held_out_documents_are_told_apart(spark, tables):
    d, rows = tables
    got = toxicity.query(spark, d).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    held = [(by[i], x) for i, _, x in rows if by[i].held_out]
    assert len(held) > 100 and sum(r.predicted == x for r, x in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[5000].score == by[5001].score < 0.5 <= by[5002].score


def test_passages_are_where_the_words_are(spark, tables):
    d, rows = tables
    model = toxicity.trained(spark, d)
    text = "abc " * 30 + "Schuft grobian Schuft! grobian" + " abc" * 30
    got = toxicity.judged(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, score string"), model, passages=True).first()
    (a, b), = got.passages
    assert text[a:b] == "Schuft grobian Schuft! grobian"


def test_empty(spark, empty_dir):
    assert toxicity.query(spark, empty_dir).count() == 0


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    """Wherever the long text stands in hash order, the other rows of its label are learned from."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks, rate: seen.update(texts=texts, marks=marks))
    for long in range(3):
        docs = spark.createDataFrame([(i, "w" * (500 if i == long else 10) + str(i)) for i in range(6)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "doc_id long, toxic int")
        toxicity.train(docs, labels, 10, 100)
        assert sorted(seen["texts"]) == [f"{'w' * 10}{i}" for i in range(6) if i != long] and sum(seen["marks"]) == 2
