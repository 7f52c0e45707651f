import hashlib
from collections import Counter

from rasterloom.llm import substring


def brute(docs, window=35):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for (i, _), w in zip(docs, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone |= set(range(a, a + window))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_query(spark, rows, sf_dir):
    assert sorted(tuple(r) for r in substring.query(spark, sf_dir).collect()) == sorted(brute(rows[0]))


def test_small_windows_and_periods(spark):
    docs = [(1, "a b " * 30), (2, "a a a a a a a a a a a"), (3, "p q r s t u v w x y z"), (4, "1 q r s t u v 2 3"), (5, "u v w x y z"), (6, None)]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in substring.remove_repeats(table, 5, 3).collect()}
    for i, n, gone, digest in brute(docs, 5):
        assert (got[i].n_words, got[i].n_removed, hashlib.sha256(got[i].kept.encode()).hexdigest()) == (n, gone, digest)
    assert got[4].spans == [[1, 7]]


def test_empty(spark, empty_dir):
    assert substring.query(spark, empty_dir).count() == 0


def twins():
    """Two long words with equal polynomial hashes modulo 2**64, whatever the base: the Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_differ_are_kept(spark):
    a, b = twins()
    rest = " ".join(f"w{i}" for i in range(34))
    docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, None)]
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 0)]


def test_rows_without_an_id_and_clashing_names(spark):
    said = " ".join(f"p{i}" for i in range(50))
    docs = [(None, f"x{i} y{i} z{i}", i) for i in range(3000)] + [(None, f"{said} tail", -1), (None, f"head {said}", -2), (7, said, -3), (7, "7" + said, -4)]
    table = spark.createDataFrame(docs, "doc_id long, text string, did long").selectExpr("*", "did AS tkey", "did AS marks", "did AS spans")
    got = {r.did: r for r in substring.remove_repeats(table).collect()}
    want = {d: n for (_, _, d), (_, _, n, _) in zip(docs, brute([x[:2] for x in docs]))}
    assert len(got) == len(docs) and {d: r.n_removed for d, r in got.items()} == want
    assert got[-2].spans == [[1, 51]] and got[-2].tkey == got[-2].marks == -2


def test_a_very_long_text(spark):
    words = [f"v{i % 50021}" for i in range(400_000)]
    docs = [(1, " ".join(words)), (2, "a  \n b"), (3, "q" * 3_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()}
    assert got == {1: (400_000, 400_000), 2: (2, 0), 3: (1, 0)}
