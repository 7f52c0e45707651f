import hashlib
import random
import re

from rasterloom.llm import decontam


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= ids
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_query(spark, rows, sf_dir):
    got = [tuple(r) for r in decontam.query(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(*rows))
    assert any(r[2] for r in got)


def test_blocks_and_spans(spark):
    docs = spark.createDataFrame([(1, "Sí: Uno,dos TRES cuatro!", "n"), (2, None, "n")], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(1, "uno dos"), (2, "tres"), (None, "cuatro cinco")], "item_id long, text string")
    for block_bytes in (1, 1 << 20):
        r = decontam.find(docs, items, 2, block_bytes, spans=True).orderBy("doc_id").collect()
        assert (r[0].n_hit, r[0]["items"], r[0].hit_spans) == (3, ["1", "2"], [[4, 16]])
        assert (r[1].n_words, r[1].n_hit, r[1].hit_spans) == (0, 0, [])


def test_empty(spark, empty_dir):
    assert decontam.query(spark, empty_dir).count() == 0


def test_automaton_is_small_and_a_long_text_is_scanned(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(9000)]
    item = [rng.choice(words) for _ in range(30_000)]
    machine = decontam.Machine([("a", " ".join(item)), ("b", "two words"), ("c", None)])
    assert machine.machine.get_stats()["nodes_count"] < 21 * len(item)
    text = [rng.choice(words) for _ in range(200_000)]
    text[1000:1012], text[5000:5009], text[7000:7002] = item[50:62], item[90:99], ["two", "words"]
    hit, names = machine.scan([w.encode() for w in text])
    assert names == {"a", "b"} and sorted(hit.nonzero()[0].tolist()) == [*range(1000, 1012), 7000, 7001]
    docs = spark.createDataFrame([(None, " ".join(text)), (None, ""), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "two words")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontam.find(docs, items).collect()) == [(0, 0, 0), (0, 200_000, 14), (4, 0, 0)]
