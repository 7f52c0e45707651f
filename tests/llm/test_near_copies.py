import random

import numpy as np
from rasterloom.llm import simhash

from .test_simhash import jaccard


def varied(seed: int, n: int) -> list[str]:
    """Texts around one, some alike at just above the threshold, most below it; and passages that many others share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(2000)]
    base, line, out = rng.choices(words, k=150), rng.choices(words, k=15), []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            own[at] = rng.choice(words)
        out.append(" ".join(own))
    return out + [" ".join(line + rng.choices(words, k=rng.randint(5, 40))) for _ in range(n)]


def test_every_link_is_found(spark):
    """Members of large groups whose candidates are below the threshold still get all their links."""
    for seed in range(2):
        texts = varied(seed, 150)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
        label = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        assert [got[i] for i in range(len(texts))] == label and 20 < len(set(label)) < len(texts)


def test_links_do_not_depend_on_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda classes, *_: classes.sparkSession.createDataFrame([], "u long, v long"))
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    docs = [(1, " ".join(base)), (2, " ".join(base[1:])), (3, " ".join(base[:12])), (4, ""), (5, None), (6, " \n"), (7, " ".join(base[:13]))]
    got = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got)] == [1, 1, 3, 4, 4, 4, 3]


def test_pairs_just_above_the_threshold(spark):
    """One pair in fourteen of such a similarity has fingerprints too far apart for a candidate."""
    rng = random.Random(6)
    docs = []
    for k in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = list(own)
        for at in rng.sample(range(10), 2):
            other[10 * at] = f"x{rng.randrange(10**6)}"
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    want = [2 * k + (jaccard(docs[2 * k][1], docs[2 * k + 1][1]) < 0.8 and c) for k in range(150) for c in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(300)] == want and sum(i != w for i, w in enumerate(want)) > 100


def test_bounds_lose_no_pair():
    """Every pair of a similarity of 0.8 shares a group in which the bounds let it through."""
    rng = np.random.default_rng(8)
    rows, sets = [], []
    for k in range(120):
        base = rng.integers(0, 2**63, rng.integers(1, 200), np.uint64) if k % 4 == 0 else base
        keep = base[rng.random(len(base)) < 0.95]
        sets.append(np.unique(np.append(keep, rng.integers(0, 2**63, rng.integers(0, 6), np.uint64))))
    for k, s in enumerate(sets):
        size = len(s) - simhash.ceil(0.8 * len(s)) + 1
        bits = np.packbits(np.bincount((s % np.uint64(simhash.SKETCH)).astype(np.int64), minlength=simhash.SKETCH) & 1).view(np.uint64)
        rows += [(int(h), len(s), pos, k, bits) for pos, h in enumerate(s[:size] if len(s) else [0])]
    rows.sort(key=lambda r: r[:2])
    h, n, pos, root = (np.array([r[c] for r in rows]) for c in range(4))
    found = {tuple(sorted((root[a], root[b]))) for i, j in simhash.fitting(h, n, pos, np.array([r[4] for r in rows]), 0.8) for a, b in zip(i, j)}
    shared = lambda a, b: len(np.intersect1d(a, b))
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if shared(sets[i], sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - shared(sets[i], sets[j]))}
    assert len(alike) > 20 and alike <= found


def test_candidates_of_a_large_group(spark):
    """Each class that has a candidate gets one, and a group of near copies does not make some hundred rows for each member."""
    import random

    import numpy as np
    from rasterloom.llm import simhash

    rng = random.Random(4)
    base = [rng.getrandbits(64), rng.getrandbits(64)]
    near = lambda n: [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base]
    fps = [near(rng.randrange(4)) for _ in range(400)] + [near(12) for _ in range(40)] + [[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(100)]
    rows = [(i, *np.array(f, np.uint64).view(np.int64).tolist()) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "id long, f0 long, f1 long")
    wide = (simhash.WIDE_BITS, ("f0", "f1"), simhash.WIDE_CUTS, "id")
    full = simhash.links(classes, *wide).collect()
    got = simhash.candidates(classes).collect()
    own = [r["u"] for r in got]
    assert len(own) == len(set(own)) and {max(r) for r in full} <= set(own)
    assert all(bin(fps[r["u"]][0] ^ fps[r["v"]][0]).count("1") + bin(fps[r["u"]][1] ^ fps[r["v"]][1]).count("1") <= simhash.WIDE_BITS for r in got)
    marked = classes.selectExpr("id", "f0", "f1", "cast(id > 0 as long) as done")
    assert len(simhash.links(marked, *wide, done="done").collect()) < 2 * len(fps) < len(full)


def test_near_copies_asks_for_no_keys_of_single_bits(spark, monkeypatch):
    """The exact search finds what only they find; they were 120 of 128 keys of each class."""
    asked, plain = [], simhash.keys_of
    monkeypatch.setattr(simhash, "keys_of", lambda *a: asked.append(a[-1]) or plain(*a))
    docs = [(k, " ".join(f"w{i}" for i in range(60) if i != k % 7)) for k in range(20)]
    got = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and asked == [True]


def test_hashes_are_equal_where_shingles_are():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "B", "b", "cc", "Ä", "x" * 70], k=n)) for n in [*range(9)] * 30] + [None, " a\t\nb ", "A b", "a"]
    got = simhash.hashes(pa.array(texts), 5)
    named = {}
    for t, h in zip(texts, got):
        want = simhash.shingles(simhash.lowered(t), 5)
        assert len(h) == len(want)
        for x, y in zip(want.tolist(), h.tolist()):
            assert named.setdefault(x, y) == y
    assert len(set(named.values())) == len(named) > 300


def test_shared_groups_are_whole_and_leave_out_what_is_alone(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    rng = np.random.default_rng(2)
    h = np.concatenate([rng.integers(-50, 50, 100), np.full(30, 3), [999]])
    cols = {"h": h, "id": rng.permutation(len(h)), "n": rng.integers(1, 9, len(h)), "pos": np.zeros(len(h), np.int64)}
    batches = pa.table(cols).to_batches(max_chunksize=10)
    tables = list(simhash.shared_groups(iter(batches)))
    rows = [tuple(r[c] for c in ("h", "n", "id")) for t in tables for r in t.to_pylist()]
    own = h.tolist()
    assert rows == sorted((a, c, b) for a, b, c in zip(own, cols["id"].tolist(), cols["n"].tolist()) if own.count(a) > 1)
    firsts = [set(t.column("h").to_pylist()) for t in tables]
    assert len(tables) > 3 and sum(map(len, firsts)) == len(set().union(*firsts))
    assert list(simhash.shared_groups(iter([]))) == []
