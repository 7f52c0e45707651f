import random

import numpy as np
import xxhash
from rasterloom.llm import simhash


def brute_fp(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=4):
    label = list(range(len(fps)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


def test_query(spark, rows, sf_dir):
    docs = rows[0]
    fps = [brute_fp(t) for _, t in docs]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, brute_components([i for i, _ in docs], fps)))
    assert sorted(tuple(r) for r in simhash.query(spark, sf_dir).collect()) == want


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps):
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 7)):
                g ^= 1 << b
            fps.add(g)
    fps |= {(1 << 63) ^ sum(1 << b for b in rng.sample(range(0, 24), rng.randint(0, 4))) for _ in range(300)}  # one large group
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {(r.u % 2**64, r.v % 2**64) for r in simhash.links(table).collect()}
    assert all((u ^ v).bit_count() <= 4 for u, v in found)
    label = {f: f for f in fps}
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for u, v in found:
        a, b = sorted((find(u), find(v)))
        label[b] = a
    want = brute_components(fps, fps)
    assert [find(f) for f in fps] == want


def test_empty(spark, empty_dir):
    assert simhash.query(spark, empty_dir).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other words than these are here"), (4, None), (5, ""), (None, "a row without an id stays"), (None, "and so does this one here"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in simhash.deduplicated(docs, simhash.near_duplicates(docs)).collect()) == [(0, "a row without an id stays"), (0, "and so does this one here"), (1, "a b c d e f"), (3, "other words than these are here"), (4, "")]


def jaccard(a, b):
    def runs(t):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").split()]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_by_similarity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    docs, i = [(None, "a row without an id"), (1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two  words"), (5, "two  words")], 10
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for _ in range(1 if k % 3 else 6):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 60))):
                own[at] = rng.choice(words)
            docs.append((i, " ".join(own)))
            i += 1
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(150):  # one large group, more than a key's group is listed for
        own = list(base)
        own[rng.randrange(200)] = rng.choice(words)
        docs.append((i, " ".join(own)))
        i += 1
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    got = {(r.doc_id, r.tkey): r for r in simhash.near_copies(table).collect()}
    label = {d[0]: d[0] for d in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    strong = 0
    component = {d: r.component_id for (d, _), r in got.items()}
    pairs = [(a, b, jaccard(s, t)) for k, (a, s) in enumerate(docs) for b, t in docs[:k] if a != b and a is not None and b is not None]
    for a, b, j in pairs:
        if j >= 0.8:
            x, y = sorted((find(a), find(b)))
            label[y] = x
            strong += 1
    wrong = [d for d in component if d is not None and component[d] != min(x for x in label if x is not None and find(x) == find(d))]
    assert strong > 5000 and len(wrong) <= 2
    assert component[None] is None and component[3] == 1 and component[5] == 4
    kept = simhash.deduplicated(table, simhash.near_copies(table)).collect()
    assert len(kept) == len(set(component.values())) and all(r.kept == "x" for r in kept)


def test_large_groups_stay_connected(monkeypatch):
    """Groups split by pieces of the other bits and forests connect what all links connect."""
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**43, 40, np.uint64) << np.uint64(21)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(30):
            fps.add(s ^ sum(1 << int(b) for b in set(rng.integers(21, 64, rng.integers(1, 4)).tolist())))
    fps = np.array(sorted(fps), np.uint64)[:, None]
    keys = np.zeros(len(fps), np.int32)
    for group in (8, 10**6):
        u, v = simhash.edges_of(keys, fps, 4, group=group)
        assert all(int(a ^ b).bit_count() <= 4 for a, b in zip(fps[u, 0].tolist(), fps[v, 0].tolist()))
        label = list(range(len(fps)))
        def find(x):
            while label[x] != x:
                x = label[x]
            return x
        for a, b in zip(u.tolist(), v.tolist()):
            a, b = sorted((find(a), find(b)))
            label[b] = a
        roots = [find(x) for x in range(len(fps))]
        if group == 8:
            few = roots
    assert few == roots and len(set(roots)) > 5
