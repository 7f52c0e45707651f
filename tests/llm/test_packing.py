import random

import pytest
from rasterloom.llm import packing


def plain_pack(sizes, lengths, price):
    """The same rules with nothing but loops."""
    bins, left = [], sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in bins if b["free"] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (b["free"], b["n"]))
        else:
            x = min((x for x in lengths if x >= sizes[i]), key=lambda x: (price(x) / min(x, left), x))
            b = {"n": len(bins), "free": x, "has": []}
            bins.append(b)
        b["free"] -= sizes[i]
        b["has"].append(i)
        left -= sizes[i]
    return [sorted(b["has"]) for b in bins]


def test_against_loops():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 40))]
        lengths = tuple(sorted(rng.sample(range(60, 200), 3)))
        bins, places, chosen = packing.pack(sizes, lengths)
        got = [sorted(i for i, b in enumerate(bins) if b == k) for k in range(len(chosen))]
        assert got == plain_pack(sizes, lengths, packing.cost)
        for k, has in enumerate(got):
            used = sum(sizes[i] for i in has)
            assert chosen[k] == min(x for x in lengths if x >= used)
            at = sorted((places[i], places[i] + sizes[i]) for i in has)
            assert at[0][0] == 0 and at[-1][1] == used and all(a[1] == b[0] for a, b in zip(at, at[1:]))


def test_last_bin_is_not_opened_too_long():
    assert packing.pack([8192, 8192, 300])[2] == [8192, 8192, 512]
    with pytest.raises(ValueError):
        packing.pack([9000])


def test_query(spark, rows, sf_dir):
    got = packing.query(spark, sf_dir).collect()
    want = {}
    for i, t in rows[0]:
        want.setdefault(i, []).append(len((t or "").encode().split()) + 1)
    for i, sizes in want.items():
        assert sum(r["size"] for r in got if r.doc_id == i) == sum(sizes)
    by = {}
    for r in got:
        by.setdefault((r.pack_group, r.bin), []).append((r.place, r.place + r["size"], r.bin_length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= parts[0][2]


def test_long_texts_are_cut(spark):
    docs = spark.createDataFrame([(1, "w " * 25), (None, None), (2, "\n\t "), (3, " a  b\x0bc ")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.piece, r["first"], r["size"]) for r in packing.packed(docs, (4, 10)).collect())
    assert got == [(0, 0, 0, 1), (1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 6), (2, 0, 0, 1), (3, 0, 0, 4)]


def test_empty(spark, empty_dir):
    assert packing.query(spark, empty_dir).count() == 0
