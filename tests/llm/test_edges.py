"""Rows without ids or texts, very long texts, repeated rows and columns that clash, for every operator at once."""

import random

import pytest
from pyspark.sql import functions as F
from rasterloom.llm import common, decontam, lm, packing, pii, search, sharding, simhash, substring, tokencount, toxicity

CLASH = ("score", "predicted", "n_passages", "n_tokens", "n_words", "n_hit", "items", "spans", "base", "kept", "block", "shard", "slot", "size", "term", "order", "fp", "tkey", "did", "marks", "root", "held", "bin")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    texts = [None, "", " \n\t", "one", "w" * 1_200_000, long, long + " tail", "the same text", "the same text", "call +1 212 555 0100 or a.b@c.example.org", "ends here"]
    return [(None if k in (0, 3, 9) else k, t) for k, t in enumerate(texts)] + [(7, "the same text"), (None, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return common.written(table.withColumns({c: F.lit("extra") for c in CLASH}))


def sizes(rows):
    return sorted(len((t or "").encode().split()) for _, t in rows)


def test_counts_and_packs(docs, rows):
    pieces = tokencount.vocabulary()
    got = tokencount.counted(docs, pieces).collect()
    counter = tokencount.PieceCounter(pieces)
    assert sorted(r.n_tokens for r in got) == sorted(counter.text(t or "") for _, t in rows) and all(r.score == "extra" for r in got)
    packed = packing.packed(docs).collect()
    assert sum(r.size for r in packed) == sum(sizes(rows)) + len(rows)
    by_bin = {}
    for r in packed:
        by_bin.setdefault((r.pack_group, r.bin), []).append(r)
    assert all(sum(r.size for r in b) <= b[0].bin_length for b in by_bin.values())


def test_substring_and_decontamination(spark, docs, rows):
    got = substring.remove_repeats(docs, digest=True).collect()
    assert sorted(r.n_words for r in got) == sizes(rows) and sorted(r.n_removed for r in got)[-3:] == [0, 150_000, 150_000]
    assert all(r.did == r.marks == r.root == "extra" for r in got)
    items = spark.createDataFrame([(1, "the same text"), (None, "")], "item_id long, text string").withColumn("n_hit", F.lit(5))
    found = decontam.find(docs, items, spans=True).collect()
    assert sorted(r.n_hit for r in found)[-4:] == [0, 3, 3, 3] and all(r.kept == "extra" for r in found)
    assert decontam.clean(docs, items).columns == docs.columns and decontam.clean(docs, items).count() == len(rows) - 3


def test_personal_data_and_toxicity(docs, rows):
    model = pii.train([], made=200, steps=40)
    got = pii.find(docs, model, redact=True).collect()
    assert len(got) == len(rows) and sorted(len(r.base) for r in got)[-2:] == [0, 2] and all(r.score == "extra" for r in got)
    judged = toxicity.judged(docs, toxicity.fit(["bad words here now", "good words here now"] * 40, [1, 0] * 40, 0.5)).collect()
    assert len(judged) == len(rows) and all(0 <= r.score <= 1 and r.bin == "extra" for r in judged)


def test_copies(docs, rows):
    for grouped, n in ((simhash.near_duplicates(docs), None), (simhash.near_copies(docs), 7)):
        found = grouped.collect()
        assert len(found) == len(rows)
        kept = simhash.deduplicated(docs, grouped)
        assert kept.columns == docs.columns and n in (None, kept.count())  # two groups have no id at all
        texts = {r.text for r in kept.collect()}
        assert len([t for t in texts if t and t.startswith(rows[5][1][:100])]) == 1 and "the same text" in texts


def test_scores_and_search(docs, rows):
    got = lm.scores(docs, F.col("doc_id") == 6).collect()
    assert sorted(r.n_tokens for r in got) == [n + 1 for n in sizes(rows)]
    hits = search.search(docs, docs.filter("doc_id >= 4")).collect()
    assert {r.query_id: r.doc_id for r in hits if r["rank"] == 1}[10] == 10 and {r.query_id for r in hits} == {4, 5, 6, 7, 8, 10}


def test_sharding(spark, docs, rows, tmp_path):
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    named = docs.select("doc_id", "text", "term", "order").withColumns({"size": size, "old": (F.abs(F.xxhash64("text")) % 3).cast("int"), "row": F.monotonically_increasing_id()})
    named = common.written(named)
    placed = common.written(sharding.reshard(named.select("doc_id", "size", "old", "row", "term"), 3, 4))
    assert placed.count() == len(rows)
    sharding.rewrite("", placed, named.select("row", "doc_id", "text", "order", "old"), ["row"], f"file://{tmp_path}/out", unique=True)
    written = spark.read.parquet(f"file://{tmp_path}/out")
    stay = placed.join(written.select("shard").distinct(), "shard", "left_anti").count()
    assert written.count() + stay == len(rows)
    slots = {}
    for r in placed.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
