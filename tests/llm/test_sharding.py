import itertools
import zlib

from rasterloom.llm import common, sharding


def test_flow_is_cheapest():
    for old, cap in (([5, 0, 9], [4, 4, 3, 3]), ([2, 2], [1, 3]), ([0, 7], [7])):
        plan = sharding.transfers(old, cap)
        assert [sum(x for (i, _), x in plan.items() if i == k) for k in range(len(old))] == old
        assert [sum(x for (_, j), x in plan.items() if j == k) for k in range(len(cap))] == cap
        assert sum(x for (i, j), x in plan.items() if i != j) == sum(max(0, s - (cap[i] if i < len(cap) else 0)) for i, s in enumerate(old))


def test_flow_prices_against_all_plans():
    price = [[1, 3], [2, 1]]
    plan = sharding.min_cost_flow([2, 3], [3, 2], lambda i, j: price[i][j])
    every = [(a, 2 - a, 3 - a, a) for a in range(3)]  # from 0 to 0, 0 to 1, 1 to 0, 1 to 1
    assert sum(price[i][j] * x for (i, j), x in plan.items()) == min(sum(p * x for p, x in zip(itertools.chain(*price), e)) for e in every)


def test_query(spark, rows, sf_dir):
    got = sharding.query(spark, sf_dir).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows[0])
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got)
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    old = [sum(r["size"] for r in got if r.old_shard == k) for k in range(12)]
    fewest = sum(max(0, s - c) for s, c in zip(old, sharding.even(sum(old), 16)))
    assert sum(r["size"] for r in got if r.shard != r.old_shard) <= fewest + 16 * max(r["size"] for r in got)


def test_empty(spark, empty_dir):
    assert sharding.query(spark, empty_dir).count() == 0


def test_rewrite_leaves_untouched_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9, 0 if i < 30 else 1 if i < 40 else 2) for i in range(50)], "doc_id long, text string, old int")
    placed = common.written(sharding.reshard(docs.selectExpr("old", "doc_id", "cast(10 as long) as size"), 3, 3))
    sharding.rewrite("", placed, docs, ["doc_id", "old"], str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.shard) for r in out} <= {(r.doc_id, r["shard"]) for r in placed.collect()}
    assert {r.doc_id for r in placed.collect() if r.old != r["shard"]} <= {r.doc_id for r in out}


def test_rewrite_keeps_null_and_repeated_rows(spark, tmp_path):
    """Every row of a written shard is in its file once; the old file of an untouched shard is not read."""
    ids = [(None if i % 5 == 0 else i % 7, "x" * 9, 0 if i < 30 else 1 if i < 40 else 2) for i in range(60)]
    docs = spark.createDataFrame([*ids, *[(i, "y" * 9, 3) for i in range(15)]], "doc_id long, text string, shard int")
    old, out = tmp_path / "old", tmp_path / "out"
    docs.write.partitionBy("shard").parquet(str(old))
    placed = common.written(sharding.reshard(docs.selectExpr("shard as old", "doc_id", "cast(10 as long) as size"), 4, 4)).collect()
    # shard 3 stays as it is; the others are dealt anew
    placed = [r.asDict() | {"shard": 3 if r.old == 3 else (r.old + 1) % 3} for r in placed]
    for k in range(4):
        for slot, r in enumerate(r for r in placed if r["shard"] == k):
            r["slot"] = slot
    for f in (old / "shard=3").glob("*.parquet"):
        f.write_bytes(b"not to be read")
    table = spark.createDataFrame([(r["old"], r["doc_id"], r["size"], r["shard"], r["slot"]) for r in placed], "old int, doc_id long, size long, shard int, slot long")
    sharding.rewrite(str(old), table, None, ["doc_id", "old"], str(out))
    got = spark.read.parquet(str(out)).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.old, r["shard"], r.slot) for r in got) == order((r["doc_id"], r["old"], r["shard"], r["slot"]) for r in placed if r["shard"] < 3)


def test_query_writes_the_shards_that_change(spark, sf_dir, tmp_path, monkeypatch):
    """The rows come from the written files, texts and all."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = sharding.query(spark, sf_dir).collect()
    (path,) = {str(d.parent) for d in tmp_path.glob("*/shard=*")}
    files = spark.read.parquet(path).collect()
    assert sorted((str(r.doc_id), r.text_crc32, r["shard"], r.slot) for r in files) == sorted((str(r.doc_id), r.text_crc32, r["shard"], r.slot) for r in rows)
    assert all(zlib.crc32((r.text or "").encode()) == r.text_crc32 for r in files)
