from rasterloom.streaming import receiver

KINDS = ["header", "object", "checkpoint", "interval", "interval", "interval", "integrity"]


def packets():
    rows = [(1, k, k, kind, k - 2 if kind == "interval" else None) for k, kind in enumerate(KINDS)]
    # stream 2 loses packet 4, gets 5 too early, then 4 again, then 5
    rows += [(2, n, k, KINDS[k], k - 2 if KINDS[k] == "interval" else None) for n, k in enumerate([0, 1, 2, 3, 5, 4, 5, 3])]
    rows += [(3, 0, 1, "object", None), (4, 0, 0, "header", None), (4, 1, 1, "interval", 1), (5, 0, 0, "header", None), (5, 1, 1, "checkpoint", None), (5, 2, 2, "object", None)]
    return rows + [(6, n, k, KINDS[k], k - 2 if KINDS[k] == "interval" else None) for n, k in enumerate([0, 1, 2, 3, 4])] + [(6, 9, -1, "reset", None), (6, 10, 3, "interval", 1)]


WANT = {
    (2, 4): "gap", (2, 5): "applied", (2, 6): "applied", (2, 7): "repeated", (3, 0): "gap", (4, 1): "interval before checkpoint", (5, 2): "declaration after checkpoint", (6, 5): "applied", (6, 6): "applied",
}
SCHEMA = "stream_id long, arrival long, seq long, kind string, t long"


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.stream_id, []).append(r)
    assert [r.status for r in by[1]] == ["applied"] * 7 and by[1][-1].playable == 4
    for (s, n), status in WANT.items():
        assert by[s][n].status == status, (s, n, by[s][n])
    assert by[6][-1].playable == 2


def test_batch(spark):
    check(receiver.received_batch(spark.createDataFrame(packets(), SCHEMA)).collect())


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = packets()
    for n in range(2):  # the first packets come in one file, the others in the next
        own = [r for r in rows if (r[1] < 3) == (n == 0)]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run = receiver.received(stream).writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.sql("SELECT * FROM got").collect()
    want = receiver.received_batch(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
