import pyarrow as pa
from rasterloom.llm import common, pii, toxicity


def test_batches_of_text_are_bounded(spark, tmp_path):
    """Long rows go to Python workers a few at a time, in what is written as in what a query returns."""
    spark.range(3000).selectExpr("id AS doc_id", "repeat('some text ', 1000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.table(spark, str(tmp_path), "documents")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])

    for found in (docs.mapInArrow(run, "rows long, size long"), common.written(docs.mapInArrow(run, "rows long, size long"))):
        rows, most = found.selectExpr("sum(rows)", "max(size)").first()
        assert rows == 3000 and most < 2 * common.BATCH


def test_a_size_that_the_session_names_stays(spark):
    before = spark.conf.get(common.BATCH_BYTES, None)
    try:
        spark.conf.set(common.BATCH_BYTES, "123456")
        assert common.bounded(spark).conf.get(common.BATCH_BYTES) == "123456"
    finally:
        spark.conf.unset(common.BATCH_BYTES) if before is None else spark.conf.set(common.BATCH_BYTES, before)


def test_learning_starts_no_other_workers(spark, sf_dir, monkeypatch):
    """Rows that the driver has go out by Arrow, not through an RDD of Python rows."""
    docs, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))

    def none(*_, **__):
        raise AssertionError("an RDD of Python rows")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", none)
    assert toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).weights[1]
    assert pii.sample(docs.select("text"))
