import corpus_pipeline
import pytest
from rasterloom.llm import common, pii

from .test_decontam import brute as contaminated
from .test_pii import naive
from .test_simhash import jaccard


@pytest.fixture(scope="module")
def model():
    return pii.train([], made=400, steps=120)


def test_stages(spark, rows, sf_dir, monkeypatch, model):
    monkeypatch.setattr(pii, "train", lambda texts: model)
    docs = common.table(spark, sf_dir, "documents").withColumns({c: common.F.lit("extra") for c in ("score", "items", "spans", "block")})
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    every = sorted((r.doc_id, r.text or "") for r in docs.collect())

    kept = stage["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(every)
    assert all(set(r[-4:]) == {"extra"} for r in kept.collect())

    label = list(range(len(rows[0])))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, t) in enumerate(rows[0]):
        for j in range(i):
            if jaccard(t, rows[0][j][1]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows[0]):
        least[find(i)] = min(d, least.get(find(i), d))
    kept = common.written(stage["simhash_near_dedup"](spark, docs, sf_dir))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())

    clean = {(i, t or "") for (i, t), r in zip(rows[0], contaminated(*rows)) if not r[-1]}
    got = stage["benchmark_decontamination"](spark, docs, sf_dir)
    assert got.columns == docs.columns and {(r.doc_id, r.text or "") for r in got.collect()} == clean

    got = stage["personal_data"](spark, docs, sf_dir)
    assert got.columns == docs.columns and got.count() == len(every)
    for r in got.collect():
        assert r.spans == "extra" and not naive(r.text) and (r.text is None or r.n_chars is None or r.n_chars == len(r.text))


def test_run(spark, sf_dir, empty_dir, monkeypatch, model):
    monkeypatch.setattr(pii, "train", lambda texts: model)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 10 and "bin_length" in out.columns
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
