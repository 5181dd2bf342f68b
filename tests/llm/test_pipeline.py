import numpy as np

import corpus_pipeline
from tests.llm.conftest import prose


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(31)
    shared = prose(rng, "en", 80)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 150), ("en", "de")[i % 2]) for i in range(80)]
    rows.append((100, prose(rng, "de", 150), "en"))
    for i in range(101, 121):
        rows.append((i, prose(rng, "en", 150).upper().replace(" ", "!! "), "en"))
    rows.append((130, rows[0][1], "en"))
    for i in (140, 141):
        w = prose(rng, "en", 200).split()
        rows.append((i, " ".join(w[:70]) + f" {shared} " + " ".join(w[70:]), "en"))
    table = [(i, t, lang, "src", len(t)) for i, t, lang in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(not 101 <= r[0] < 121)) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert kept.columns == docs.columns
            ids.append({r["doc_id"]: r["text"] for r in kept.collect()})
    everything = {r[0] for r in rows}
    assert everything - set(ids[0]) == {100}
    assert set(ids[0]) - set(ids[1]) == set(range(101, 121))
    assert set(ids[1]) - set(ids[2]) == {130}
    assert set(ids[2]) == set(ids[3]) and [i for i in ids[3] if ids[3][i] != ids[2][i]] == [141]
    packed = {d for r in kept.collect() for d in r["doc_ids"]}
    assert packed == set(ids[3])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, kept.collect()))
