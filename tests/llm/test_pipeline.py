import os

import pytest

import corpus_pipeline as cp

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "other")
    item = " ".join(f"q{i}" for i in range(12))
    toxic = [(100 + i, f"plain words here number {i} vilewort{i % 3} and more of them {i * 7}") for i in range(40)]
    clean = [(200 + i, f"plain words here number {i} and others {i * 11} follow it") for i in range(40)]
    rows = [(1, text), (2, text), (3, near), (4, f"x {item} y"), (5, "password=0a1b2c3d4e5f6a7b8c ok"), (6, None), (7, ""), (7, ""), (None, near), (8, "two"), (8, "texts"), *toxic, *clean]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = sorted((str(r.doc_id), r.text) for r in docs.collect())
    ids = {k: {i for i, _ in v} for k, v in kept.items()}
    assert not ids["toxicity"] & {str(i) for i, _ in toxic} and {str(i) for i, _ in clean} <= ids["toxicity"]
    assert "1" in ids["ngram_join"] and not ids["ngram_join"] & {"2", "3", "None"}
    assert [i for i, _ in kept["ngram_join"]].count("7") == 1 and [i for i, _ in kept["ngram_join"]].count("8") == 2
    assert ids["ngram_join"] - ids["decontamination"] == {"4"}
    assert ("5", "password=[secret] ok") in kept["secrets"] and ids["secrets"] == ids["decontamination"]
    assert docs.where("n_chars != length(text)").count() == 0
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and "n_tokens" in last.columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_run(spark):
    rows = cp.run(spark, FOLDER).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
