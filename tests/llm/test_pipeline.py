"""The pipeline's stages on small tables."""

import __spark_entry__ as driver
import corpus_pipeline
import pytest


def test_all_are_registered():
    named = driver.queries()
    assert {n.split("_")[0] for n in named if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in named


@pytest.mark.parametrize("labels", [[], [(1, 0), (6, 0)]])
def test_quality_keeps_all_without_positives(spark, docs, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_rows_of_one_id_with_different_texts_stay(spark):
    first, other = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = [(1, first), (2, None), (2, first), (2, other), (2, other), (3, other), (None, first)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, first), (2, None), (2, other), (None, first)]))


def test_stages(spark, sf_dir, docs):
    from domicilia.llm.tables import read, store

    for rows in (read(spark, sf_dir, "documents"), docs):
        columns, before = rows.columns, rows.count()
        for name, stage in corpus_pipeline.STAGES:
            rows = store(stage(spark, rows, sf_dir))
            if name != "packing":
                assert rows.columns == columns and 0 < rows.count() <= before
                before = rows.count()
        assert rows.filter("length > 2048 OR offset + length > 2048").count() == 0
        assert rows.select("doc_id").distinct().count() <= before


def test_mixing_keeps_other_columns(spark, sf_dir, docs):
    """Columns that are named like those the stage works with keep their values."""
    from pyspark.sql import functions as F

    names = ["topic", "n_tokens", "tokens", "factor", "probability", "u", "weight", "sampled"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in names})
    kept = corpus_pipeline.mixing(spark, wide, sf_dir)
    assert kept.columns == wide.columns
    plain = sorted(str(r.doc_id) for r in corpus_pipeline.mixing(spark, docs, sf_dir).collect())
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == plain
    assert all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in names)


def test_stages_on_nothing(spark, sf_dir, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
