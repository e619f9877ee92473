"""The stages of the corpus pipeline on documents with known fates."""

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_binary_output"]


def test_filters_keep_columns_and_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = p.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 0").count() == 0
    one = p.keep_one_of_each_group(spark, docs, SF)
    assert one.columns == docs.columns
    assert one.groupBy("text").count().filter("count > 1 and text != ''").count() == 0
    clean = p.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def test_mix_repeats_whole_documents(spark, docs):
    mixed = p.mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.join(docs, docs.columns, "left_anti").count() == 0


def test_run(spark):
    out = p.run(spark, SF)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
