"""The corpus pipeline on small tables, each stage against a plain version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import WORD, plain_near, plain_repeats  # noqa: E402


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.range(0, 120, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 4, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_plain_versions(spark, docs, sf):
    now = docs.withColumn("kept", F.lit("x")).withColumn("size", F.lit(1)).withColumn("_copy", F.lit(2)).withColumn("odd name: x", F.lit("y"))
    columns = now.columns
    stages = dict(corpus_pipeline.STAGES)
    graded = stages["quality classifier"](spark, now, sf)
    assert graded.columns == columns and not Counter(as_rows(graded)) - Counter(as_rows(now))

    near = stages["MinHash near-dedup"](spark, now, sf)
    have, rows = as_rows(near), as_rows(now)
    label = {k: c for k, _, c in plain_near(rows, 5, 80)}
    want = [k for k in label if k is not None and label[k] == k]
    assert near.columns == columns and Counter(r[0] for r in have) == Counter(want + [r[0] for r in rows if r[0] is None])

    thin = stages["substring dedup"](spark, now, sf)
    want = Counter((r[0], tuple(x for x, y in zip(w, g) if not y)) for r, (w, g) in zip(rows, plain_repeats([r[1] for r in rows], 35)))
    assert thin.columns == columns and Counter((r[0], tuple(WORD.findall(r[1] or ""))) for r in as_rows(thin)) == want

    mixed = stages["mixing sources"](spark, now, sf)
    assert mixed.columns == columns and max(Counter(as_rows(mixed)).values()) <= 9 and set(as_rows(mixed)) <= set(rows)

    ids = stages["SentencePiece ids"](spark, now, sf)
    assert ids.count() == len(rows)


def test_run_composes_the_stages(spark, docs, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, sf)
    assert Counter(as_rows(corpus_pipeline.run(spark, sf))) == Counter(as_rows(want))


def test_no_documents(spark, empty, sf, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
