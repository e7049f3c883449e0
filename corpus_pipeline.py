"""The corpus pipeline: quality, near-duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as
Parquet into the shared folder and reads it back. All stages but the last return the columns of their documents,
extra ones included. No stage fails on nulls, empty texts, repeated rows or an empty table:

- quality: a null text is graded as an empty one. Documents below the tail probability go.
- near-duplicates: five-word shingles, Jaccard 0.8 and more; the smallest doc_id of a group stays, once where its row
  is repeated (the row whose other columns have the smallest hash). Rows of one doc_id and other texts are documents of
  their own. Rows without doc_id or words stay.
- repeated passages: words under a 35-word sequence that also starts elsewhere go; other texts stay as they are, and
  so does the row of a text that loses all words, with what is left.
- mixture: rows are repeated or left out so that the sources' words come near the targets.
- token ids: one row for each row, as op4 gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm import minhash, mixing, pieces, quality, substring
from flowspark.llm._common import cut, drop_cut, table
from flowspark.operators import ordinals


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_labels(docs, table(spark, sf_dir, "labels"))
    row = docs.select(F.struct("*").alias("_row"), "text")
    return quality.grade(row, model).where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = ["_doc", "_bytes", "_hash"]
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("_bytes"), F.xxhash64("text").alias("_hash"))
    # one number for each doc_id and text, in the order of doc_id: rows of one id and other texts are other documents
    numbers = ordinals.with_ordinal(row.where("_doc IS NOT NULL").select(*text).distinct().orderBy(*text), "_number")
    # of rows with one doc_id and text, the one whose other columns have the smallest hash; the join keeps their places
    whole = F.to_json("_row") if "map<" in docs.schema.simpleString() else F.col("_row")
    first = Window.partitionBy(*text).orderBy(F.xxhash64(whole), whole)
    single = row.where("_doc IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    once = cut(single.join(numbers, text).select("_row", "_number"), "numbered")
    kept = minhash.near_duplicates(once.select(F.col("_number").alias("doc_id"), "_row.text"), k=5, percent=80).where("kept").select(F.col("doc_id").alias("_number"))
    return once.join(kept, "_number", "left_semi").select("_row.*").union(row.where("_doc IS NULL").select("_row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "source", mixing.n_words("text").alias("size"))
    copies = mixing.mix(row).where("copies > 0").select("_row", "copies")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("SentencePiece ids", encode),
]

#: The classifier and the exact library encoding have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            drop_cut(before)  # the next stage has read all of it
    return docs
