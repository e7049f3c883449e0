"""The driver's tables as reads, flows, weighted sequences and assignments. The SQL beside each gives DuckDB the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, DNA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
#: Flows of the key in front of each read.
KEY_FLOWS = [100, 0, 100, 0, 0, 100, 0, 100]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, read_id, block (the rows of a label), clip, len, flows (64 hundredths) from embeddings."""
    flows = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("read_id"), F.concat(F.lit("b"), F.coalesce(F.col("label"), F.lit(-1)).cast("string")).alias("block"),
        (24 + F.col("vec_id") % 41).cast("int").alias("clip"), (24 + F.col("vec_id") % 41).cast("int").alias("len"), flows.alias("flows"),
    )


READS = """reads AS (SELECT vec_id AS ord, 'v' || vec_id AS read_id, 'b' || COALESCE(label, -1) AS block, (24 + vec_id % 41)::INT AS clip, (24 + vec_id % 41)::INT AS len,
  list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::INT) AS flows FROM embeddings)"""


def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads with the key's flows in front."""
    return reads(spark, sf_dir).withColumn("flows", F.concat(F.array(*map(F.lit, KEY_FLOWS)), "flows"))


KEYED = READS + f""", keyed AS (SELECT * REPLACE (list_concat({KEY_FLOWS}, flows) AS flows) FROM reads)"""


def _dna(text: str) -> F.Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, DNA)


def _dna_sql(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{DNA}')"


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, block (source and language), seq_id (<source>_<ord>_<weight>), weight, freq, seq (all bases of the text) from
    documents."""
    weight = 1 + F.col("doc_id") % 5
    block = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), block.alias("block"), F.concat_ws("_", "source", F.col("doc_id").cast("string"), weight.cast("string")).alias("seq_id"),
        weight.cast("double").alias("weight"), weight.cast("double").alias("freq"), _dna("text").alias("seq"),
    )


SEQS = f"""seqs AS (SELECT doc_id AS ord, COALESCE(source, '') || '/' || COALESCE(lang, '') AS block, concat_ws('_', source, doc_id, 1 + doc_id % 5) AS seq_id, (1 + doc_id % 5)::DOUBLE AS weight, (1 + doc_id % 5)::DOUBLE AS freq,
  {_dna_sql("text")} AS seq FROM documents)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, block (brand and type), seq_id (<brand>_<part>_<size>), weight, freq, seq (all bases of the name) from part:
    short sequences with many copies, for what is quadratic in a block."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.concat_ws("/", "p_brand", "p_type").alias("block"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("seq_id"),
        F.col("p_size").cast("double").alias("weight"), F.col("p_size").cast("double").alias("freq"), _dna("p_name").alias("seq"),
    )


TAGS = f"""tags AS (SELECT p_partkey AS ord, concat_ws('/', p_brand, p_type) AS block, concat_ws('_', p_brand, p_partkey, p_size) AS seq_id, p_size::DOUBLE AS weight, p_size::DOUBLE AS freq, {_dna_sql("p_name")} AS seq FROM part)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, header (<brand>_<part>_<size>), seq from part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("header"), F.col("p_name").alias("seq"))


WEIGHTED = "weighted AS (SELECT p_partkey AS ord, concat_ws('_', p_brand, p_partkey, p_size) AS header, p_name AS seq FROM part)"


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """otu, sample, pos, freq, weight, seq from lineitem: orders as units, return flags as samples."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("otu"), F.col("l_returnflag").alias("sample"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("long").alias("freq"), F.col("l_quantity").alias("weight"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("seq"),
    )


def responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, k, tau, weight, d from lineitem: orders as items, suppliers as clusters. A supplier counts once an order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("k"))
    return rows.agg(F.max("l_discount").alias("tau"), F.max("l_quantity").alias("weight"), (F.max("l_tax")).alias("d"))


RESP = "resp AS (SELECT l_orderkey AS i, l_suppkey AS k, max(l_discount) AS tau, max(l_quantity) AS weight, max(l_tax) AS d FROM lineitem GROUP BY 1, 2)"
