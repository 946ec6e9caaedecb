"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases: documents without text go through as they are; rows without doc_id are
judged like all others; of rows with equal doc_id and text one stays; columns of other
names are left alone (but for ``_row``); empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common, decontaminate, ngram_join, packing, repeats
from tessitura.llm import toxicity as crf


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not reject."""
    model = crf.train(docs.where(~crf.held_out()), common.read(spark, sf_dir, "labels"))
    plain = [c if c == "text" else f"_c{k}" for k, c in enumerate(docs.columns)]  # so that no column of docs meets the tagger's
    return crf.score(docs.toDF(*plain), model).where("predicted = 0").select(plain).toDF(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each group of near copies; a row is its doc_id and text, and may have no doc_id."""
    row = F.xxhash64("doc_id", "text")
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")).distinct()
    classes = ngram_join.jaccard_components(docs.select(row.alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    kept = rows.join(classes, "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("least")).select(F.col("least.row").alias("_row"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.withColumn("_row", row).join(common.stored(kept), "_row", "left_semi")
    return one.dropDuplicates(["_row"]).select(*names)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what starts earlier in the corpus."""
    return repeats.cut(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(common.stored(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the first stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
