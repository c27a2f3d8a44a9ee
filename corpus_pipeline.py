"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, mixing and packing of documents.

Each stage works on all that its predecessor kept.  Texts change only where substring dedup removes passages
and where mixing takes the front of one document of a source; rows repeat where mixing takes a document more
than once.

Defined results: documents with null or letterless texts are rejected by the first stage; null ids are ids, null
sources a source of their own; of repeated rows one stays; texts of any length pass whole; all but the last stage
return the columns of documents alone, so that no other column can clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._tables import documents, written
from tracewell.llm.jaccard import order_id, similarity_classes, text_key
from tracewell.llm.langid import predict, train_models
from tracewell.llm.mixing import apply_mix, mix
from tracewell.llm.packing import cut_pieces, pack
from tracewell.llm.queries_langid import held_out
from tracewell.llm.queries_mixing import quality_weights
from tracewell.llm.queries_packing import tokenizer_path
from tracewell.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages; it becomes their ``lang``."""
    models = train_models(docs.where(~held_out()))
    found = predict(docs.select(*COLUMNS), models).where("not rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id, then text, of each near-duplicate class; a null id is first in order.

    Texts without words are in no class: of them only repeated rows go.
    """
    found = similarity_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    found = found.select(order_id().alias("__id"), F.col("text_key").alias("__key"), F.col("root").alias("__root")).distinct()
    rows = docs.select(*COLUMNS, order_id().alias("__id"), text_key().alias("__key")).join(found, ["__id", "__key"])
    one = Window.partitionBy("__root", *(F.when(F.col("__root").isNull(), F.col(c)) for c in COLUMNS)).orderBy(*COLUMNS)
    return rows.withColumn("__at", F.row_number().over(one)).where("__at = 1").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of earlier ones; those of which nothing stays go."""
    cut = remove_repeats(docs.select(*COLUMNS)).where("n_words = n_removed and n_removed = 0 or n_removed < n_words")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    mixed = mix(docs, (1, 2, 3), quality_weights(spark, sf_dir))
    return apply_mix(docs.select(*COLUMNS), mixed).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    packed = pack(cut_pieces(docs, tokenizer_path()))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
