"""op9: documents packed into sequences of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm._tables import documents
from tracewell.llm.packing import cut_pieces, pack

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(cut_pieces(documents(spark, sf_dir), tokenizer_path()))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
