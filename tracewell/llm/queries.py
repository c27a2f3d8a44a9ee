"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tracewell.llm import queries_centroids, queries_chat, queries_fingerprints, queries_hamming, queries_jaccard, queries_langid, queries_lexical, queries_mixing, queries_packing, queries_shards, queries_substrings, queries_tokens, queries_warc

MODULES = (queries_shards, queries_mixing, queries_warc, queries_packing, queries_chat, queries_fingerprints, queries_hamming, queries_langid, queries_substrings, queries_jaccard, queries_centroids, queries_tokens, queries_lexical)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
