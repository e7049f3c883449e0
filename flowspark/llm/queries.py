"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_warc": "warc",
    "op10_quality": "quality",
    "op2_substring_dedup": "substring",
    "op3_embedding_dedup": "embedding",
    "op4_sentencepiece": "pieces",
    "op5_media_columns": "media",
    "op6_mixing": "mixing",
    "op7_minhash": "minhash",
    "op8_language_id": "langid",
    "op9_token_counts": "tokencount",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracles
    from .mixing import OP6_SQL

    return {"op1_warc": oracles.OP1_SQL, "op2_substring_dedup": oracles.OP2_SQL, "op3_embedding_dedup": oracles.OP3_SQL, "op6_mixing": OP6_SQL, "op7_minhash": oracles.OP7_SQL}
