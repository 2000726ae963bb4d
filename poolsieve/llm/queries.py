"""The queries of this subpackage, their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, harmonic, langid, merkle, mixing, neardup, packing, quality, ranking, suffix, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_language_id": langid.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_near_dedup": neardup.op6_near_dedup,
    "op7_document_fingerprints": merkle.op7_document_fingerprints,
    "op8_suffix_array_dedup": suffix.op8_suffix_array_dedup,
    "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_ranked_ties": ranking.op11_ranked_ties,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_packing": harmonic.op13_packing,
}
ORACLES: dict[str, str] = {
    "op4_warc": warc.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op7_document_fingerprints": merkle.OP7_SQL,
    "op8_suffix_array_dedup": suffix.OP8_SQL,
    "op9_embedding_near_dedup": vectors.OP9_SQL,
    "op11_ranked_ties": ranking.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
