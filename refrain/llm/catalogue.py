"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from refrain.llm import byte_bpe, chat, lz_fingerprint, near_dedup, packing, pii, quality_classifier, quality_rules, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_chat_format": chat.op5_chat_format,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lz_fingerprint": lz_fingerprint.op7_lz_fingerprint,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
}
