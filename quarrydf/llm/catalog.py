"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from quarrydf.llm import bpe, langid, lines, media, mixing, pii, simhash, topk, toxicity, urls


def queries():
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_mixing": mixing.op2_mixing,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_pii": pii.op5_pii,
        "op6_topk": topk.op6_topk,
        "op7_media": media.op7_media,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": langid.op9_language_id,
        "op10_url_filters": urls.op10_url_filters,
    }


def oracle_sql():
    return {
        "op3_line_dedup": lines.OP3_SQL,
        "op6_topk": topk.OP6_SQL,
        "op10_url_filters": urls.OP10_SQL,
    }
