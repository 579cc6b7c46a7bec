"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, html, lines, mixing, packing, phrases, quality, repair, sharding, simhash, tokens, urls


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_mixing": mixing.op3_mixing,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_url_filters": urls.op6_url_filters,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_sharding": sharding.op8_sharding,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_html_extraction": html.op10_html_extraction,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_phrase_mining": phrases.op12_phrase_mining,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_dedup": lines.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op5_quality_rules": quality.OP5_SQL,
        "op8_sharding": sharding.OP8_SQL,
        "op9_chat_formatting": chat.OP9_SQL,
        "op12_phrase_mining": phrases.OP12_SQL,
        "op13_conversation_repair": repair.OP13_SQL,
    }
