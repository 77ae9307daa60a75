"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, codebooks, decontaminate, html_text, lang_id, licenses, line_dedup, near_dedup, packing, quality, ranked_search, simhash, top_k


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_language_id": lang_id.op2_language_id,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_top_k": top_k.op4_top_k,
        "op5_chat_format": chat.op5_chat_format,
        "op6_html_text": html_text.op6_html_text,
        "op7_packing": packing.op7_packing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_simhash": simhash.op11_simhash,
        "op12_vector_codes": codebooks.op12_vector_codes,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "license_base_places": licenses.license_base_places,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_top_k": top_k.ORACLE,
        "op5_chat_format": chat.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_decontamination": decontaminate.ORACLE,
        "op10_near_dedup": near_dedup.ORACLE,
        "op12_vector_codes": codebooks.ORACLE,
        "op13_ranked_search": ranked_search.ORACLE,
        "license_base_places": licenses.BASE_SQL,
    }
