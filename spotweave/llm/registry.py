"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, media, near_dedup, packing, quality, substring_dedup, token_counts, token_files, url_filter


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality": quality.op2_quality,
        "op3_media": media.op3_media,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_token_files": token_files.op6_token_files,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.OP1_SQL, "op7_chat_format": chat_format.OP7_SQL, "op8_url_filter": url_filter.OP8_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
