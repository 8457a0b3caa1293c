"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id, pseudonyms, secret_scan, substring_dedup, token_blocks,
    url_filter,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_byte_bpe": byte_bpe.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_pseudonyms": pseudonyms.query,
        "op5_secret_scan": secret_scan.query,
        "op6_url_filter": url_filter.query,
        "op7_compact_windows": substring_dedup.query,
        "op8_decontaminate": decontaminate.query,
        "op9_language_id": language_id.query,
        "op10_token_blocks": token_blocks.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op6_url_filter": url_filter.SQL, "op8_decontaminate": decontaminate.SQL}
