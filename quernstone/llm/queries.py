"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quernstone.llm import chat_format, decontaminate, html_extract, line_dedup, packing, simhash_dedup, token_counts, topk_search, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_packing": packing.op6_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op5_topk_search": topk_search.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op8_html_extract": html_extract.ORACLE_SQL,
}
