"""The registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    bpe,
    chat,
    decontamination,
    embedding_dedup,
    html_text,
    jaccard_join,
    lexical_search,
    license_scan,
    pii,
    quality,
    secret_scan,
    sharding,
    token_alignment,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_sharding": sharding.op3_sharding,
    "op4_bpe": bpe.op4_bpe,
    "op5_html_text": html_text.op5_html_text,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_quality": quality.op7_quality,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_pii": pii.op10_pii,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
