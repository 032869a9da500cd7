"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestar.llm import cas, chat, decontaminate, licenses, mixing, neardup, privacy, quality, sharding, tokens
from lodestar.runtime import table

QUERIES = {
    "op1_token_counts": lambda spark, sf: tokens.token_counts(table(spark, sf, "documents")),
    "op2_sharding": lambda spark, sf: sharding.shard(table(spark, sf, "documents")),
    "op3_license_scan": lambda spark, sf: licenses.scan(table(spark, sf, "documents")),
    "op4_mixing": lambda spark, sf: mixing.mix(table(spark, sf, "documents")),
    "op5_chat_format": lambda spark, sf: chat.chat(table(spark, sf, "conversations")),
    "op6_token_store": lambda spark, sf: cas.store(table(spark, sf, "documents")),
    "op7_quality_rules": quality.query,
    "op8_sanitised": lambda spark, sf: privacy.sanitise(table(spark, sf, "documents")),
    "op9_near_duplicates": lambda spark, sf: neardup.groups(table(spark, sf, "documents")),
    "op10_decontamination": lambda spark, sf: decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
}

ORACLES = {
    "op3_license_scan": licenses.oracle(),
    "op5_chat_format": chat.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
