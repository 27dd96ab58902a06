"""The queries op1 to op10 over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from factloom.llm import decontaminate, mixing, near_dedup, oracle_sql, pii, quality_classifier, quality_rules, substring_dedup, token_files, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_warc": warc.op8_warc,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_substring_dedup": oracle_sql.OP3,
    "op4_quality_rules": oracle_sql.OP4,
    "op6_near_dedup": oracle_sql.OP6,
    "op8_warc": oracle_sql.OP8,
    "op9_decontamination": oracle_sql.OP9,
}
