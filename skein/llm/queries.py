"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from skein.llm import chat_format, decontaminate, jaccard_join, license_scan, pii, pipeline, quality_rules, secret_scan, source_mix, token_files, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_pii": pii.op8_pii,
    "op9_token_files": token_files.op9_token_files,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_chat_format": chat_format.ORACLE_SQL,
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_source_mix": source_mix.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
}
