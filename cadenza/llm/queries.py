"""The contract queries of this subpackage and their SQL forms."""

from __future__ import annotations

from functools import wraps

import corpus_pipeline
from cadenza.llm import chat_format, decontaminate, jaccard_join, language_id, license_scan, lm_score, mixing, quality_classifier, quality_rules, url_filter

from cadenza.llm.common import small_batches


def _application(query):
    """The query in a session that hands rows to Python in small batches."""

    @wraps(query)
    def asked(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return asked


def queries() -> dict:
    own = {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_language_id": language_id.op4_language_id,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_lm_score": lm_score.op6_lm_score,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _application(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.op1_sql(),
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_url_filter": url_filter.op3_sql(),
        "op5_source_mixing": mixing.OP5_SQL,
        "op7_chat_format": chat_format.OP7_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
    }
