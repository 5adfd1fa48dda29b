"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import (
    collocations,
    common,
    filter_audit,
    html,
    lm_scoring,
    media,
    mixing,
    packing,
    passages,
    quality,
    simhash,
    substrings,
    token_counts,
    toxicity,
)


def prepared(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        return plan(spark, sf_dir)

    return run


_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": html.op1_html_main_text,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_simhash_groups": simhash.op5_simhash_groups,
    "op6_suffix_dedup": substrings.op6_suffix_dedup,
    "op7_pack_documents": packing.op7_pack_documents,
    "op8_media_columns": media.op8_media_columns,
    "op9_passage_dedup": passages.op9_passage_dedup,
    "op10_cross_entropy_difference": lm_scoring.op10_cross_entropy_difference,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_token_counts": token_counts.op13_token_counts,
}

QUERIES = {name: prepared(plan) for name, plan in _PLANS.items()}

ORACLES: dict[str, str] = {
    "op4_quality_rules": quality.OP4_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
}
