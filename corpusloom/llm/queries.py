"""The registered queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.llm import exact_dedup, filter_audit, hard_negatives, language, licenses, lm, packing, pieces, quality, sharding, simhash, suffix_dedup, toxicity
from corpusloom.llm.common import documents


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_query,
        "op2_licenses": licenses.op2_query,
        "op3_packing": packing.op3_query,
        "op4_language": language.op4_query,
        "op5_sharding": lambda spark, sf_dir: sharding.op5_query(documents(spark, sf_dir)),
        "op6_pieces": pieces.op6_query,
        "op7_suffix_dedup": suffix_dedup.op7_query,
        "op8_lm": lm.op8_query,
        "op9_quality": quality.op9_query,
        "op10_exact_dedup": exact_dedup.op10_query,
        "op11_toxicity": toxicity.op11_query,
        "op12_hard_negatives": hard_negatives.op12_query,
        "op13_filter_audit": filter_audit.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.op2_sql(),
        "op5_sharding": sharding.op5_sql(),
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
