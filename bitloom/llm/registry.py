"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from bitloom.llm import chat, decontaminate, jaccard_join, line_dedup, mixing, nearest, quality, repeats, surrogates, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_line_dedup": line_dedup.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_repeats": repeats.query,
        "op5_mixing": mixing.query,
        "op6_chat": chat.query,
        "op7_nearest": nearest.query,
        "op8_surrogates": surrogates.query,
        "op9_quality": quality.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op5_mixing": mixing.ORACLE, "op6_chat": chat.ORACLE}
