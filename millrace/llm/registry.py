"""Queries and oracle SQL of the operators."""

from __future__ import annotations

from millrace.llm import decontaminate, jaccard_join, lines, mixing, neighbours, pii, pipeline, quality, sharding, toxicity
from millrace.llm.token_files import op1_token_files

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_personal_data": pii.op2_personal_data,
    "op3_hilbert_shards": sharding.op3_hilbert_shards,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_mix": mixing.op6_mix,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_spread": lines.op8_line_spread,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_quality": quality.op10_quality,
    "pipeline": pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op3_hilbert_shards": sharding.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op8_line_spread": lines.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
