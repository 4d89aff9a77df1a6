"""Queries of the llm operators and the SQL that says the same."""

from __future__ import annotations

from gridloom.llm.fair_mix import op6_fair_mix
from gridloom.llm.harmonic_pack import op9_harmonic_pack
from gridloom.llm.histogram_sort import op4_histogram_sort
from gridloom.llm.importance_resample import op5_importance_resample
from gridloom.llm.jaccard_join import op10_jaccard_join
from gridloom.llm.preference_format import OP2_SQL, op2_preference_format
from gridloom.llm.robust_outliers import op7_quality_rules
from gridloom.llm.token_rollup import OP1_SQL, op1_token_rollup
from gridloom.llm.vp_tree import op8_vp_tree
from gridloom.llm.warc_zip import op3_warc_zip

QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_preference_format": op2_preference_format,
    "op3_warc_zip": op3_warc_zip,
    "op4_histogram_sort": op4_histogram_sort,
    "op5_importance_resample": op5_importance_resample,
    "op6_fair_mix": op6_fair_mix,
    "op7_quality_rules": op7_quality_rules,
    "op8_vp_tree": op8_vp_tree,
    "op9_harmonic_pack": op9_harmonic_pack,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {"op1_token_rollup": OP1_SQL, "op2_preference_format": OP2_SQL}
