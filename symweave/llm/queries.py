"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symweave.llm.additive import op9_additive_ann
from symweave.llm.archive import OP1_SQL, op1_arc_to_warc
from symweave.llm.decontaminate import OP8_SQL, op8_suffix_decontam
from symweave.llm.language import op3_byte_cnn_language
from symweave.llm.masked_lm import op2_masked_lm_score
from symweave.llm.packing import op5_concat_cut_pack
from symweave.llm.pii import op7_pii_surrogates
from symweave.llm.quality import op10_rff_quality
from symweave.llm.simhash import op4_simhash_ball
from symweave.llm.token_count import op6_fst_token_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_masked_lm_score": op2_masked_lm_score,
    "op3_byte_cnn_language": op3_byte_cnn_language,
    "op4_simhash_ball": op4_simhash_ball,
    "op5_concat_cut_pack": op5_concat_cut_pack,
    "op6_fst_token_count": op6_fst_token_count,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_suffix_decontam": op8_suffix_decontam,
    "op9_additive_ann": op9_additive_ann,
    "op10_rff_quality": op10_rff_quality,
}

ORACLE_SQL: dict[str, str] = {"op1_arc_to_warc": OP1_SQL, "op8_suffix_decontam": OP8_SQL}
