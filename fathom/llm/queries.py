"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, langid, media_gif, minhash, mixing, pii, quality, sharding, substring_dedup, vector_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_setsketch_minhash": minhash.op1_setsketch_minhash,
        "op2_poisson_mixing": mixing.op2_poisson_mixing,
        "op3_subword_quality": quality.op3_subword_quality,
        "op4_boosted_pii": pii.op4_boosted_pii,
        "op5_pruned_graph": vector_dedup.op5_pruned_graph,
        "op6_gif_media": media_gif.op6_gif_media,
        "op7_cross_parsing": langid.op7_cross_parsing,
        "op8_sparse_suffix_array": substring_dedup.op8_sparse_suffix_array,
        "op9_jump_sharding": sharding.op9_jump_sharding,
        "op10_bpe_rank_array": bpe.op10_bpe_rank_array,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_setsketch_minhash": minhash.OP1_SQL,
        "op2_poisson_mixing": mixing.OP2_SQL,
        "op5_pruned_graph": vector_dedup.OP5_SQL,
        "op8_sparse_suffix_array": substring_dedup.OP8_SQL,
        "op9_jump_sharding": sharding.OP9_SQL,
    }
