"""The subpackage's queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wanetrack.llm import bestfit, bytecnn, chroma, decontaminate, kneserney, merkle, minhash, packing, pieces, resharding, suffixmerge, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        chroma.op1_chroma, minhash.op2_minhash, suffixmerge.op3_suffix_merge, resharding.op4_reshard, toxicity.op5_toxicity,
        decontaminate.op6_decontaminate, kneserney.op7_kneser_ney,
        bytecnn.op8_quality, bestfit.op9_pack_best_fit, packing.op10_pack_concatenated,
        merkle.op11_merkle, whitening.op12_whitening, pieces.op13_pieces,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": minhash.OP2_SQL, "op11_merkle": merkle.OP11_SQL}
