"""The ``opN_<name>`` queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, licenses, lm, merkle, neardup, packing, pieces, quality, repeats, spelling, sstable, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_sstable_ids": sstable.query,
        "op7_fm_decontamination": decontamination.query,
        "op8_risk_quality": quality.query,
        "op3_prefix_targets": chat.query,
        "op9_mil_toxicity": toxicity.query,
        "op5_ctw_scores": lm.query,
        "op10_dart_neardup": neardup.query,
        "op4_repeat_removal": repeats.query,
        "op6_ffd_packing": packing.query,
        "op11_merkle_manifest": merkle.query,
        "op12_sentencepiece": pieces.query,
        "op13_spelling_variants": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle_sql(),
        "op3_prefix_targets": chat.ORACLE_SQL,
        "op7_fm_decontamination": decontamination.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op13_spelling_variants": spelling.ORACLE_SQL,
    }
