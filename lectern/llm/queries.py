"""The registered queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import brown, chat, decontam, divergence, fingerprints, htmlcut, langid, manifest, mixing, pii, sharding, simhash, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_sharding": sharding.query,
        "op3_simhash": simhash.query,
        "op4_personal_data": pii.query,
        "op5_language_id": langid.query,
        "op6_mixing": mixing.query,
        "op7_decontamination": decontam.query,
        "op8_brown_scores": brown.query,
        "op9_main_text": htmlcut.query,
        "op10_url_filter": urlfilter.query,
        "op11_chat_format": chat.query,
        "op12_source_divergence": divergence.query,
        "op13_merkle_manifest": manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.oracle(),
        "op6_mixing": mixing.oracle(),
        "op11_chat_format": chat.oracle(),
        "op12_source_divergence": divergence.oracle(),
        "op13_merkle_manifest": manifest.oracle(),
    }
