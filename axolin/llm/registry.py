"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from axolin.llm import byte_bpe, decontaminate, html_text, licenses, merkle, mixing, mpeg, packing, quality, sharding, simhash, suffix_dedup, whitening


def queries() -> dict:
    return {
        "op1_token_packing": packing.query,
        "op2_bwt_repeats": suffix_dedup.query,
        "op3_lookup_sharding": sharding.query,
        "op4_license_digests": licenses.query,
        "op5_html_boosting": html_text.query,
        "op6_mpeg_media": mpeg.query,
        "op7_pivotal_mixing": mixing.query,
        "op8_attention_quality": quality.query,
        "op9_simhash_decontamination": decontaminate.query,
        "op10_golay_simhash": simhash.query,
        "op11_merkle_manifest": merkle.query,
        "op12_byte_bpe": byte_bpe.query,
        "op13_embedding_whitening": whitening.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_lookup_sharding": sharding.oracle(), "op4_license_digests": licenses.oracle(), "op9_simhash_decontamination": decontaminate.oracle(), "op11_merkle_manifest": merkle.oracle()}
