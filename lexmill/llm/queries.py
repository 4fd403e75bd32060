"""Queries of this subpackage by name, and SQL twins where SQL can state them."""

from __future__ import annotations

from lexmill.llm.fill_middle import OP11_SQL, op11_relational_fim
from lexmill.llm.fingerprints import op10_quartile_digest
from lexmill.llm.importance import OP12_SQL, op12_target_resampling
from lexmill.llm.near_dedup import OP3_SQL, op3_minhash_forest
from lexmill.llm.pii import op7_anchor_pii
from lexmill.llm.quality import op9_nonneg_pu_quality
from lexmill.llm.secrets import op2_credential_links
from lexmill.llm.sentencepieces import op5_tokenizers_backend
from lexmill.llm.sharding import op4_external_shuffle
from lexmill.llm.source_mix import OP8_SQL, op8_golden_mix
from lexmill.llm.substring_dedup import OP13_SQL, op13_block_anchors
from lexmill.llm.tiff import op1_tiff_pages
from lexmill.llm.toxicity import op6_conv_toxicity

QUERIES = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_credential_links": op2_credential_links,
    "op3_minhash_forest": op3_minhash_forest,
    "op4_external_shuffle": op4_external_shuffle,
    "op5_tokenizers_backend": op5_tokenizers_backend,
    "op6_conv_toxicity": op6_conv_toxicity,
    "op7_anchor_pii": op7_anchor_pii,
    "op8_golden_mix": op8_golden_mix,
    "op9_nonneg_pu_quality": op9_nonneg_pu_quality,
    "op10_quartile_digest": op10_quartile_digest,
    "op11_relational_fim": op11_relational_fim,
    "op12_target_resampling": op12_target_resampling,
    "op13_block_anchors": op13_block_anchors,
}

ORACLES = {"op3_minhash_forest": OP3_SQL, "op8_golden_mix": OP8_SQL, "op11_relational_fim": OP11_SQL, "op12_target_resampling": OP12_SQL, "op13_block_anchors": OP13_SQL}
