"""The queries of the training-data operators and their SQL, as the driver calls them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fm_dedup, hmm, jaccard_join, licenses, merkle, packing, pii, prefix_trie, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_hmm_score": hmm.op2_hmm_score,
    "op3_pii": pii.op3_pii,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_fm_dedup": fm_dedup.op10_fm_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality": quality.op13_quality,
}
SQL = {
    "op4_jaccard_join": jaccard_join.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_fm_dedup": fm_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
