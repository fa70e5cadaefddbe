"""The queries of this subpackage, and the SQL of those that have one."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard, language, lloyd, mixing, pii, quality, revisits, secrets, tokens

QUERIES = {
    "op1_anchor_expansion": pii.op1_anchor_expansion,
    "op2_revisit_resolution": revisits.op2_revisit_resolution,
    "op3_prefix_set_join": decontaminate.op3_prefix_set_join,
    "op4_delta_rollup": tokens.op4_delta_rollup,
    "op5_distribution_divergence": quality.op5_distribution_divergence,
    "op6_string_kernel": language.op6_string_kernel,
    "op7_chosen_path_join": jaccard.op7_chosen_path_join,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_perspective_rotation": chat.op9_perspective_rotation,
    "op10_zstd_novelty": secrets.op10_zstd_novelty,
    "op11_prefix_trie": bpe.op11_prefix_trie,
    "op12_delta_lloyd": lloyd.op12_delta_lloyd,
}
SQL: dict[str, str] = {
    "op2_revisit_resolution": revisits.SQL,
    "op3_prefix_set_join": decontaminate.SQL,
    "op7_chosen_path_join": jaccard.SQL,
    "op8_pareto_mix": mixing.SQL,
    "op9_perspective_rotation": chat.SQL,
    "op12_delta_lloyd": lloyd.SQL,
}
