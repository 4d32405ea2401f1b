"""The registered queries of the training-data operators. Sharding, fill-in-the-middle and periodic runs have SQL oracles; the other methods
(signatures, graph compaction, tiling, trained models, packing) are tested against brute force in tests/llm."""

from . import fill_middle, rendezvous, tandem_runs
from .bagminhash import op4_bagminhash_near_dedup
from .cotraining import op9_cotraining_quality
from .decontamination import op3_greedy_string_tiling
from .fill_middle import op12_lookaround_fill_middle
from .langid import op5_viterbi_language_id
from .license_scan import op6_fuzzy_license_notices
from .packing import op8_best_fit_packing
from .quality_rules import op1_distribution_divergence
from .rendezvous import op11_rendezvous_shards
from .substring_dedup import op2_substring_dedup
from .tandem_runs import op13_tandem_runs
from .token_attribution import op7_offset_mapped_tokens
from .toxicity import op10_subsequence_kernel_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_distribution_divergence,
        op2_substring_dedup,
        op3_greedy_string_tiling,
        op4_bagminhash_near_dedup,
        op5_viterbi_language_id,
        op6_fuzzy_license_notices,
        op7_offset_mapped_tokens,
        op8_best_fit_packing,
        op9_cotraining_quality,
        op10_subsequence_kernel_toxicity,
        op11_rendezvous_shards,
        op12_lookaround_fill_middle,
        op13_tandem_runs,
    )
}
ORACLES: dict[str, str] = {
    op11_rendezvous_shards.__name__: rendezvous.ORACLE,
    op12_lookaround_fill_middle.__name__: fill_middle.ORACLE,
    op13_tandem_runs.__name__: tandem_runs.ORACLE,
}
