"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import dialogue_repair, line_templates, ngram_join, url_filter, vector_codes
from .dialogue_repair import op11_dialogue_repair
from .langid import op9_language_id
from .line_templates import op7_line_templates
from .near_copies import op8_minhash_near_copies
from .ngram_join import op13_grouped_prefix_join
from .packing import op3_best_fit_packing
from .piece_codec import op6_sentencepiece
from .suffix_dedup import op5_suffix_dedup
from .syncmers import op4_syncmer_fingerprints
from .token_shards import op1_wavelet_shards
from .url_filter import op10_url_filter
from .vector_codes import op12_ball_codes
from .vector_search import op2_posting_lists


def queries() -> dict:
    found = (op1_wavelet_shards, op2_posting_lists, op3_best_fit_packing, op4_syncmer_fingerprints, op5_suffix_dedup, op6_sentencepiece, op7_line_templates, op8_minhash_near_copies, op9_language_id, op10_url_filter, op11_dialogue_repair, op12_ball_codes, op13_grouped_prefix_join)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return line_templates.ORACLE | url_filter.ORACLE | dialogue_repair.ORACLE | vector_codes.ORACLE | ngram_join.ORACLE
