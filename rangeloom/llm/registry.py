"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from .decontaminate import op4_decontamination
from .language_id import op9_language_id
from .license_scan import OP7_SQL, op7_license_scan
from .nearest import op8_nearest_neighbours
from .ngram_join import op1_ngram_join
from .repeats import op2_suffix_dedup
from .sentencepiece_ffbs import op3_sentencepiece
from .sharding import op5_sharding
from .token_counts import op10_token_counts
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_sentencepiece, op4_decontamination, op5_sharding, op6_toxicity, op7_license_scan, op8_nearest_neighbours, op9_language_id, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {"op7_license_scan": OP7_SQL}
