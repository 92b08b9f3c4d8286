"""The queries of the training-data operators, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from .decontamination import op9_spaced_seed_decontamination
from .jaccard_join import op4_jaccard_join
from .line_dedup import OP3_SQL, op3_line_dedup
from .packing import op10_best_fit_packing
from .pii import op2_pii_weak_supervision
from .quality_classifier import op7_compression_classifier
from .quality_rules import op8_repetition_coverage
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .url_filters import OP5_SQL, op5_link_trust
from .warc import OP6_SQL, op6_warc_round_trip

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_pii_weak_supervision,
        op3_line_dedup,
        op4_jaccard_join,
        op5_link_trust,
        op6_warc_round_trip,
        op7_compression_classifier,
        op8_repetition_coverage,
        op9_spaced_seed_decontamination,
        op10_best_fit_packing,
    )
}

SQL = {"op1_substring_dedup": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_link_trust": OP5_SQL, "op6_warc_round_trip": OP6_SQL}
