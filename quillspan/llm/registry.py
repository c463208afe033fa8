"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspan.llm.byte_bpe import op6_byte_bpe
from quillspan.llm.chat_format import op1_chat_format
from quillspan.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from quillspan.llm.fill_middle import OP13_SQL, op13_fill_in_middle
from quillspan.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from quillspan.llm.jaccard_join import op7_jaccard_join
from quillspan.llm.minhash_forest import op11_minhash_forest
from quillspan.llm.packing import op4_best_fit_packing
from quillspan.llm.pii import op5_pii
from quillspan.llm.quality_classifier import op2_quality_classifier
from quillspan.llm.quality_rules import OP9_SQL, op9_quality_rules
from quillspan.llm.repeats import op3_repeated_strings
from quillspan.llm.secrets import op8_secret_scan

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL = {
    "op9_quality_rules": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
