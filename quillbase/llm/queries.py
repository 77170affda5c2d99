"""The query of each operator, and SQL where SQL can express it on whole tables."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .byte_bpe import op8_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import OP4_SQL, op4_decontaminate
from .lm_scores import op3_lm_scores
from .media import op5_media
from .mixing import OP12_SQL, op12_mixture
from .pii import op7_pii
from .simhash import op2_simhash
from .token_counts import op1_token_counts
from .toxicity import op10_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .warc import op6_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_lm_scores": op3_lm_scores,
    "op4_decontaminate": op4_decontaminate,
    "op5_media": op5_media,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_mixture": op12_mixture,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": OP4_SQL,
    "op9_url_filter": OP9_SQL,
    "op12_mixture": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
