"""Queries and oracle SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from codeloom.llm.bpe import op5_bpe_chunks
from codeloom.llm.contamination import op10_decontaminate
from codeloom.llm.language import op8_language_id
from codeloom.llm.licenses import op2_license_scan
from codeloom.llm.lines import op1_line_dedup
from codeloom.llm.near import op6_ngram_jaccard
from codeloom.llm.oracles import ORACLES
from codeloom.llm.passages import op4_passage_chains
from codeloom.llm.quality import op9_quality_rules
from codeloom.llm.suffix import op3_suffix_dedup
from codeloom.llm.token_counts import op7_token_counts

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_passage_chains": op4_passage_chains,
    "op5_bpe_chunks": op5_bpe_chunks,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
}

__all__ = ["ORACLES", "QUERIES"]
