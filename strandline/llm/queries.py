"""Registry of the training-data queries: name -> callable, name -> SQL."""

from __future__ import annotations

from strandline.llm.decontaminate import op4_decontaminate
from strandline.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from strandline.llm.jaccard_join import op1_jaccard_join
from strandline.llm.language_id import op10_language_id
from strandline.llm.packing import op6_best_fit_packing
from strandline.llm.ppm import op2_ppm_scores
from strandline.llm.toxicity import op3_toxicity
from strandline.llm.training_order import op5_training_order
from strandline.llm.unigram_counts import op7_token_counts
from strandline.llm.warc import OP8_SQL, op8_warc_segments

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_training_order": op5_training_order,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_warc_segments": op8_warc_segments,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op8_warc_segments": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
}
