"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quillbank.llm.best_fit_packing import op10_best_fit_packing
from quillbank.llm.code_compression import OP11_SQL, op11_code_compression
from quillbank.llm.exact_topk import op6_exact_topk
from quillbank.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from quillbank.llm.media_columns import op1_media_columns
from quillbank.llm.near_vectors import OP12_SQL, op12_near_vectors
from quillbank.llm.ngram_jaccard import op3_ngram_jaccard
from quillbank.llm.perspective_chat import OP2_SQL, op2_perspective_chat
from quillbank.llm.quality_classifier import op4_quality_classifier
from quillbank.llm.source_mixing import op7_source_mixing
from quillbank.llm.substring_dedup import op5_substring_dedup
from quillbank.llm.token_counts import op9_token_counts
from quillbank.llm.wrapper_induction import op8_wrapper_induction

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_perspective_chat": op2_perspective_chat,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_source_mixing": op7_source_mixing,
    "op8_wrapper_induction": op8_wrapper_induction,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_code_compression": op11_code_compression,
    "op12_near_vectors": op12_near_vectors,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op2_perspective_chat": OP2_SQL,
    "op11_code_compression": OP11_SQL,
    "op12_near_vectors": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
