"""The queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from siftwork.llm.bpe import op3_bpe
from siftwork.llm.chat import OP13_SQL, op13_chat
from siftwork.llm.jaccard import op9_jaccard
from siftwork.llm.language import op1_language
from siftwork.llm.lexical import OP11_SQL, op11_lexical
from siftwork.llm.licences import OP8_SQL, op8_licences
from siftwork.llm.lm_scoring import op7_lm_scoring
from siftwork.llm.mixing import OP2_SQL, op2_mixing
from siftwork.llm.near_vectors import op4_near_vectors
from siftwork.llm.sharding import op6_sharding
from siftwork.llm.topk import OP5_SQL, op5_topk
from siftwork.llm.token_counts import op10_token_counts
from siftwork.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_near_vectors": op4_near_vectors,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_licences": op8_licences,
    "op9_jaccard": op9_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_lexical": op11_lexical,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat": op13_chat,
}

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op5_topk": OP5_SQL,
    "op8_licences": OP8_SQL,
    "op11_lexical": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_chat": OP13_SQL,
}
