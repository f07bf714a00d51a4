"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from favora.llm.chat_trees import OP9_SQL, op9_chat_trees
from favora.llm.decontaminate import op2_decontaminate
from favora.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from favora.llm.language_id import op8_language_id
from favora.llm.minhash_dedup import OP6_SQL, op6_minhash_dedup
from favora.llm.periodic_runs import op12_periodic_runs
from favora.llm.pii import op1_pii
from favora.llm.quality import op10_quality_classifier
from favora.llm.sentencepiece_unigram import op7_sentencepiece
from favora.llm.token_blocks import op3_token_blocks
from favora.llm.topk_search import OP4_SQL, op4_topk_search
from favora.llm.url_filter import OP5_SQL, op5_url_filter
from favora.llm.whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_blocks": op3_token_blocks,
    "op4_topk_search": op4_topk_search,
    "op5_url_filter": op5_url_filter,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_chat_trees": op9_chat_trees,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_minhash_dedup": OP6_SQL,
    "op9_chat_trees": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
}
