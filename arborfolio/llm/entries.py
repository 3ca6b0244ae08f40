"""The queries of this subpackage for __spark_entry__.py. Those whose results SQL can express have it; a trained model, a
tokenizer, a search index or a fitted subset takes part in each of the others, which tests/llm holds against brute force."""

from __future__ import annotations

from arborfolio.llm.conversations import op13_conversation_repair
from arborfolio.llm.decontaminate import op4_decontamination
from arborfolio.llm.jaccard_join import op10_ngram_jaccard_join
from arborfolio.llm.language import op6_language_id
from arborfolio.llm.mixing import op8_mixing
from arborfolio.llm.oracles import ORACLES
from arborfolio.llm.personal_data import op12_personal_data
from arborfolio.llm.secrets import op5_secret_scan
from arborfolio.llm.token_files import op7_token_files
from arborfolio.llm.toxicity import op2_toxicity
from arborfolio.llm.urls import op1_url_filter
from arborfolio.llm.valid_time import op11_valid_time_sales
from arborfolio.llm.vector_search import op3_exact_top_k
from arborfolio.llm.warc import op9_warc

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_exact_top_k, op4_decontamination, op5_secret_scan, op6_language_id, op7_token_files, op8_mixing, op9_warc, op10_ngram_jaccard_join, op11_valid_time_sales, op12_personal_data, op13_conversation_repair)}

__all__ = ["ORACLES", "QUERIES"]
