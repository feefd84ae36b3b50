"""The queries of the training-data operators, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tillstream.llm.chat import op10_chat_format
from tillstream.llm.decontaminate import op1_decontaminate
from tillstream.llm import line_dedup
from tillstream.llm.nbsvm import op9_quality_nbsvm
from tillstream.llm.id_files import op3_token_files
from tillstream.llm.lm_score import op6_lm_ppm
from tillstream.llm.ngram_join import op4_ngram_jaccard
from tillstream.llm.packing import op8_pack
from tillstream.llm.quality_rules import op2_quality_rules
from tillstream.llm.resample import op13_importance_resample
from tillstream.llm.simhash import op11_simhash
from tillstream.llm.spelling import op12_spelling_variants
from tillstream.llm.toxicity import op7_toxicity_bigru

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_rules, op3_token_files, op4_ngram_jaccard, line_dedup.op5_line_dedup, op6_lm_ppm, op7_toxicity_bigru, op8_pack, op9_quality_nbsvm, op10_chat_format, op11_simhash, op12_spelling_variants, op13_importance_resample)}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": line_dedup.ORACLE_SQL}
