"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from linkloom.llm.collocations import OP11_SQL, op11_collocations
from linkloom.llm.decontam import op10_benchmark_decontamination
from linkloom.llm.html_mincut import op2_main_text
from linkloom.llm.langid import op1_language_id
from linkloom.llm.lexical_search import OP13_SQL, op13_lexical_search
from linkloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from linkloom.llm.neardup import OP3_SQL, op3_embedding_near_dup
from linkloom.llm.ngram_join import op5_ngram_jaccard_join
from linkloom.llm.packing import op8_best_fit_packing
from linkloom.llm.piece_codec import op12_piece_codec
from linkloom.llm.quality_lm import op7_quality_classifier
from linkloom.llm.suffix_dedup import op6_suffix_array_dedup
from linkloom.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_main_text": op2_main_text,
    "op3_embedding_near_dup": op3_embedding_near_dup,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_collocations": op11_collocations,
    "op12_piece_codec": op12_piece_codec,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL = {"op3_embedding_near_dup": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op13_lexical_search": OP13_SQL}
