"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from palimpsest.llm.ann import op10_nearest_neighbours
from palimpsest.llm.cdc import op9_substring_dedup
from palimpsest.llm.decontaminate import op7_benchmark_decontamination
from palimpsest.llm.html_extract import op3_html_extraction
from palimpsest.llm.langid import op5_language_id
from palimpsest.llm.line_dedup import op1_line_dedup
from palimpsest.llm.ngram_join import op2_ngram_jaccard_join
from palimpsest.llm.pieces import op8_sentencepiece
from palimpsest.llm.secrets import OP4_SQL, op4_secret_scans
from palimpsest.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scans": op4_secret_scans,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLE_SQL = {"op4_secret_scans": OP4_SQL, "op6_warc": OP6_SQL}
