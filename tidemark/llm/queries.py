"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op9_byte_bpe
from tidemark.llm.chat_format import OP13_SQL, op13_chat_format
from tidemark.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from tidemark.llm.fingerprints import op8_fingerprints
from tidemark.llm.importance import OP11_SQL, op11_importance_resampling
from tidemark.llm.license_scan import OP4_SQL, op4_license_scan
from tidemark.llm.line_dedup import OP3_SQL, op3_line_dedup
from tidemark.llm.mixing import OP2_SQL, op2_mixing
from tidemark.llm.ngram_join import OP10_SQL, op10_ngram_join
from tidemark.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from tidemark.llm.quality import op5_quality_classifier
from tidemark.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from tidemark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_mixing, op3_line_dedup, op4_license_scan, op5_quality_classifier, op6_substring_dedup, op7_warc, op8_fingerprints, op9_byte_bpe, op10_ngram_join,
        op11_importance_resampling, op12_periodic_runs, op13_chat_format,
    )
}
SQL = {
    "op1_embedding_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_license_scan": OP4_SQL,
    "op6_substring_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op10_ngram_join": OP10_SQL,
    "op11_importance_resampling": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_chat_format": OP13_SQL,
}
