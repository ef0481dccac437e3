"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from treekin.llm import collocations, mixing, quality, sql
from treekin.llm.chat import op7_chat_formatting
from treekin.llm.collocations import op11_phrase_collocations
from treekin.llm.decontaminate import op6_benchmark_decontamination
from treekin.llm.html_text import op8_html_extraction
from treekin.llm.licenses import license_base_places, op10_license_scan
from treekin.llm.mixing import op2_mixing
from treekin.llm.ngram_join import op1_ngram_jaccard_join
from treekin.llm.pii import op4_pii, pii_base_counts
from treekin.llm.quality import op5_quality_rules
from treekin.llm.repair import op13_conversation_repair
from treekin.llm.rule_model import op12_quality_classifier
from treekin.llm.tokens import op3_token_counts, op9_token_output

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_output": op9_token_output,
    "op10_license_scan": op10_license_scan,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_conversation_repair": op13_conversation_repair,
    # what SQL can express of operators 4 and 10
    "pii_base_counts": pii_base_counts,
    "license_base_places": license_base_places,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op2_mixing": mixing.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op11_phrase_collocations": collocations.ORACLE,
    "op13_conversation_repair": sql.REPAIR,
    "pii_base_counts": sql.PII_COUNTS,
    "license_base_places": sql.LICENSE_BASE,
}
