"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from tidings.llm.chat import OP10_SQL, op10_chat_format
from tidings.llm.collocations import OP12_SQL, op12_collocations
from tidings.llm.decontaminate import OP5_SQL, op5_decontaminate
from tidings.llm.html_text import op2_html_text
from tidings.llm.language import op4_language_id
from tidings.llm.mixing import op8_mix_sources
from tidings.llm.neighbours import op3_nearest
from tidings.llm.quality import op9_quality
from tidings.llm.simhash import op1_simhash
from tidings.llm.suffix import op7_suffix_dedup
from tidings.llm.toxicity import op13_toxicity
from tidings.llm.urls import op6_url_filter
from tidings.llm.variants import OP11_SQL, op11_spelling_variants

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_nearest": op3_nearest,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL = {
    "op5_decontaminate": OP5_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
