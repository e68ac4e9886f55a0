"""Queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.align import op12_alignment
from millrace.llm.chat import SQL as CHAT_SQL
from millrace.llm.chat import op11_chat_format
from millrace.llm.decontaminate import SQL as WINDOWS_SQL
from millrace.llm.decontaminate import op4_decontaminate
from millrace.llm.html_text import op3_html
from millrace.llm.lines import SQL as LINES_SQL
from millrace.llm.lines import op7_line_dedup
from millrace.llm.nearest import op6_nearest
from millrace.llm.packing import op2_packing
from millrace.llm.pii import op10_pii
from millrace.llm.quality import op5_quality
from millrace.llm.secrets import op8_secrets
from millrace.llm.simhash import op9_simhash
from millrace.llm.suffix import SQL as REPEATS_SQL
from millrace.llm.suffix import op1_suffix_dedup
from millrace.llm.whiten import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_nearest": op6_nearest,
    "op7_line_dedup": op7_line_dedup,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_chat_format": op11_chat_format,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_suffix_dedup": REPEATS_SQL,
    "op4_decontaminate": WINDOWS_SQL,
    "op7_line_dedup": LINES_SQL,
    "op11_chat_format": CHAT_SQL,
}
