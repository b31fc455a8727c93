"""Queries of this package by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op5_decontamination
from .html_extraction import op3_html
from .language_id import op9_language
from .lm_scoring import op7_lm_score
from .matroska import op8_matroska
from .mixing import op1_mixing
from .near_dedup import OP2_SQL, op2_minhash
from .quality import op6_quality
from .substring_dedup import OP10_SQL, op10_substring
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_minhash": op2_minhash,
    "op3_html": op3_html,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_matroska": op8_matroska,
    "op9_language": op9_language,
    "op10_substring": op10_substring,
}

SQL = {
    "op2_minhash": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op10_substring": OP10_SQL,
}
