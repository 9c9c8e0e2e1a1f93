"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate, op8_proximity
from .html_extract import op9_html_extract
from .mixing import op10_mixing
from .quality import op1_quality
from .rules import op6_quality_rules
from .sharding import op5_hilbert_shards
from .simhash import op4_simhash
from .substring_dedup import op2_substring_dedup
from .tokens import op7_token_ids
from .toxicity import op3_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_ids": op7_token_ids,
    "op8_decontaminate": op8_decontaminate,
    "op8_proximity": op8_proximity,
    "op9_html_extract": op9_html_extract,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op8_decontaminate": OP8_SQL}
