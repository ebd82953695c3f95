"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .decontaminate import OP9_SQL, op9_decontaminate
from .host_rules import OP5_SQL, op5_host_rules
from .license_scan import op1_license_scan
from .near_dedup import op7_near_dedup
from .quality_model import op3_quality_model
from .sharding import op4_sharding
from .source_mix import op2_source_mix
from .substring_dedup import op6_substring_dedup
from .token_prefix import op8_token_prefix
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_quality_model": op3_quality_model,
    "op4_sharding": op4_sharding,
    "op5_host_rules": op5_host_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_prefix": op8_token_prefix,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
}

#: Operators without an entry (random choices, models, hashes or tokenizers that SQL
#: does not have) are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op5_host_rules": OP5_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_warc": OP10_SQL,
}
