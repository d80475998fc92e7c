"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from .decontam import op1_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_extract import op3_html_extraction
from .licenses import OP7_SQL, op7_license_scans
from .near_dedup import op8_minhash_near_dedup
from .pieces import op4_sentencepiece
from .secrets import op10_secret_scans
from .shards import op2_sharding
from .sstable import op9_token_output
from .toxicity import op5_toxicity

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_output": op9_token_output,
    "op10_secret_scans": op10_secret_scans,
}

ORACLE_SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op7_license_scans": OP7_SQL,
}
