"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import secret_scan, topk_search, url_filter
from .decontamination import op2_decontamination
from .license_scan import op4_license_scan
from .line_dedup import op10_line_dedup
from .near_dedup import op3_minhash_near_dedup
from .packing import op5_best_fit_packing
from .pii import op7_pii
from .quality import op6_quality_classifier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_line_dedup": op10_line_dedup,
}

#: The others rest on hashes, trained models, tokenizers or alignments; their tests compare with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan.oracle_sql(),
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op9_topk_search": topk_search.ORACLE_SQL,
}
