"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, html_extraction, language_id, license_scan, private_data, simhash_dedup, source_mix, substring_dedup, token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_token_output": token_output.op2_token_output,
    "op3_language_id": language_id.op3_language_id,
    "op4_private_data": private_data.op4_private_data,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
}

SQL: dict[str, str] = {
    "op5_source_mix": source_mix.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
