"""Declared schemas; nothing is inferred."""

from __future__ import annotations

# Field names of the file formats.
PHI = "array<struct<identifier_type string, value string>>"
QUERY = f"query_id string, query_text string, phi_tags {PHI}, phi_count int, is_negative boolean"
METADATA = (
    "dataset string, version string, source_file string, total_queries bigint, positive_queries bigint, "
    "negative_queries bigint, total_phi_elements bigint, phi_type_distribution map<string, bigint>, "
    "query_complexity_distribution map<string, bigint>"
)
ENVELOPE = (
    "metadata struct<dataset: string, version: string, source_file: string, total_queries: bigint, positive_queries: bigint, "
    "negative_queries: bigint, total_phi_elements: bigint, phi_type_distribution: map<string, bigint>, "
    "query_complexity_distribution: map<string, bigint>>, "
    "queries array<struct<query_id: string, query_text: string, phi_tags: array<struct<identifier_type: string, value: string>>, "
    "phi_count: int, is_negative: boolean>>"
)
#: One line of a responses file; model, prompt, run and seq are added by the reader.
RESPONSE = (
    "query_id string, model_name string, model_version string, prompt_style string, run_number int, "
    "input_text string, timestamp_utc string, raw_output string, extracted_output string, parse_status string, "
    "error string, latency_ms bigint, tokens_input bigint, tokens_output bigint, output_truncated boolean, "
    "pass1_output string, pass1_latency_ms bigint, pass2_output string, pass2_latency_ms bigint, "
    "pass2_method string, is_canary boolean, canary_position int"
)
CONFIGURATION = ["model", "prompt"]
COMPARISON = [
    "model", "prompt_style", "t1_recall_mean", "t1_recall_std", "t2_recall_mean", "t2_recall_std",
    "t3_fidelity_mean", "t1_specificity_mean", "t1_specificity_std", "fp_type_a", "fp_type_b", "fp_type_c",
    "fp_type_d", "latency_mean_ms", "latency_median_ms", "latency_p95_ms", "runs_completed", "errors_total",
]
CATEGORY = ["model", "prompt_style", "phi_category", "recall", "count", "detected"]
FALSE_POSITIVES = [
    "query_id", "model", "prompt_style", "run_number", "total_fp_tags", "type_a_count", "type_b_count",
    "type_c_count", "type_d_count", "tagged_terms",
]
