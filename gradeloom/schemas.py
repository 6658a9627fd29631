"""Column types of the tables, as DDL texts that readers take as they are."""

from __future__ import annotations


ROLES = (
    "role_slug string, name string, version string, author string, domain string, target_model string, "
    "system_prompt string"
)
TEST_CASES = (
    "role_slug string, test_seq bigint, test_id string, category string, question string, criteria array<string>, "
    "weight int, context array<string>, generated boolean, needs_review boolean"
)
CALLS = (
    "run_id string, test_id string, response string, error string, latency_seconds double, input_tokens bigint, "
    "output_tokens bigint, total_tokens bigint, response_chars bigint, response_words bigint, model_id string, "
    "estimated_cost_usd double, attempt int, started_at timestamp_ntz"
)
CRITERION_RESULTS = (
    "run_id string, test_id string, test_seq bigint, criterion_seq int, text string, score double, "
    "explanation string, dag_score double, dag_dimensions map<string,struct<score:double,passed:boolean>>"
)
SAFETY_RESULTS = ("run_id string, test_id string, metric string, score double, passed boolean, reason string")
EVAL_RUNS = (
    "id bigint, timestamp timestamp_ntz, role string, prompt_name string, prompt_version string, model string, "
    "judge_model string, provider string, mode string, prompt_source string, overall_pct double, dag_pct double, "
    "consolidated_pct double, grade string, consolidated_grade string, num_tests bigint, num_criteria bigint, "
    "category_scores string, avg_latency double, p95_latency double, total_tokens bigint, estimated_cost double, "
    "total_elapsed double, report_path string, run_type string, notes string"
)
CALIBRATION_RUNS = (
    "id bigint, timestamp timestamp_ntz, judge_model string, accuracy double, discrimination double, "
    "avg_deviation double, total_tests bigint, passed bigint, failed bigint, issues_count bigint, "
    "avg_excellent double, avg_adequate double, avg_poor double, avg_misleading double, report_path string"
)
ROLE_VERSIONS = (
    "id bigint, timestamp timestamp_ntz, role_slug string, version string, author string, change_note string, "
    "prompt_text string, test_cases string, context_text string, prompt_hash string, test_hash string, "
    "context_hash string"
)
GOLD_ITEMS = (
    "id string, quality string, domain string, question string, response string, criteria array<string>, "
    "expected_scores array<double>"
)
RED_TEAM_CASES = (
    "vulnerability string, vulnerability_type string, attack string, input string, output string, "
    "turns array<struct<role:string,content:string>>, score double, reason string, error string"
)
