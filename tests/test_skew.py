"""The registered queries on tables in which single keys hold a third of all rows."""

import os
import sys

import pytest

from gradeloom.plans.catalog import ALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracle  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

# Hot values: one run, one test, one test of one run, one user, one source, one conversation, one report.
SKEWED = {
    "lineitem": """SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 4 ELSE l_suppkey END AS l_suppkey,
                   CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 3 THEN 7 WHEN l_orderkey % 3 = 1 THEN 9 ELSE l_partkey END AS l_partkey) FROM t""",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 2 ELSE user_id END AS user_id) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src3' ELSE source END AS source) FROM t",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id, "
                     "CASE WHEN conv_id % 3 = 0 THEN conv_id * 8 + turn ELSE turn END AS turn) FROM t",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority) FROM t",
    "part": "SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'PROMO' ELSE p_type END AS p_type, "
            "CASE WHEN p_partkey % 3 = 0 THEN 'Brand#2' ELSE p_brand END AS p_brand) FROM t",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    import duckdb

    out = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in check_oracle.TABLES:
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
        con.execute(f"COPY ({SKEWED.get(name, 'SELECT * FROM t')}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return out


# Queries that group, join, rank or stream by a hot key.
KEYED = """overall_score test_scores category_scores weakest_criteria dag_criterion_score_long safety_summary safety_overall safety_all_passed
safety_flagged perf_summary nearest_rank_percentile cost_totals average_repeats average_repeats_safety average_repeats_calls
average_repeats_runs ab_overall ab_categories ab_tests ab_criteria ab_wins pair_ab_history recommendations top_recommendations weak_areas
improvement_input red_team_overview conversation_pairs suite_violations merge_suite merge_counts suite_diff suite_profile first_wins_dedup
read_test_suite resolve_prompt read_reference_docs read_source_docs judge_context context_info build_generation_source build_judge_prompt
generate_responses judge_criteria align_verdicts pending_work retry_worklist append_eval_run append_red_team_run previous_version
version_line_diff restore_version carried_forward run_progress run_progress_batch""".split()


@pytest.mark.parametrize("name", KEYED)
def test_query_equals_sql_on_hot_keys(spark, skewed, name):
    fn, sql = ALL[name]
    assert check_oracle.compare(fn(spark, skewed), check_oracle.connect(skewed), sql) is None
