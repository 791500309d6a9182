import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "match_ranked", "evaluate_logs", "gap_clusters", "determinism_diff", "corpus_manifest", "silent_findings", "rule_trace",
    "rule_quality", "run_policy", "fixture_verdicts", "review_duplicates", "co_change_pairs", "relevant_files", "topology_signals",
    "baseline_runs", "differential_diagnosis", "reranked", "source_scan", "page_texts", "stream_sessions", "signature_lines",
    "log_files", "fixture_files", "evaluate_loaded_rules", "explained_logs", "unknown_fingerprints", "appended_runs", "appended_matches", "appended_hooks",
    "cluster_sample_files", "source_lines", "source_signatures", "log_signals", "log_delta", "candidate_patterns", "promoted_fixtures", "merged_contexts", "hook_history",
]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([d[0] for d in cur.description], cur.fetchall())
