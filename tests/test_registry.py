"""Registered queries against their DuckDB twins; TEST_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridlight.registry import ingest, logs, metrics, traces

SAMPLE = [
    "promql_rate", "promql_matchers", "promql_subquery", "promql_agg_topk", "promql_group_left", "promql_fill", "promql_histogram_quantile", "promql_info",
    "logql_label_filter_number", "logql_json", "logql_line_format_template", "logql_quantile_over_time", "logql_variants", "logs_patterns", "logs_stats",
    "traceql_filter_attributes", "traceql_union_ancestor", "traceql_search", "traceql_compare", "traceql_service_graph", "traceql_series_probe", "promql_annotations", "ingest_otlp_metrics", "ingest_metadata", "ingest_new_series",
]
QUERIES = {**metrics.QUERIES, **logs.QUERIES, **traces.QUERIES, **ingest.QUERIES}
ORACLES = {**metrics.ORACLES, **logs.ORACLES, **traces.ORACLES, **ingest.ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows):
    cell = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL") else SAMPLE)
def test_twin(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    want = wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert _norm(found.select(*[f"`{c}`" for c in columns]).collect()) == _norm(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and set(QUERIES) <= names


def test_rest_stands_without_the_training_operators(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['gridlight.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'promql_rate' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
