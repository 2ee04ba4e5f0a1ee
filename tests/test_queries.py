"""Queries against their SQL, on the smallest tables; the driver runs all of them."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from crawlgrain.plans import cases  # noqa: F401
from crawlgrain.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
#: Quick ones of every kind.
NAMES = (
    "url_cases", "url_fold_http", "url_sitemap", "url_internal", "robots_cases", "robots_by_status", "robots_facts", "fetch_errors", "body_bytes", "request_headers", "html_cases", "html_link_kinds", "page_heads", "links_by_kind", "link_rel",
    "request_gaps", "gate_depth", "skip_reasons", "self_canonical", "delete_cascade", "sessions_newest_first", "session_lookup", "issues_unknown_severity", "frontier_enqueue", "frontier_spill", "frontier_resume", "frontier_counts", "frontier_start",
    "schedule_daily", "schedule_weekly", "schedule_monthly", "stream_dedup", "stream_recent", "stream_rates", "stream_resumed", "stream_paused", "byte_sizes", "status_labels", "severity_labels", "issues_all", "csv_export_rows", "json_document", "link_graph_dedup", "mini_site_issues",
)


@pytest.fixture(scope="module")
def db():
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(str(plain(r[c])) for c in columns) for r in df.collect()))
    told = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(str(plain(r[k])) for k in at) for r in told.fetchall())


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["link_graph_dedup", "inlink_counts", "outlink_counts", "extract_links", "indexability", "session_stats"])
def test_pages_are_parsed_once_and_plans_stay_small(spark, db, name):
    plan = executed(QUERIES[name](spark, str(DATA)))
    parsed = [line for line in plan.splitlines() if "ArrowEvalPython [_page_facts" in line]
    assert len(parsed) == 1 and len(plan) < 60_000


def test_issues_read_their_rows_once(spark, db):
    """What is left to do for issues reads the narrow table alone."""
    plan = executed(QUERIES["issues_all"](spark, str(DATA)))
    assert "ArrowEvalPython" not in plan and "FileScan" not in plan
