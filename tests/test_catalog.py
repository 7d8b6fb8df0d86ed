"""The registered queries against their SQL twins at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"

# One query per operator family; tools/compare.py runs them all.
FAMILIES = (
    "emv", "timeline_intervals", "interval_merge_overlap", "prime_time_multiplier", "category_multiplier", "cumulative_exposure",
    "exposure_report", "price_recommendation", "fuzzy_match_sponsor", "brand_portfolio", "match_rollup", "emv_trend", "assign_owner",
    "zone_share", "hysteresis_labels", "asof_team_label", "track_coast", "softmax_fuse", "phash_near_pairs", "metric_quantiles",
    "best_f1_threshold", "temporal_dedup", "read_detections_csv", "stream_exposure_sessions", "stream_team_votes", "analysis_document",
)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_entry_is_lazy_and_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["video_id", "brand_key", "total_exposure_s", "quality_exposure_s", "segment_count", "emv_usd"]
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    note, _, ok = compare(spark, con, name, SF)
    assert ok, note
