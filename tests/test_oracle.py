"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievewright.plans import io_queries, metric_queries, record_queries, signal_queries, text_queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "txt6_lists", "txt8_shingles", "txt11_vocabulary", "txt19_trigrams", "txt23_korean", "txt26_scan", "flagship", "txt30_agents", "txt31_green",
    "agg3_auroc", "agg5_eer", "agg8_calibrated", "agg10_isotonic", "agg12_groups", "agg22_members", "agg25_fusion_weights", "jn4_feedback",
    "jn1_duplicates", "jn2_known", "jn5_markers", "jn11_ancestors", "agg15_audit", "snk4_reviews", "smp1_split", "srt1_review_order",
    "med1_audio", "img2_experts", "fus2_fused", "fus4_ensemble", "win1_frames", "win8_av_sync", "win13_pauses", "str1_rolling", "prv2_image_source", "evd3_signatures",
    "str2_alerts", "evd6_cases", "agg16_fingerprint", "agg16_bucketed", "med3_speakers", "prv8_families", "fus7_expert_fusion",
    "txt17_mtld", "txt29_prose", "txt25_advanced", "agg16_tree", "srt1_review_list", "agg4_real_roc", "agg5_real_summary", "agg11_real_fpr", "agg10_real_knots", "jn9_calibrated", "agg24_signals", "win10_pulse", "win11_phase",
    "img4_copy_move", "fus9_explanation", "fus9_forms", "prv4_strings", "prv5_records", "src4_prefix", "src3_capped",
    *io_queries.QUERIES,
]


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5)
        return round(float(v), 5) if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else int(v) if isinstance(v, bool) else v if v is None else float(v) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert plain(got.select(*names).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_every_sql_has_its_query():
    plans = (text_queries, metric_queries, record_queries, signal_queries, io_queries)
    assert all(set(p.SQL) <= set(p.QUERIES) for p in plans)
    assert sum(len(p.QUERIES) for p in plans) == len({n for p in plans for n in p.QUERIES})


def test_entry(spark):
    if os.path.isdir(SF):
        assert {"lang", "items", "high"} <= set(entry.entry(spark).columns)
