"""Every registered query against its oracle.  By default one query in each family of a
module is run; WATTLOOM_ALL=1 runs them all (about a quarter of an hour)."""
import os

import pytest

from tests.oracle import compare, connect
from wattloom.plans import ORACLE, QUERIES

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
SOME = ["p2_run_selection", "p9_provider_normalise", "p12_outage_scenarios", "q1_season", "q7_station_name", "q16_pinball_wis", "j1_asof_backward", "j2_asof_run", "j10_interval_overlap",
        "j21_successor_chain", "w2_lag_diff", "w5_islands", "w9_rank_corr", "w20_coverage_share", "a1_halfhour_targets", "a8_spread_states", "a13_diurnal_profile", "t3_ranked_k_controls",
        "t5_backoff_lookup", "c2_limit_envelope", "c4_generator_pressure", "c14_electrical_groups", "e1_contraction_detector", "e3_event_landmarks", "e6_step_attribution", "o1_snapshot_diff",
        "o8_matched_effect", "o16_isolated_before_after", "f3_naive_forecasts", "f15_quantile_grid", "f18_alarm_match", "b1_moving_block", "b6_holm", "m4_quarterly_ledger", "m7_net_trade",
        "m16_tail_dependence", "g1_analogue_select", "g3_weighted_quantile", "l3_local_experts", "s1_tagged_csv_scan", "s2_archive_expand", "s7_weather_json_scan", "k3_content_addressed_sink",
        "r1_tumbling_complete", "r4_refractory_alarms", "r8_setter_age", "x19_canonical_episode_links", "x38_harmonic_count"]
NAMES = sorted(QUERIES) if os.environ.get("WATTLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_oracles_name_known_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]
