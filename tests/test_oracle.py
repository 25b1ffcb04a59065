"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from sextant import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: One or two of each kind; the driver runs all of them.
NAMES = [
    "bars_from_trades", "bars_intraday_hourly", "densify_panel", "tri_panel", "fwd_return_next_open", "feat_mom", "feat_zret", "feat_sma_slope", "feat_beta", "feat_breadth", "feat_xs_rank_mom", "feat_turn_of_month",
    "asof_vintage", "pit_snapshot", "reaction_session", "resolve_identifier", "membership_mask", "tradable_mask", "validate_bars_issues", "event_study_car", "threshold_signal", "quantile_signal", "spells_to_trades",
    "trades_overlap_allowed", "trades_no_overlap", "segment_overnight", "summarize_returns", "summarize_trades", "quantile_returns", "regime_labels", "regime_performance", "fdr_adjustments", "hac_tstat", "cross_sectional_ic",
    "cusum", "shrunk_covariance", "rolling_spread", "atm_term_structure", "breeden_litzenberger", "option_payoff", "risk_gate", "hash_chain_verify", "three_valued_decision", "findings_grade", "illegal_transitions",
    "sign_flip_test", "bootstrap_ci", "feat_rsi", "hash_chain", "probabilistic_sharpe", "family_pvalues", "run_strategy", "transition_verdicts", "automatic_findings", "assessed_signals", "vault_accesses", "register_batch", "condor_marks",
    "enriched_chain", "session_neighbours", "current_opportunities", "validate_actions", "risk_refusals", "ticker_map",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return int(v) if isinstance(v, (bool, int)) else None if v is None else str(v)


def rows(found, columns):
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
