"""The append-only, hash-chained research log and the decisions that are made over it.

The log is a DataFrame of events; a single writer appends, readers verify the chain in parallel. Status, records and
findings are read as the latest or as all events of an entity.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pit import latest_per_key

#: The lifecycle of hypotheses and the transitions of signals.
LIFECYCLE = ("REGISTERED", "EVALUATED", "FROZEN", "TESTED", "CONCLUDED")
TRANSITIONS = {
    "EXPERIMENTAL": ("VALIDATING", "REJECTED"),
    "VALIDATING": ("ACCEPTED", "REJECTED"),
    "ACCEPTED": ("PAPER_TRADING", "DEGRADED", "RETIRED"),
    "PAPER_TRADING": ("LIVE_ELIGIBLE", "DEGRADED", "RETIRED"),
    "LIVE_ELIGIBLE": ("DEGRADED", "RETIRED"),
    "DEGRADED": ("ACCEPTED", "PAPER_TRADING", "RETIRED"),
    "REJECTED": (),
    "RETIRED": (),
}
GENESIS = "0" * 64


def row_hash(before: Column, seq: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, seq.cast("string"), payload), 256)


def chain(events: DataFrame, by: str, seq: str, payload: str) -> DataFrame:
    """by, seq, payload, prev_hash, row_hash: each log's rows linked along seq. A chain is sequential, so a log is one group."""
    kind = dict(events.dtypes)[by]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        before, links = GENESIS, []
        for n, text in zip(pdf["seq"], pdf["payload"]):
            now = hashlib.sha256(f"{before}|{n}|{text}".encode()).hexdigest()
            links.append((before, now))
            before = now
        return pdf.assign(prev_hash=[a for a, _ in links], row_hash=[b for _, b in links])

    rows = events.select(by, F.col(seq).cast("bigint").alias("seq"), F.col(payload).alias("payload"))
    return rows.groupBy(by).applyInPandas(fold, f"`{by}` {kind}, seq bigint, payload string, prev_hash string, row_hash string")


def broken(log: DataFrame, by: str) -> DataFrame:
    """by, seq of rows whose hash or link does not hold, found in parallel with one window."""
    w = Window.partitionBy(by).orderBy("seq")
    before = F.coalesce(F.lag("row_hash").over(w), F.lit(GENESIS))
    l = log.withColumn("_before", before)
    return l.where((F.col("prev_hash") != F.col("_before")) | (F.col("row_hash") != row_hash(F.col("_before"), F.col("seq"), F.col("payload")))).select(by, "seq")


def current_status(events: DataFrame) -> DataFrame:
    """entity_id, to_status: the last status event of each entity."""
    return latest_per_key(events, ["entity_id"], ["seq"]).select("entity_id", "to_status")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """entity_id, seq, from_status, to_status of status events that the table of transitions does not allow."""
    w = Window.partitionBy("entity_id").orderBy("seq")
    e = events.withColumn("from_status", F.lag("to_status").over(w))
    ok = reduce(lambda a, b: a | b, [(F.col("from_status") == f) & F.col("to_status").isin(list(t)) for f, t in TRANSITIONS.items() if t])
    return e.where(F.col("from_status").isNotNull() & ~ok).select("entity_id", "seq", "from_status", "to_status")


def backward_steps(events: DataFrame) -> DataFrame:
    """entity_id, seq of hypothesis events that don't move forward by one step."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(LIFECYCLE) for x in (s, i)])[F.col("to_status")]
    w = Window.partitionBy("entity_id").orderBy("seq")
    return events.withColumn("_p", place).withColumn("_b", F.coalesce(F.lag("_p").over(w), F.lit(-1))).where("_p <> _b + 1").select("entity_id", "seq")


def merged_records(updates: DataFrame) -> DataFrame:
    """entity_id, field, value: each field's last value over all updates (a record is what its updates add up to)."""
    return latest_per_key(updates, ["entity_id", "field"], ["seq"]).select("entity_id", "field", "value")


def decide(results: DataFrame, by: list[str]) -> DataFrame:
    """by, decision: FAIL if any criterion fails, else INCONCLUSIVE if any is unknown, else PASS."""
    ok = F.col("ok")
    return results.groupBy(*by).agg(F.when(F.bool_or(ok == False), "FAIL").when(F.count(F.when(ok.isNull(), 1)) > 0, "INCONCLUSIVE").otherwise("PASS").alias("decision"))  # noqa: E712


#: Kinds of findings in order, with their labels.
FINDINGS = {
    "SURVIVORSHIP_BIAS": "SURVIVORSHIP-BIASED",
    "LOOK_AHEAD_BIAS": "LOOK-AHEAD",
    "DATA_LEAKAGE": "DATA-LEAKAGE",
    "TEST_CONTAMINATION": "TEST-CONTAMINATED",
    "INCOMPLETE_UNIVERSE": "INCOMPLETE-UNIVERSE",
    "PIT_DATA_ERROR": "PIT-DATA-ERROR",
    "UNREALISTIC_EXECUTION": "UNREALISTIC-EXECUTION",
    "MISSING_COSTS": "MISSING-COSTS",
    "INADEQUATE_SAMPLE": "INADEQUATE-SAMPLE",
    "CORPORATE_ACTION_ERROR": "CORPORATE-ACTION-ERROR",
    "TIMESTAMP_INTEGRITY": "TIMESTAMP-INTEGRITY",
    "UNRELIABLE_PRICES": "UNRELIABLE-PRICES",
    "UNCORRECTED_MULTIPLE_TESTING": "MULTIPLE-TESTING-UNCORRECTED",
    "OTHER_DEFECT": "OTHER-DEFECT",
    "INSUFFICIENT_SIGNIFICANCE": "NOT-SIGNIFICANT-AFTER-CORRECTION",
}
#: Findings that lack evidence, and those that make evidence wrong; all others leave it incomplete.
LACKING = ("INADEQUATE_SAMPLE", "INSUFFICIENT_SIGNIFICANCE")
WRONG = ("LOOK_AHEAD_BIAS", "DATA_LEAKAGE", "TEST_CONTAMINATION", "PIT_DATA_ERROR", "CORPORATE_ACTION_ERROR", "TIMESTAMP_INTEGRITY", "UNRELIABLE_PRICES")


def grades(findings: DataFrame, by: list[str]) -> DataFrame:
    """by, grade of material findings: 'BIASED / ..' or 'PRELIMINARY / ..' with the failures' labels, 'INSUFFICIENT_EVIDENCE / ..' with what lacks, both joined by '; ', or RESEARCH_GRADE."""
    table = [(kind, i, label, kind in LACKING, kind in WRONG) for i, (kind, label) in enumerate(FINDINGS.items())]
    kinds = F.broadcast(findings.sparkSession.createDataFrame(table, "category string, place int, label string, lacks boolean, wrong boolean"))
    f = findings.withColumn("_m", F.col("severity") == "MATERIAL").join(kinds, "category", "left")
    part = lambda lacks: F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("_m") & (F.col("lacks") == lacks), F.struct("place", "label")))), lambda x: x["label"]), "+")
    g = f.groupBy(*by).agg(part(False).alias("_bad"), part(True).alias("_few"), F.coalesce(F.bool_or(F.col("_m") & F.col("wrong")), F.lit(False)).alias("_wrong"))
    bad = F.when(F.col("_bad") != "", F.concat(F.when(F.col("_wrong"), "BIASED").otherwise("PRELIMINARY"), F.lit(" / "), "_bad"))
    few = F.when(F.col("_few") != "", F.concat(F.lit("INSUFFICIENT_EVIDENCE / "), "_few"))
    both = F.concat_ws("; ", bad, few)
    return g.select(*by, F.when(both == "", "RESEARCH_GRADE").otherwise(both).alias("grade"))


def open_findings(raised: DataFrame, resolved: DataFrame, experiments: DataFrame) -> DataFrame:
    """Raised findings without a resolution that names an experiment newer than the finding."""
    good = resolved.join(experiments.select(F.col("experiment_id"), F.col("seq").alias("_e")), "experiment_id").select("finding_id", "_e")
    done = raised.join(good, "finding_id").where(F.col("_e") > F.col("seq")).select("finding_id")
    return raised.join(done, "finding_id", "left_anti")


def grid(features: list[str], thresholds: list[float], holdings: list[int], budget: int = 24) -> list[dict]:
    """All combinations with their neighbours (one step in one parameter); refuses more than the budget."""
    if len(features) * len(thresholds) * len(holdings) > budget:
        raise ValueError("more hypotheses than the budget allows")
    step = lambda xs, x: [xs[i] for i in (xs.index(x) - 1, xs.index(x) + 1) if 0 <= i < len(xs)]
    return [{"feature": f, "threshold": t, "holding": h, "neighbours": [{"threshold": u, "holding": h} for u in step(thresholds, t)] + [{"threshold": t, "holding": k} for k in step(holdings, h)]}
            for f in features for t in thresholds for h in holdings]


def outlier_trimmed_mean(rows: DataFrame, by: list[str], x: str, trim: float = 0.05, least: int = 20) -> DataFrame:
    """by, n, trimmed: the mean of values strictly below the (1 - trim) quantile."""
    r = rows.join(rows.groupBy(*by).agg(F.expr(f"percentile({x}, {1 - trim})").alias("_q")), by)
    return r.groupBy(*by).agg(F.count(x).alias("n"), F.when(F.count(x) >= least, F.avg(F.when(F.col(x) < F.col("_q"), F.col(x)))).alias("trimmed"))


def year_concentration(rows: DataFrame, by: list[str], date: str, x: str) -> DataFrame:
    """by, concentration: the best year's share of the total, NULL unless the total is positive."""
    y = rows.groupBy(*by, F.year(date).alias("_y")).agg(F.sum(x).alias("_s"))
    return y.groupBy(*by).agg(F.when(F.sum("_s") > 0, F.max("_s") / F.sum("_s")).alias("concentration"))


def stability(rows: DataFrame, by: list[str], date: str, x: str, tie: list[str], least: int = 20) -> DataFrame:
    """by, n, slope, slope_p, first_half, second_half, verdict of a strategy's trades over the years since its first.

    A significant slope (p < 0.10) tells a stronger or weaker edge; an edge of the first half that is gone in the second
    has disappeared, whatever the slope.
    """
    from ..functions.special import t_pvalue

    w = Window.partitionBy(*by)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy(date, *tie)), "_n": F.count(F.lit(1)).over(w), "_t": F.datediff(date, F.min(date).over(w)) / F.lit(365.25)})
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(x), F.col("_t")).alias("slope"), F.regr_r2(F.col(x), F.col("_t")).alias("_r2"), F.avg(F.when(early, F.col(x))).alias("first_half"), F.avg(F.when(~early, F.col(x))).alias("second_half"))
    t = F.sqrt(F.col("_r2") * (F.col("n") - 2) / F.nullif(1 - F.col("_r2"), F.lit(0.0)))
    g = g.withColumn("slope_p", 2 * t_pvalue(t, F.col("n") - 2))
    a, b = F.col("first_half"), F.col("second_half")
    verdict = (
        F.when(F.col("n") < least, "INSUFFICIENT_DATA").when((a > 0) & (b <= 0), "DISAPPEARED")
        .when((F.col("slope_p") < 0.10) & (F.col("slope") > 0), "STRENGTHENED").when(F.col("slope_p") < 0.10, "WEAKENED")
        .when(b > 0, "STABLE").otherwise("NO_EDGE_IN_EITHER_HALF"))
    return g.withColumn("verdict", verdict).drop("_r2")


#: Thresholds of the default methodology, and the direction in which each is looser.
DEFAULTS = {
    "min_effective_n_inconclusive": (30.0, -1), "min_effective_n_accept": (100.0, -1), "screen_p_value": (0.05, 1), "validation_sharpe_ratio_of_train": (0.5, -1),
    "walk_forward_min_positive_fold_frac": (0.60, -1), "fdr_q": (0.10, 1), "dsr_min_prob": (0.95, -1), "bootstrap_ci_level": (0.95, -1),
    "cost_stress_multiplier": (2.0, -1), "max_single_year_pnl_share": (0.40, 1), "min_param_neighbor_positive_frac": (0.70, -1), "live_min_paper_days": (60.0, -1),
    "live_min_paper_trades": (30.0, -1), "live_min_forward_percentile": (0.05, -1), "live_max_slippage_ratio": (1.5, 1), "max_participation": (0.10, 1),
}
#: Executions that come after the information, and those that the default methodology allows.
AFTER_INFORMATION = {"next_open": True, "next_close": True, "same_close": False, "same_open": False}
ALLOWED_EXECUTIONS = ("next_open", "next_close")
#: What data flags and failed checks stand for.
FLAGS = {"SURVIVORSHIP_BIASED_UNIVERSE": "SURVIVORSHIP_BIAS", "MODEL_PRICED": "UNRELIABLE_PRICES"}
FAILED_CHECKS = {
    "missing_available_at": "TIMESTAMP_INTEGRITY", "non_trading_session": "TIMESTAMP_INTEGRITY", "non_positive_or_missing_price": "UNRELIABLE_PRICES", "ohlc_inconsistent": "UNRELIABLE_PRICES",
    "negative_volume": "UNRELIABLE_PRICES", "non_positive_value": "CORPORATE_ACTION_ERROR", "unknown_action": "CORPORATE_ACTION_ERROR", "schema": "OTHER_DEFECT",
}
#: Kinds of universes, and the flags of one whose members are only today's.
UNIVERSE_KINDS = ("etf", "stock_pit", "stock_current")
CURRENT_FLAGS = ("SURVIVORSHIP_RISK", "NO_PIT_MEMBERSHIP", "SURVIVORSHIP_BIASED_UNIVERSE")
#: States that need a person's approval, and those that an integrity failure forbids.
NEEDS_APPROVAL = ("PAPER_TRADING", "LIVE_ELIGIBLE")
PROMOTED = ("ACCEPTED", "PAPER_TRADING", "LIVE_ELIGIBLE")


def loosened(criteria: DataFrame, by: list[str]) -> DataFrame:
    """by, name, value, default_value of thresholds (by, name, value) that are looser than the defaults."""
    table = [(n, v, d) for n, (v, d) in DEFAULTS.items()]
    known = F.broadcast(criteria.sparkSession.createDataFrame(table, "name string, default_value double, direction int"))
    return criteria.join(known, "name").where(F.col("direction") * (F.col("value") - F.col("default_value")) > 1e-12).select(*by, "name", "value", "default_value")


def spec_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def register(registered: DataFrame, batch: DataFrame, seq: list[str]) -> DataFrame:
    """batch (id, spec_hash, loosened, justification, ..) with verdict: REGISTERED, DUPLICATE of an earlier row or of `registered` (spec_hash), or REFUSED (looser thresholds without a reason)."""
    first = F.row_number().over(Window.partitionBy("spec_hash", "_refused").orderBy(*seq)) == 1
    old = registered.select("spec_hash", F.lit(True).alias("_old")).distinct()
    b = batch.withColumn("_refused", F.col("loosened") & (F.trim(F.coalesce("justification", F.lit(""))) == "")).join(old, "spec_hash", "left").withColumn("_first", first)
    verdict = F.when(F.col("_refused"), "REFUSED").when(F.coalesce("_old", F.lit(False)) | ~F.col("_first"), "DUPLICATE").otherwise("REGISTERED")
    return b.withColumn("verdict", verdict).drop("_refused", "_old", "_first")


def not_registered(specs: DataFrame, registered: DataFrame) -> DataFrame:
    """id, why of specs (id, spec_hash) that are unknown or differ from what was registered under their id."""
    j = specs.join(registered.select("id", F.col("spec_hash").alias("_known")), "id", "left")
    why = F.when(F.col("_known").isNull(), "UNKNOWN").when(F.col("_known") != F.col("spec_hash"), "CHANGED")
    return j.withColumn("why", why).where("why IS NOT NULL").select("id", "why")


def transition_verdicts(requests: DataFrame) -> DataFrame:
    """requests (from_status, to_status, approved_by, grade, ..) with verdict: OK, NOT_ALLOWED, NEEDS_APPROVAL or BLOCKED by the integrity grade."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    allowed = F.array_contains(pairs, F.concat_ws(">", "from_status", "to_status"))
    approved = F.trim(F.coalesce("approved_by", F.lit(""))) != ""
    verdict = F.when(~allowed, "NOT_ALLOWED").when(F.col("to_status").isin(*NEEDS_APPROVAL) & ~approved, "NEEDS_APPROVAL")
    return requests.withColumn("verdict", verdict.when(F.col("to_status").isin(*PROMOTED) & (F.coalesce("grade", F.lit("")) != "RESEARCH_GRADE"), "BLOCKED").otherwise("OK"))


def automatic_findings(records: DataFrame, by: list[str]) -> DataFrame:
    """by, category, severity: what the rules find in records, one row for each.

    records: flags, failed_checks (arrays of names), lookahead_failures (number), contaminated, leakage, frictions (their
    sum; NULL: no cost model), participation, execution, effective_n, p, q; any may be NULL.
    """
    limit = lambda n: DEFAULTS[n][0]
    names = lambda known: F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    one = lambda when, category: F.when(F.coalesce(when, F.lit(False)), F.lit(category))
    late = ~F.coalesce(names({k: str(v) for k, v in AFTER_INFORMATION.items()})[F.col("execution")] == "True", F.lit(False)) | ~F.col("execution").isin(*ALLOWED_EXECUTIONS)
    rules = [
        one(F.col("lookahead_failures") > 0, "LOOK_AHEAD_BIAS"), one(F.col("contaminated"), "TEST_CONTAMINATION"), one(F.col("leakage"), "DATA_LEAKAGE"),
        one(F.col("frictions") == 0, "MISSING_COSTS"), one((F.col("frictions").isNotNull() & (F.col("participation") > limit("max_participation"))) | (F.col("execution").isNotNull() & late), "UNREALISTIC_EXECUTION"),
        one(F.col("effective_n") < limit("min_effective_n_inconclusive"), "INADEQUATE_SAMPLE"), one(F.col("p").isNotNull() & F.col("q").isNull(), "UNCORRECTED_MULTIPLE_TESTING"), one(F.col("q") > limit("fdr_q"), "INSUFFICIENT_SIGNIFICANCE")]
    none = F.array().cast("array<string>")
    flagged = F.transform(F.coalesce("flags", none), lambda x: names(FLAGS)[x])
    failed = F.transform(F.coalesce("failed_checks", none), lambda x: F.coalesce(names(FAILED_CHECKS)[x], F.lit("OTHER_DEFECT")))
    found = F.array_distinct(F.filter(F.concat(F.array(*rules), flagged, failed), lambda x: x.isNotNull()))
    return records.select(*by, F.explode(found).alias("category")).withColumn("severity", F.lit("MATERIAL"))


def assess(automatic: DataFrame, manual: DataFrame, signals: DataFrame, by: list[str]) -> DataFrame:
    """by, n_findings, grade of each signal, from the distinct findings over all its versions and its open manual ones (by, category, severity)."""
    all_ = automatic.select(*by, "category", "severity").unionByName(manual.select(*by, "category", "severity")).distinct()
    g = grades(all_, by).join(all_.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings")), by)
    return signals.select(*by).distinct().join(g, by, "left").select(*by, F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("grade", F.lit("RESEARCH_GRADE")).alias("grade"))


def raise_verdicts(findings: DataFrame) -> DataFrame:
    """findings (category, severity, detail, raised_by) with verdict: RAISED, or what keeps them from the log."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    verdict = F.when(~F.coalesce(F.col("category").isin(*FINDINGS), F.lit(False)), "UNKNOWN_CATEGORY").when(~F.coalesce(F.col("severity").isin("MATERIAL", "MINOR"), F.lit(False)), "UNKNOWN_SEVERITY")
    return findings.withColumn("verdict", verdict.when(blank("detail") | blank("raised_by"), "INCOMPLETE").otherwise("RAISED"))


def split_plans(plans: DataFrame, experiments: DataFrame) -> DataFrame:
    """plans (family, seq) with n and late: whether the plan came after the family's first experiment (family, seq)."""
    first = experiments.groupBy("family").agg(F.min("seq").alias("_first"))
    n = F.row_number().over(Window.partitionBy("family").orderBy("seq"))
    return plans.withColumn("n", n).join(first, "family", "left").withColumn("late", F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))).drop("_first")


def universe_flags(universes: DataFrame) -> DataFrame:
    """universes (name, kind; NULL: not declared, the worst case) with flags; a kind that isn't known raises."""
    kind = F.coalesce("kind", F.lit("stock_current"))
    known = F.when(kind.isin(*UNIVERSE_KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown universe kind "), kind)))
    return universes.withColumn("flags", F.when(known == "stock_current", F.array(*[F.lit(f) for f in CURRENT_FLAGS])).otherwise(F.array().cast("array<string>")))


def vault_accesses(requests: DataFrame) -> DataFrame:
    """requests (entity_id, seq, status, acknowledged) with verdict: OPENED at the first request of a frozen hypothesis, then CONTAMINATED if acknowledged, else REFUSED."""
    frozen = F.col("status") == "FROZEN"
    before = F.sum(frozen.cast("int")).over(Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(~F.coalesce(frozen, F.lit(False)), "REFUSED").when(F.coalesce(before, F.lit(0)) == 0, "OPENED").when(F.col("acknowledged"), "CONTAMINATED").otherwise("REFUSED")
    return requests.withColumn("verdict", verdict)


def with_status(entities: DataFrame, events: DataFrame, to: str | None = None) -> DataFrame:
    """entities (entity_id, ..) with to_status and status_seq of their last event (of one status if given); NULL without any."""
    e = events.where(F.col("to_status") == to) if to is not None else events
    last = e.groupBy("entity_id").agg(F.max_by("to_status", "seq").alias("to_status"), F.max("seq").alias("status_seq"))
    return entities.join(last, "entity_id", "left")
