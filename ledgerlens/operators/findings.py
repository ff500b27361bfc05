"""Findings and signals: rules over two small aggregates of a selection.

One grouped count covers every gradient rule (all band columns at once) and one
single-row aggregation covers everything else, so the number of scans does not
grow with the number of rules.  A rule is a filter ("does it fire") and a
projection (what it says), and carries its evidence in an array.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions import text
from ledgerlens.functions.tables import agg, side_by_side, unpivot
from ledgerlens.operators import eda
from ledgerlens.operators.features import delay_group, utilisation_band
from ledgerlens.roles import Roles, month_label
from ledgerlens.settings import DEFAULTS, Settings

# fixed values: thresholds of the rules
MIN_ROWS = 100
MIN_GROUP = 30
MIN_SPREAD_PP = 3.0
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
TYPES = ("risk", "opportunity", "observation", "data_quality")
CAVEAT = "An observed association in past data; neither a cause nor a forecast."
IN_CREDIT = "Negative / zero"

EVIDENCE = "array<struct<metric:string,value:double,shown:string,comparison:string,n:bigint>>"
COLUMNS = ("key", "type", "title", "fact", "insight", "implication", "action", "severity", "severity_ord", "confidence",
           "confidence_ord", "affected_clients", "affected_share_pct", "evidence", "caveat")


# ------------------------------------------------------------ grading rules

def severity_of_share(share: str) -> str:
    """Position on the severity ladder from the share of the selection concerned (null: info)."""
    return f"CASE WHEN {share} >= 40 THEN 4 WHEN {share} >= 25 THEN 3 WHEN {share} >= 10 THEN 2 WHEN {share} > 0 THEN 1 ELSE 0 END"


def gradient_severity(share: str, spread: str) -> str:
    """Reach, raised one step from 20 points of spread and two from 35."""
    steps = f"CASE WHEN {spread} >= 35 THEN 2 WHEN {spread} >= 20 THEN 1 ELSE 0 END"
    return f"least(4, {severity_of_share(share)} + {steps})"


def confidence_of_sample(n: str, methods: int = 1) -> str:
    high = f"WHEN {n} >= 1000 THEN 2 " if methods >= 2 else ""
    return f"CASE {high}WHEN {n} >= 100 THEN 1 ELSE 0 END"


def intensity(value: str, low: float, high: float) -> str:
    return f"least(1D, greatest(0D, ({value} - {low}) / ({high} - {low})))" if high > low else "0D"


def _name(words: tuple[str, ...], place: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + f")[{place}]"


# ----------------------------------------------------------- the two tables

def level_rates(df: DataFrame, target: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(dimension, level, ord, n, events, rate_pct) of every band with enough clients."""
    bands = []
    if "current_delinquency" in df.columns:
        bands.append(("delay", *delay_group(s.value(df, "current_delinquency"))))
    if "utilisation_latest" in df.columns:
        bands.append(("utilisation", *utilisation_band(s.value(df, "utilisation_latest"), settings.high_utilisation)))
    bands += [(d, s.name(c), s.name(f"{c}_ord")) for d, c in (("limit", "limit_band"), ("age", "age_band")) if c in df.columns]
    entries = [{"dimension": s.text(d), "level": label, "ord": place} for d, label, place in bands]
    long = unpivot(s.project(df, {"__y": s.value(df, target)}), entries, keep=["__y"])
    return agg(long.filter("__y IS NOT NULL AND level IS NOT NULL"), {"n": "count(*)", "events": "sum(__y)"},
               ["dimension", "level", "ord"]).filter(f"n >= {MIN_GROUP}").selectExpr(
        "*", "events / n * 100 AS rate_pct")


def gradients(levels: DataFrame) -> DataFrame:
    """One row per dimension: extremes, ends, the baseline and the sequence of rates."""
    scale = levels.filter(f"level <> '{IN_CREDIT}'")
    one = lambda e: f"max(IF({e}, {{0}}, NULL))"
    rows = agg(scale, {
        "levels": "count(*)",
        "low_level": "min_by(level, struct(rate_pct, ord))", "low_rate": "min(rate_pct)", "low_n": "min_by(n, struct(rate_pct, ord))",
        "high_level": "max_by(level, struct(rate_pct, -ord))", "high_rate": "max(rate_pct)", "high_n": "max_by(n, struct(rate_pct, -ord))",
        "first_level": "min_by(level, ord)", "first_rate": "min_by(rate_pct, ord)", "first_n": "min_by(n, ord)",
        "last_level": "max_by(level, ord)", "last_rate": "max_by(rate_pct, ord)", "last_n": "max_by(n, ord)",
        "base_rate": one("level = 'No delay'").format("rate_pct"), "base_n": one("level = 'No delay'").format("n"),
        "delayed": "sum(IF(level <> 'No delay', n, 0L))",
        "rates": "transform(array_sort(collect_list(struct(ord, rate_pct))), e -> e.rate_pct)",
    }, ["dimension"])
    credit = levels.filter(f"level = '{IN_CREDIT}'").selectExpr("dimension", "n AS credit_n", "rate_pct AS credit_rate")
    return rows.join(F.broadcast(credit), "dimension", "left").selectExpr(
        "*", "rates = array_sort(rates) AS rising", "rates = reverse(array_sort(rates)) AS falling",
        "rates[0] = array_min(rates) AS starts_lowest",
    )


def struct_per_dimension(rows: DataFrame) -> DataFrame:
    """The gradients as one row with a struct column per dimension (null when it has none)."""
    fields = ", ".join(GRADIENT_COLUMNS)
    return agg(rows, {f"{d}_gradient": f"max(IF(dimension = '{d}', struct({fields}), NULL))" for d in ("delay", "utilisation", "limit", "age")})


def selection_facts(df: DataFrame, target: str) -> DataFrame:
    """The single-row aggregate behind the remaining rules and all signals."""
    roles = Roles.of(df)
    y = s.value(df, target)
    has = lambda *names: all(n in df.columns for n in names)
    flag = lambda c: f"coalesce({s.name(c)}, false)" if has(c) else "false"
    missing = "CAST(NULL AS DOUBLE)"
    stats = {
        "n_rows": "count(*)", "overall_rate": f"avg({y}) * 100", "classes": f"IF(min({y}) < max({y}), 2, 1)",
    }
    groups = {
        "high_util": flag("is_high_utilisation"), "late_now": flag("is_currently_delinquent"), "late_ever": flag("ever_delinquent"),
        "revolver": flag("is_revolver"), "over_limit": flag("is_over_limit"), "full_payer": flag("is_full_payer"),
        "low_util": (f"coalesce({s.value(df, 'utilisation_latest')} >= 0 AND {s.value(df, 'utilisation_latest')} < 0.30, false)"
                     if has("utilisation_latest") else "false"),
        "improving": "coalesce(delinquency_trend = 'Improving', false)" if has("delinquency_trend") else "false",
    }
    for g, condition in groups.items():
        stats[f"{g}_n"] = f"count_if({condition})"
        stats[f"{g}_rate"] = f"avg(IF({condition}, {y}, NULL)) * 100"
    stats["zero_months"] = f"avg({s.value(df, 'months_zero_payment')})" if has("months_zero_payment") else missing
    limit = s.value(df, "credit_limit") if has("credit_limit") else missing
    stats["limit_all"], stats["limit_full"] = f"avg({limit})", f"avg(IF({groups['full_payer']}, {limit}, NULL))"
    ratio = s.value(df, "repayment_ratio_capped_mean") if has("repayment_ratio_capped_mean") else missing
    for k in (0, 1):
        x = f"IF({y} = {k}, {ratio}, NULL)"
        stats[f"ratio_{k}"], stats[f"ratio_{k}_n"], stats[f"ratio_{k}_var"] = f"avg({x})", f"count({x})", f"var_samp({x})"
    statuses, use = roles.months("payment_status"), roles.months("utilisation")
    if len(statuses) >= 2:
        for end, m in (("first", max(statuses)), ("last", min(statuses))):
            stats[f"late_{end}"] = f"avg(int({s.value(df, statuses[m])} >= {v.DELINQUENT_FROM})) * 100"
            stats[f"late_{end}_month"] = f"first({s.text(month_label(m))})"
            stats[f"use_{end}"] = f"avg({s.value(df, use[m])}) * 100" if m in use else missing
    else:
        for end in ("first", "last"):
            stats[f"late_{end}"], stats[f"late_{end}_month"], stats[f"use_{end}"] = missing, "CAST(NULL AS STRING)", missing
    pooled = ("sqrt(((ratio_1_n - 1) * coalesce(ratio_1_var, 0D) + (ratio_0_n - 1) * coalesce(ratio_0_var, 0D)) "
              "/ nullif(ratio_1_n + ratio_0_n - 2, 0))")
    d = f"abs({s.divide('ratio_1 - ratio_0', pooled)})"
    return agg(df, stats).selectExpr(
        "*", f"CASE WHEN {d} IS NULL THEN 'undefined' WHEN {d} < 0.2 THEN 'negligible' WHEN {d} < 0.5 THEN 'small' "
             f"WHEN {d} < 0.8 THEN 'medium' ELSE 'large' END AS ratio_effect",
        *[f"{s.divide(f'{g}_n', 'n_rows')} * 100 AS {g}_share" for g in groups],
    )


# ------------------------------------------------------------------- rules

def _pct(x: str, places: int = 2) -> str:
    return f"format_string('%.{places}f%%', {x})"


def _evidence(*items: tuple[str, str, str, str, str]) -> str:
    """Array of (metric, value, shown, comparison, n); items whose value is null are dropped."""
    built = ", ".join(
        f"struct({s.text(m)} AS metric, double({x}) AS value, {shown} AS shown, {other} AS comparison, bigint({n}) AS n)"
        for m, x, shown, other, n in items
    )
    return f"CAST(filter(array({built}), e -> e.value IS NOT NULL) AS {EVIDENCE})"


NONE = "CAST(NULL AS STRING)"


GRADIENT_COLUMNS = ("levels", "low_level", "low_rate", "low_n", "high_level", "high_rate", "high_n", "first_level", "first_rate",
                    "first_n", "last_level", "last_rate", "last_n", "base_rate", "base_n", "delayed", "rising", "falling",
                    "starts_lowest", "credit_n", "credit_rate")
_GRADIENT = re.compile(r"(?<![.'\w])(" + "|".join(GRADIENT_COLUMNS) + r")(?![\w'])")


def _finding(dimension: str | None, fires: str, **parts: str) -> dict[str, str]:
    """One candidate row; bare gradient columns are read from the struct of their dimension."""
    values = {"affected_clients": "NULL", "affected_share_pct": "NULL", "caveat": s.text(CAVEAT), **parts}
    values.setdefault("severity_ord", severity_of_share(f"double({values['affected_share_pct']})"))
    values.setdefault("confidence_ord", confidence_of_sample(f"array_max(transform({values['evidence']}, e -> e.n))"))
    types = {"affected_clients": "bigint({})", "affected_share_pct": "double({})", "severity_ord": "int({})", "confidence_ord": "int({})"}
    entry = {"fires": f"coalesce({fires}, false)", **{k: types.get(k, "{}").format(e) for k, e in values.items()}}
    if dimension is not None:
        entry = {k: _GRADIENT.sub(lambda m: f"{dimension}_gradient.{m.group(1)}", e) for k, e in entry.items()}
    return entry


def key_findings(df: DataFrame, target: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Every finding whose rule fires; empty below 100 rows or with one outcome class."""
    target = target or Roles.of(df).one("target")
    if target is None or target not in df.columns:
        return df.sparkSession.createDataFrame([], (
            "key string, type string, title string, fact string, insight string, implication string, action string, "
            "severity string, severity_ord int, confidence string, confidence_ord int, affected_clients long, "
            f"affected_share_pct double, evidence {EVIDENCE}, caveat string"))
    facts = selection_facts(df, target).filter(f"n_rows >= {MIN_ROWS} AND classes = 2")
    whole = struct_per_dimension(gradients(level_rates(df, target, settings)))
    delayed_share = "delayed / n_rows * 100"
    spread = "(high_rate - low_rate)"

    delay = _finding(
        "delay", f"levels >= 2 AND base_rate IS NOT NULL AND high_level <> 'No delay' AND high_rate - base_rate >= {MIN_SPREAD_PP}",
        key="'delinquency_gradient'", type="'risk'", title="'Recent payment delay separates observed default rates'",
        fact=f"concat('Clients without a recent delay defaulted at ', {_pct('base_rate')}, '; with a delay of ', high_level, ' at ', {_pct('high_rate')}, '.')",
        insight="'The latest repayment status splits the selection into bands with different observed default rates.'",
        implication=f"concat(format_number(delayed, 0), ' clients (', {_pct(delayed_share, 1)}, ') carry some recent delay.')",
        action="'Check how much weight recent repayment status has in monitoring.'",
        severity_ord=gradient_severity(delayed_share, "(high_rate - base_rate)"), affected_clients="delayed",
        affected_share_pct=delayed_share,
        evidence=_evidence(("default_rate_no_delay", "base_rate", _pct("base_rate"), NONE, "base_n"),
                           ("default_rate_worst_delay", "high_rate", _pct("high_rate"), _pct("base_rate"), "high_n")),
    )
    shape = ("CASE WHEN rising THEN 'The rate rises at every step.' WHEN starts_lowest THEN 'The rate rises and then levels off.' "
             "ELSE 'The relationship is not strictly monotonic.' END")
    credit = f"IF(credit_n IS NULL, '', concat(' ', format_number(credit_n, 0), ' accounts in credit (', {_pct('credit_rate')}, ') are set apart.'))"
    utilisation = _finding(
        "utilisation", f"levels >= 2 AND {spread} >= {MIN_SPREAD_PP}",
        key="'utilisation_gradient'", type="'risk'", title="'Observed default differs across utilisation bands'",
        fact=f"concat('Band ', low_level, ' defaulted at ', {_pct('low_rate')}, ', band ', high_level, ' at ', {_pct('high_rate')}, '. ', {shape}, {credit})",
        insight="'Utilisation is balance over limit, the nearest substitute for a debt-to-income ratio in this data.'",
        implication=f"concat(format_number(high_util_n, 0), ' clients (', {_pct('high_util_share', 1)}, ') are above the high-utilisation threshold.')",
        action="'Consider whether sustained high utilisation should start an earlier review.'",
        severity_ord=gradient_severity("high_util_share", spread), affected_clients="high_util_n", affected_share_pct="high_util_share",
        evidence=_evidence(("default_rate_low_utilisation", "low_rate", _pct("low_rate"), NONE, "low_n"),
                           ("default_rate_high_utilisation", "high_rate", _pct("high_rate"), _pct("low_rate"), "high_n"),
                           ("default_rate_in_credit", "credit_rate", _pct("credit_rate"), NONE, "credit_n")),
    )
    first_share = "first_n / n_rows * 100"
    limit = _finding(
        "limit", f"levels >= 2 AND abs(first_rate - last_rate) >= {MIN_SPREAD_PP}",
        key="'limit_band_gradient'", type="'observation'", title="'Observed default differs across credit-limit bands'",
        fact=f"concat('The lowest band ', first_level, ' defaulted at ', {_pct('first_rate')}, ', the highest ', last_level, ' at ', {_pct('last_rate')}, '. ', "
             "IF(falling, 'Each higher band has a lower rate.', 'The bands are not strictly ordered.'))",
        insight="'The lender set the limit from its own assessment, so the pattern reflects that as well as behaviour.'",
        implication=f"concat(format_number(first_n, 0), ' clients (', {_pct(first_share, 1)}, ') sit in the lowest band.')",
        action="'Look for distinct sub-groups inside the lowest band.'",
        severity_ord=gradient_severity(first_share, "abs(last_rate - first_rate)"), affected_clients="first_n",
        affected_share_pct=first_share,
        evidence=_evidence(("default_rate_lowest_limit", "first_rate", _pct("first_rate"), NONE, "first_n"),
                           ("default_rate_highest_limit", "last_rate", _pct("last_rate"), _pct("first_rate"), "last_n")),
    )
    age = _finding(
        "age", f"levels >= 2 AND {spread} >= {MIN_SPREAD_PP}",
        key="'age_band_pattern'", type="'observation'", title="'Observed default varies across age bands'",
        fact=f"concat('Highest in ', high_level, ' (', {_pct('high_rate')}, '), lowest in ', low_level, ' (', {_pct('low_rate')}, ').')",
        insight="'A descriptive difference only; age is never used as a driver.'",
        implication="'Bands differ in limits and behaviour too, which may account for the gap.'",
        action="'Keep as context for a fairness review.'", severity_ord="1",
        evidence=_evidence(("age_band_highest_rate", "high_rate", _pct("high_rate"), NONE, "high_n"),
                           ("age_band_lowest_rate", "low_rate", _pct("low_rate"), _pct("high_rate"), "low_n")),
    )
    ratio = lambda x: f"format_string('%.1f%%', {x} * 100)"
    repayment = _finding(
        None, f"ratio_1_n + ratio_0_n >= {settings.min_rows} AND abs(ratio_1 - ratio_0) >= 0.02",
        key="'repayment_behaviour'", type="'risk'", title="'Repaid share of the statement differs by outcome'",
        fact=f"concat('Mean capped repayment ratio ', {ratio('ratio_1')}, ' with default and ', {ratio('ratio_0')}, ' without (effect: ', ratio_effect, '). ', "
             f"{_pct('revolver_share', 1)}, ' of the selection are revolvers.')",
        insight="'The ratio divides a payment by the previous statement, capped at 200% a month.'",
        implication="'The repaid share is visible every month.'", action="'Consider following a sustained low repaid share.'",
        affected_clients="revolver_n", affected_share_pct="revolver_share", confidence_ord=confidence_of_sample("n_rows", 2),
        evidence=_evidence(("repayment_ratio_defaulters", "ratio_1", ratio("ratio_1"), NONE, "ratio_1_n"),
                           ("repayment_ratio_non_defaulters", "ratio_0", ratio("ratio_0"), ratio("ratio_1"), "ratio_0_n")),
    )
    moved = "(late_last - late_first)"
    trend = _finding(
        None, f"abs({moved}) >= 1",
        key="'delinquency_trend'", type=f"IF({moved} > 0, 'risk', 'opportunity')",
        title=f"concat('Share behind on payment ', IF({moved} > 0, 'rose', 'fell'), ' over the observed months')",
        fact=f"concat('From ', {_pct('late_first')}, ' in ', late_first_month, ' to ', {_pct('late_last')}, ' in ', late_last_month, '.', "
             f"IF(use_first IS NULL OR use_last IS NULL, '', concat(' Mean utilisation went from ', {_pct('use_first', 1)}, ' to ', {_pct('use_last', 1)}, '.')))",
        insight="'The months are snapshots of the same clients, so this is a movement and not a different population.'",
        implication="'A lasting move shifts the level of the whole portfolio.'",
        action="'See whether the movement sits in particular limit or utilisation bands.'",
        affected_share_pct=f"abs({moved}) * 2", caveat="'A few monthly periods allow a comparison but no forecast.'",
        evidence=_evidence(("delinquency_first_period", "late_first", _pct("late_first"), NONE, "n_rows"),
                           ("delinquency_last_period", "late_last", _pct("late_last"), _pct("late_first"), "n_rows"),
                           ("utilisation_change", "use_last - use_first", "format_string('%+.1f pp', use_last - use_first)", NONE, "n_rows")),
    )
    payer = _finding(
        None, f"full_payer_n >= {MIN_GROUP} AND full_payer_rate < overall_rate",
        key="'full_payer_segment'", type="'opportunity'", title="'Full payers show a lower observed default rate'",
        fact=f"concat(format_number(full_payer_n, 0), ' clients (', {_pct('full_payer_share', 1)}, ') usually clear the statement; default rate ', "
             f"{_pct('full_payer_rate')}, ' against ', {_pct('overall_rate')}, ' overall.', "
             f"IF(limit_full IS NULL, '', concat(' Average limit ', {text.currency('limit_full')}, ' against ', {text.currency('limit_all')}, '.')))",
        insight="'These clients use the card to pay rather than to borrow.'",
        implication="'A group of this size is a place to look for growth without proportionate risk.'",
        action="'Confirm that the gap holds at equal limit and utilisation.'",
        affected_clients="full_payer_n", affected_share_pct="full_payer_share",
        evidence=_evidence(("full_payer_count", "full_payer_n", "format_number(full_payer_n, 0)", NONE, "n_rows"),
                           ("full_payer_default_rate", "full_payer_rate", _pct("full_payer_rate"), _pct("overall_rate"), "full_payer_n"),
                           ("full_payer_avg_limit", "limit_full", text.currency("limit_full"), text.currency("limit_all"), "full_payer_n")),
    )
    order = ("fires", *[c for c in COLUMNS if c not in ("severity", "confidence")])
    entries = [{c: e[c] for c in order} for e in (delay, utilisation, repayment, trend, limit, payer, age)]
    return unpivot(side_by_side(facts, whole), entries).filter("fires").selectExpr(*[
        f"{_name(SEVERITIES, 'severity_ord')} AS severity" if c == "severity" else
        f"{_name(CONFIDENCES, 'confidence_ord')} AS confidence" if c == "confidence" else c for c in COLUMNS
    ])


def by_priority(findings: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = findings.orderBy(F.desc("severity_ord"), F.desc("confidence_ord"), F.desc(F.coalesce("affected_share_pct", F.lit(0.0))), "key")
    return ranked if limit is None else ranked.limit(limit)


def actionable(findings: DataFrame) -> DataFrame:
    return findings.filter("severity_ord >= 2")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per type and per severity, zeros included."""
    every = [{"facet": "'type'", "name": s.text(t), "hit": f"int(type = {s.text(t)})"} for t in TYPES]
    every += [{"facet": "'severity'", "name": s.text(x), "hit": f"int(severity = {s.text(x)})"} for x in SEVERITIES]
    counted = agg(unpivot(findings, every), {"n": "sum(hit)"}, ["facet", "name"])
    names = ", ".join(f"struct({e['facet']} AS facet, {e['name']} AS name)" for e in every)
    frame = findings.sparkSession.range(1).selectExpr(f"inline(array({names}))")
    return frame.join(F.broadcast(counted), ["facet", "name"], "left").selectExpr("facet", "name", "coalesce(n, 0L) AS findings")


def unsupported(findings: DataFrame) -> DataFrame:
    """Findings without evidence or with a blank part; must be empty."""
    blank = " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in ("fact", "insight", "implication", "action"))
    return findings.filter(f"size(evidence) = 0 OR {blank}").select("key")


# ----------------------------------------------------------------- signals

def signals(df: DataFrame, target: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Risk and opportunity signals with value, severity and intensity; empty below 100 rows."""
    target = target or Roles.of(df).one("target")
    base = df if target else df.withColumn("__no_target", F.lit(None).cast("double"))
    facts = selection_facts(base, target or "__no_target").filter(f"n_rows >= {MIN_ROWS}")

    def level(share: str, high: float | None, medium: float) -> str:
        top = f"WHEN {share} >= {high} THEN 'high' " if high is not None else ""
        return f"CASE {top}WHEN {share} >= {medium} THEN 'medium' ELSE 'low' END"

    def entry(key, kind, group, severity, top, shown, note):
        share = f"{group}_share"
        return {"key": s.text(key), "kind": s.text(kind), "shown_if": shown, "clients": f"{group}_n", "value": share,
                "rate_pct": f"{group}_rate", "overall_rate_pct": "overall_rate", "severity": severity,
                "intensity": intensity(share, 0.0, top),
                "description": f"concat(format_number({group}_n, 0), {s.text(note)}, {_pct(share, 1)}, ' of the selection.')"}

    present = lambda c: str(c in df.columns).lower()
    enough = lambda g: f"({g}_n >= {MIN_GROUP} AND overall_rate IS NOT NULL AND {g}_rate IS NOT NULL)"
    entries = [
        entry("high_utilisation", "risk", "high_util", level("high_util_share", 25, 10), 50.0, present("is_high_utilisation"),
              f" clients use more than {settings.high_utilisation:.0%} of their limit, "),
        entry("payment_delinquency", "risk", "late_now", level("late_now_share", 20, 10), 40.0, present("is_currently_delinquent"),
              " clients were behind in the newest month, "),
        entry("repayment_behaviour", "risk", "revolver", level("revolver_share", 55, 35), 80.0, present("is_revolver"),
              " clients usually repay less than 30% of the statement, "),
        entry("over_limit", "risk", "over_limit", level("over_limit_share", None, 10), 30.0, "over_limit_share > 0",
              " clients exceeded their limit in some month, "),
        entry("full_payers", "opportunity", "full_payer", "'info'", 50.0, enough("full_payer"),
              " clients usually clear the statement, "),
        entry("low_utilisation_headroom", "opportunity", "low_util", "'info'", 60.0,
              f"({enough('low_util')} AND low_util_rate < overall_rate)", " clients use under 30% of their limit, "),
        entry("improving_delinquency", "opportunity", "improving", "'info'", 30.0, enough("improving"),
              " clients were late less often in the newer half, "),
    ]
    return unpivot(facts, entries).filter("coalesce(shown_if, false)").drop("shown_if").orderBy("kind", F.desc("intensity"), "key")


def refusal(df: DataFrame) -> DataFrame:
    """Why findings are not derived (empty when they are)."""
    n = df.count()
    if n < MIN_ROWS:
        return eda.status(df.sparkSession, "key findings", n, MIN_ROWS, "Too few clients in this selection.")
    return eda.status(df.sparkSession, "key findings", n, MIN_ROWS).limit(0)
