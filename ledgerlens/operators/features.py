"""The behavioural features, as a chain of plain projections.

Each group is a few projections over built-in expressions and expects finite
inputs (``add_features`` sees to that once); only the credit limit bands need
an action (their quartile edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, unpivot
from ledgerlens.operators.quantiles import quantile_values
from ledgerlens.roles import Roles
from ledgerlens.settings import DEFAULTS, Settings

# name -> (category, formula, sources, safe as a model input)
DEFINITIONS = {
    **{f"utilisation_m{m}": ("utilisation", f"bill_amt_m{m} / credit_limit", (f"bill_amt_m{m}", "credit_limit"), False)
       for m in range(1, 7)},
    "utilisation_latest": ("utilisation", "utilisation of the newest month", ("bill_amt_m1", "credit_limit"), True),
    "utilisation_mean_6m": ("utilisation", "mean of the monthly utilisations", ("utilisation_m*",), True),
    "utilisation_max_6m": ("utilisation", "max of the monthly utilisations", ("utilisation_m*",), True),
    "utilisation_volatility": ("utilisation", "population std of the monthly utilisations", ("utilisation_m*",), True),
    "is_high_utilisation": ("utilisation", "utilisation_latest > threshold", ("utilisation_latest",), True),
    "is_over_limit": ("utilisation", "utilisation_max_6m > 1", ("utilisation_max_6m",), True),
    **{f"repayment_ratio_m{m}": ("repayment", f"pay_amt_m{m} / bill_amt_m{m + 1}", (f"pay_amt_m{m}", f"bill_amt_m{m + 1}"), False)
       for m in range(1, 6)},
    "repayment_ratio_mean": ("repayment", "mean of the monthly ratios", ("repayment_ratio_m*",), False),
    "repayment_ratio_median": ("repayment", "median of the monthly ratios", ("repayment_ratio_m*",), False),
    "repayment_ratio_capped_mean": ("repayment", "mean of the ratios clipped to 0..2", ("repayment_ratio_m*",), True),
    "is_full_payer": ("repayment", "repayment_ratio_median >= 0.95", ("repayment_ratio_median",), True),
    "is_revolver": ("repayment", "repayment_ratio_median < 0.30", ("repayment_ratio_median",), True),
    "months_zero_payment": ("repayment", "months with a payment of zero", ("pay_amt_m*",), True),
    "total_paid_6m": ("repayment", "sum of the payments", ("pay_amt_m*",), True),
    "avg_payment_6m": ("repayment", "mean of the payments", ("pay_amt_m*",), True),
    "delinquent_months_count": ("delinquency", "months with status >= 1", ("pay_status_m*",), True),
    "max_delinquency": ("delinquency", "largest status, at least 0", ("pay_status_m*",), True),
    "current_delinquency": ("delinquency", "newest status, at least 0", ("pay_status_m1",), True),
    "ever_delinquent": ("delinquency", "any status >= 1", ("pay_status_m*",), True),
    "is_currently_delinquent": ("delinquency", "current_delinquency >= 1", ("current_delinquency",), True),
    "delinquency_trend": ("delinquency", "late months in m1-m3 against m4-m6", ("pay_status_m*",), False),
    "avg_bill_6m": ("trajectory", "mean of the balances", ("bill_amt_m*",), True),
    "bill_volatility": ("trajectory", "population std of the balances", ("bill_amt_m*",), True),
    "bill_trend_slope": ("trajectory", "least-squares slope, oldest to newest", ("bill_amt_m*",), True),
    "balance_growth_6m": ("trajectory", "(newest - oldest) / |oldest|", ("bill_amt_m1", "bill_amt_m6"), False),
    "limit_band": ("bands", "quartile band of credit_limit", ("credit_limit",), False),
    "age_band": ("bands", "fixed age band", ("age",), False),
}
# name -> (formula, roles that would be needed)
REFUSED = {
    "debt_to_income_ratio": ("debt / income", ("income",)),
    "savings_rate": ("savings / income", ("savings", "income")),
    "expense_ratio": ("expenses / income", ("expenses", "income")),
    "loan_to_income_ratio": ("loan amount / income", ("loan_amount", "income")),
    "income_band": ("quantile band of income", ("income",)),
}
NEEDS = {
    "utilisation": ("bill_amount", "credit_limit"),
    "repayment": ("payment_amount",),
    "delinquency": ("payment_status",),
    "trajectory": ("bill_amount",),
}


def add_utilisation(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    roles = Roles.of(df)
    if not roles.has("bill_amount", "credit_limit"):
        return df
    limit = s.plain(roles.one("credit_limit"))
    bills = roles.months("bill_amount")
    monthly = [f"utilisation_m{m}" for m in bills]
    out = s.project(df, {
        f"utilisation_m{m}": s.divide(s.plain(c), limit, positive_only=True) for m, c in bills.items()
    })
    out = s.project(out, {
        "utilisation_latest": f"utilisation_m{min(bills)}",
        "utilisation_mean_6m": s.row_mean(monthly),
        "utilisation_max_6m": s.row_max(monthly),
    })
    return s.project(out, {
        "utilisation_volatility": s.row_std(monthly, "utilisation_mean_6m"),
        "is_high_utilisation": f"coalesce(utilisation_latest > {s.number(settings.high_utilisation)}, false)",
        "is_over_limit": "coalesce(utilisation_max_6m > 1, false)",
    })


def add_repayment(df: DataFrame) -> DataFrame:
    """Payment of month m settles the statement of month m + 1, so that is the denominator."""
    roles = Roles.of(df)
    payments, bills = roles.months("payment_amount"), roles.months("bill_amount")
    if not payments:
        return df
    lagged = [m for m in payments if m + 1 in bills]
    out = df
    if lagged:
        out = s.project(df, {
            f"repayment_ratio_m{m}": s.divide(s.plain(payments[m]), s.plain(bills[m + 1]), positive_only=True)
            for m in lagged
        })
        ratios = [f"repayment_ratio_m{m}" for m in lagged]
        out = s.project(out, {
            "repayment_ratio_mean": s.row_mean(ratios),
            "repayment_ratio_median": s.row_median(ratios),
            "repayment_ratio_capped_mean": s.row_mean([s.clip(r, 0.0, v.RATIO_CAP) for r in ratios]),
        })
        out = s.project(out, {
            "is_full_payer": f"coalesce(repayment_ratio_median >= {v.FULL_PAYER_FROM}, false)",
            "is_revolver": f"coalesce(repayment_ratio_median < {v.REVOLVER_BELOW}, false)",
        })
    paid = [s.plain(c) for c in payments.values()]
    return s.project(out, {
        "months_zero_payment": f"bigint({s.row_count_if(f'{p} = 0' for p in paid)})",
        "total_paid_6m": s.row_sum(paid),
        "avg_payment_6m": s.row_mean(paid),
    })


def add_delinquency(df: DataFrame) -> DataFrame:
    statuses = Roles.of(df).months("payment_status")
    if not statuses:
        return df
    status = {m: s.plain(c) for m, c in statuses.items()}
    late = {m: f"({x} >= {v.DELINQUENT_FROM})" for m, x in status.items()}
    floored = lambda x: f"IF({x} IS NULL, NULL, greatest({x}, 0D))"
    out = s.project(df, {
        "delinquent_months_count": f"bigint({s.row_count_if(late.values())})",
        "max_delinquency": floored(s.row_max(list(status.values()))),
        "current_delinquency": floored(status[min(status)]),
        "ever_delinquent": s.row_any(late.values()),
    })
    added = {"is_currently_delinquent": f"coalesce(current_delinquency >= {v.DELINQUENT_FROM}, false)"}
    recent, older = [late[m] for m in late if m <= 3], [late[m] for m in late if m > 3]
    if recent and older:
        change = f"({s.row_count_if(recent)} - {s.row_count_if(older)})"
        improving, stable, worsening = v.DELINQUENCY_TRENDS
        added["delinquency_trend"], added["delinquency_trend_ord"] = s.band(
            [(improving, f"{change} < 0"), (stable, f"{change} = 0"), (worsening, f"{change} > 0")]
        )
    return s.project(out, added)


def add_trajectory(df: DataFrame) -> DataFrame:
    bills = Roles.of(df).months("bill_amount")
    if not bills:
        return df
    oldest_first = [s.plain(bills[m]) for m in sorted(bills, reverse=True)]
    out = s.project(df, {"avg_bill_6m": s.row_mean(oldest_first)})
    added = {"bill_volatility": s.row_std(oldest_first, "avg_bill_6m")}
    if len(bills) >= 2:
        newest, oldest = oldest_first[-1], oldest_first[0]
        added["bill_trend_slope"] = s.row_slope(oldest_first)
        added["balance_growth_6m"] = s.divide(f"{newest} - {oldest}", f"abs({oldest})")
    return s.project(out, added)


def limit_band_edges(df: DataFrame, bands: int = v.LIMIT_BANDS) -> list[float]:
    """Quantile edges of the credit limit, repeated edges dropped."""
    column = Roles.of(df).one("credit_limit")
    if column is None:
        return []
    wanted = [i / bands for i in range(bands + 1)]
    got = quantile_values(df, [column], wanted)[column]
    return sorted({got[p] for p in wanted}) if got else []


def limit_band_labels(edges: list[float]) -> list[str]:
    return [f"{v.CURRENCY}{a / 1000:,.0f}k-{b / 1000:,.0f}k" for a, b in zip(edges, edges[1:])]


def add_limit_band(df: DataFrame, bands: int = v.LIMIT_BANDS) -> tuple[DataFrame, str | None]:
    """The banded table and, when no band could be formed, the reason."""
    edges = limit_band_edges(df, bands)
    labels = limit_band_labels(edges)
    if len(labels) < 2:
        return df, "the credit limit has fewer than two distinct quantile bands"
    if len(set(labels)) < len(labels):
        return df, "two quantile bands would carry the same label"
    limit = s.value(df, Roles.of(df).one("credit_limit"))
    label, place = s.right_closed(limit, zip(labels, edges, edges[1:]), lowest_included=True)
    return s.project(df, {"limit_band": label, "limit_band_ord": place}), None


def add_age_band(df: DataFrame) -> DataFrame:
    column = Roles.of(df).one("age")
    if column is None:
        return df
    label, place = s.right_closed(s.value(df, column), v.AGE_BANDS, lowest_included=True)
    return s.project(df, {"age_band": label, "age_band_ord": place})


def finite_money(df: DataFrame) -> DataFrame:
    """NaN and infinities of the source columns become null once, before the feature formulas."""
    roles = Roles.of(df)
    sources = [c for r in ("credit_limit", "bill_amount", "payment_amount", "payment_status", "age") for c in roles.all(r)]
    unsure = [c for c in sources if df.schema[c].dataType.typeName() in ("double", "float", "string")]
    return s.project(df, {c: s.value(df, c) for c in unsure}) if unsure else df


def add_features(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, dict[str, str]]:
    """All feature groups; also the reasons for features that could not be made."""
    out = add_trajectory(add_delinquency(add_repayment(add_utilisation(finite_money(df), settings))))
    skipped: dict[str, str] = {}
    if Roles.of(df).has("credit_limit"):
        out, why = add_limit_band(out)
        if why:
            skipped["limit_band"] = why
    return add_age_band(out), skipped


def feature_report(df: DataFrame, skipped: dict[str, str] | None = None) -> DataFrame:
    """One row per feature known: definition, sources, whether it exists, and why not."""
    skipped, roles, rows = skipped or {}, Roles.of(df), []
    for name, (category, formula, sources, safe) in DEFINITIONS.items():
        made = name in df.columns
        missing = roles.missing(*NEEDS.get(category, ())) if not made else ()
        why = skipped.get(name) or (f"needs {', '.join(missing)}" if missing else "source columns are absent")
        rows.append(Row(name, category, formula, list(sources), made, None if made else why, safe and made))
    for name, (formula, needed) in REFUSED.items():
        missing = roles.missing(*needed)
        if missing:
            rows.append(Row(name, "refused", formula, list(needed), False, f"no {', '.join(missing)} column", False))
    schema = ("feature string, category string, formula string, sources array<string>, created boolean, "
              "skip_reason string, ml_safe boolean")
    return df.sparkSession.createDataFrame(rows, schema)


def feature_coverage(df: DataFrame, skipped: dict[str, str] | None = None) -> DataFrame:
    """The feature report with what the data says: rows and missing values of every feature (one aggregation)."""
    report = feature_report(df, skipped)
    made = [c for c in DEFINITIONS if c in df.columns]
    counts = agg(df, {"n_rows": "count(*)", **{c: f"count_if({s.is_missing(df, c)})" for c in made}})
    found = unpivot(counts, [{"feature": s.text(c), "missing": s.name(c)} for c in made], keep=["n_rows"]) if made else None
    if found is None:
        found = counts.selectExpr("CAST(NULL AS STRING) AS feature", "CAST(NULL AS BIGINT) AS missing", "n_rows").limit(0)
    return report.join(F.broadcast(found), "feature", "left").selectExpr(
        *map(s.name, report.columns), "n_rows", "missing", f"{s.divide('missing', 'n_rows')} * 100 AS missing_pct")


def utilisation_bands(threshold: float = DEFAULTS.high_utilisation) -> list[tuple[str, float, float]]:
    inf = float("inf")
    return [
        ("Negative / zero", -inf, 0.0001),
        ("Low (0-30%)", 0.0001, 0.30),
        ("Moderate (30-60%)", 0.30, 0.60),
        (f"High (60-{threshold:.0%})", 0.60, threshold),
        (f"Very high ({threshold:.0%}+)", threshold, inf),
    ]


def utilisation_band(x: str, threshold: float = DEFAULTS.high_utilisation) -> tuple[str, str]:
    """(label, ordinal) of the half-open band; where bands overlap the later one holds."""
    bands = list(enumerate(utilisation_bands(threshold)))
    arms = [(i, label, f"({x} >= {s.number(low)} AND {x} < {s.number(high)})") for i, (label, low, high) in reversed(bands)]
    labels = " ".join(f"WHEN {c} THEN {s.text(label)}" for _, label, c in arms)
    places = " ".join(f"WHEN {c} THEN {i}" for i, _, c in arms)
    return f"CASE {labels} END", f"CASE {places} END"


def delay_group(delinquency: str) -> tuple[str, str]:
    return s.right_closed(delinquency, v.DELAY_GROUPS)


def status_label(code: str) -> str:
    """``code · meaning`` of a repayment status; null is Unknown."""
    named = f"concat(CAST(int({code}) AS STRING), ' · ', {s.label_of(f'int({code})', v.PAY_STATUS_LABELS, v.UNKNOWN)})"
    return f"coalesce({named}, '{v.UNKNOWN}')"
