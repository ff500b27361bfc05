"""The derived tables as DuckDB common table expressions, written independently of the Spark code."""

from __future__ import annotations

M = (1, 2, 3, 4, 5, 6)
MONTH = {1: "Sep 2005", 2: "Aug 2005", 3: "Jul 2005", 4: "Jun 2005", 5: "May 2005", 6: "Apr 2005"}


def each(template: str, months=M, sep: str = ", ") -> str:
    return sep.join(template.format(k=k, y=2001 - k, n=k + 1) for k in months)


def R(expr: str, alias: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {alias}"


def Rs(names, places: int = 6, prefix: str = "") -> str:
    return ", ".join(R(prefix + n, n, places) for n in names)


CLIENTS = f"""
lines AS (
  SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) END) AS paid,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY l_orderkey),
ords AS (
  SELECT o_custkey, year(o_orderdate) AS y, o_totalprice, o_orderstatus, paid, coalesce(returned, 0) AS returned
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
act AS (
  SELECT o_custkey,
    {each("sum(o_totalprice) FILTER (WHERE y = {y}) AS b{k}")},
    {each("sum(paid) FILTER (WHERE y = {y}) AS p{k}")},
    {each("sum(returned) FILTER (WHERE y = {y}) AS r{k}")},
    bool_or(y = 2001 AND o_orderstatus = 'P') AS due
  FROM ords GROUP BY o_custkey),
clients AS MATERIALIZED (
  SELECT c_custkey AS client_id, round(c_acctbal * 100, 0) AS credit_limit, CAST(1 + c_custkey % 2 AS INTEGER) AS sex_code,
    CAST(c_nationkey % 7 AS INTEGER) AS education_code, CAST(c_nationkey % 4 AS INTEGER) AS marriage_code,
    CAST(21 + (c_custkey * 7) % 59 AS INTEGER) AS age,
    {each("CAST(least(9, coalesce(r{k}, 0) - 2) AS INTEGER) AS pay_status_m{k}")},
    {each("b{k} AS bill_amt_m{k}")},
    {each("coalesce(p{k}, 0) AS pay_amt_m{k}")},
    CAST(coalesce(due, false) AS INTEGER) AS default_next_month
  FROM customer LEFT JOIN act ON o_custkey = c_custkey)"""

CODE = """CASE {c} WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' {rest} ELSE 'Unknown' END"""
SEX = "CASE sex_code WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END"
EDUCATION = ("CASE education_code WHEN 1 THEN 'Graduate school' WHEN 2 THEN 'University' WHEN 3 THEN 'High school' "
             "WHEN 4 THEN 'Others' ELSE 'Unknown' END")
MARRIAGE = "CASE marriage_code WHEN 1 THEN 'Married' WHEN 2 THEN 'Single' WHEN 3 THEN 'Others' ELSE 'Unknown' END"

CLEAN = CLIENTS + f""",
med AS (SELECT {each("quantile_cont(bill_amt_m{k}, 0.5) AS md{k}")} FROM clients),
filled AS (
  SELECT clients.* EXCLUDE (credit_limit, {each("bill_amt_m{k}")}),
    CASE WHEN credit_limit > 0 THEN credit_limit END AS credit_limit, credit_limit AS credit_limit_original,
    {each("coalesce(bill_amt_m{k}, md{k}) AS bill_amt_m{k}")},
    {each("bill_amt_m{k} IS NULL AS bill_amt_m{k}_was_missing")},
    {SEX} AS sex, {EDUCATION} AS education, {MARRIAGE} AS marriage,
    age < 18 OR age > 100 AS age_is_implausible
  FROM clients, med),
money AS (UNPIVOT (SELECT client_id, credit_limit, {each("bill_amt_m{k}")}, {each("pay_amt_m{k}")} FROM filled)
          ON COLUMNS(* EXCLUDE client_id) INTO NAME col VALUE val),
fence AS (SELECT col, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.75) AS q3 FROM money GROUP BY col
          HAVING count(DISTINCT val) > 2 AND quantile_cont(val, 0.75) > quantile_cont(val, 0.25)),
extreme AS (SELECT client_id, bool_or(val < q1 - 3 * (q3 - q1) OR val > q3 + 3 * (q3 - q1)) AS e
            FROM money JOIN fence USING (col) GROUP BY client_id),
cleaned AS MATERIALIZED (
  SELECT filled.*, coalesce(e, false) AS has_extreme_value,
    ({each("bill_amt_m{k} < 0", sep=" OR ")}) AS has_negative_balance
  FROM filled LEFT JOIN extreme USING (client_id))"""

U = "[" + each("utilisation_m{k}") + "]"
P = "[" + each("pay_amt_m{k}") + "]"
B = "[" + each("bill_amt_m{k}") + "]"
RR = "[" + each("repayment_ratio_m{k}", M[:5]) + "]"
CAP = "[" + each("least(greatest(repayment_ratio_m{k}, 0), 2)", M[:5]) + "]"
LATE = [f"CAST(pay_status_m{k} >= 1 AS INTEGER)" for k in M]
SLOPE = " + ".join(f"({i} - 3.5) * bill_amt_m{7 - i}" for i in M)
BAND = "'NT$' || format('{{:,}}', CAST(round_even(e[{a}] / 1000, 0) AS BIGINT)) || 'k-' || format('{{:,}}', CAST(round_even(e[{b}] / 1000, 0) AS BIGINT)) || 'k'"
UTIL_BAND = ("CASE WHEN utilisation_latest < 0.0001 THEN 'Negative / zero' WHEN utilisation_latest < 0.3 THEN 'Low (0-30%)' "
             "WHEN utilisation_latest < 0.6 THEN 'Moderate (30-60%)' WHEN utilisation_latest < 0.8 THEN 'High (60-80%)' "
             "WHEN utilisation_latest >= 0.8 THEN 'Very high (80%+)' END")
UTIL_ORD = ("CASE WHEN utilisation_latest < 0.0001 THEN 0 WHEN utilisation_latest < 0.3 THEN 1 "
            "WHEN utilisation_latest < 0.6 THEN 2 WHEN utilisation_latest < 0.8 THEN 3 WHEN utilisation_latest >= 0.8 THEN 4 END")
DELAY = ("CASE WHEN current_delinquency <= 0.5 THEN 'No delay' WHEN current_delinquency <= 1.5 THEN '1 month' "
         "WHEN current_delinquency <= 2.5 THEN '2 months' ELSE '3+ months' END")
DELAY_ORD = ("CASE WHEN current_delinquency <= 0.5 THEN 0 WHEN current_delinquency <= 1.5 THEN 1 "
             "WHEN current_delinquency <= 2.5 THEN 2 ELSE 3 END")

FEATURES = CLEAN + f""",
f1 AS (SELECT *, {each("bill_amt_m{k} / credit_limit AS utilisation_m{k}")},
  {each("CASE WHEN bill_amt_m{n} > 0 THEN pay_amt_m{k} / bill_amt_m{n} END AS repayment_ratio_m{k}", M[:5])} FROM cleaned),
f2 AS (SELECT *, utilisation_m1 AS utilisation_latest, list_avg({U}) AS utilisation_mean_6m, list_max({U}) AS utilisation_max_6m,
  list_stddev_pop({U}) AS utilisation_volatility,
  list_avg({RR}) AS repayment_ratio_mean, list_median({RR}) AS repayment_ratio_median, list_avg({CAP}) AS repayment_ratio_capped_mean,
  CAST({" + ".join(f"CAST(pay_amt_m{k} = 0 AS INTEGER)" for k in M)} AS BIGINT) AS months_zero_payment, list_sum({P}) AS total_paid_6m, list_avg({P}) AS avg_payment_6m,
  CAST({" + ".join(LATE)} AS BIGINT) AS delinquent_months_count,
  CAST(greatest({each("pay_status_m{k}")}, 0) AS DOUBLE) AS max_delinquency,
  CAST(greatest(pay_status_m1, 0) AS DOUBLE) AS current_delinquency,
  {" + ".join(LATE[:3])} - ({" + ".join(LATE[3:])}) AS shift,
  list_avg({B}) AS avg_bill_6m, list_stddev_pop({B}) AS bill_volatility, ({SLOPE}) / 17.5 AS bill_trend_slope,
  CASE WHEN bill_amt_m6 <> 0 THEN (bill_amt_m1 - bill_amt_m6) / abs(bill_amt_m6) END AS balance_growth_6m FROM f1),
edges AS (SELECT quantile_cont(credit_limit, [0, 0.25, 0.5, 0.75, 1]) AS e FROM cleaned),
feat AS MATERIALIZED (SELECT f2.* EXCLUDE (shift),
  coalesce(utilisation_latest > 0.8, false) AS is_high_utilisation, coalesce(utilisation_max_6m > 1, false) AS is_over_limit,
  coalesce(repayment_ratio_median >= 0.95, false) AS is_full_payer, coalesce(repayment_ratio_median < 0.3, false) AS is_revolver,
  delinquent_months_count > 0 AS ever_delinquent, current_delinquency >= 1 AS is_currently_delinquent,
  CASE WHEN shift < 0 THEN 'Improving' WHEN shift > 0 THEN 'Worsening' ELSE 'Stable' END AS delinquency_trend,
  CASE WHEN credit_limit <= e[2] THEN {BAND.format(a=1, b=2)} WHEN credit_limit <= e[3] THEN {BAND.format(a=2, b=3)}
       WHEN credit_limit <= e[4] THEN {BAND.format(a=3, b=4)} WHEN credit_limit <= e[5] THEN {BAND.format(a=4, b=5)} END AS limit_band,
  CASE WHEN credit_limit <= e[2] THEN 0 WHEN credit_limit <= e[3] THEN 1 WHEN credit_limit <= e[4] THEN 2
       WHEN credit_limit <= e[5] THEN 3 END AS limit_band_ord,
  CASE WHEN age <= 29 THEN 'Under 30' WHEN age <= 39 THEN '30-39' WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59'
       ELSE '60+' END AS age_band,
  CASE WHEN age <= 29 THEN 0 WHEN age <= 39 THEN 1 WHEN age <= 49 THEN 2 WHEN age <= 59 THEN 3 ELSE 4 END AS age_band_ord
  FROM f2, edges)"""

PANEL = FEATURES + ",\npanel AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT client_id, {k} AS month_index, '{MONTH[k]}' AS month_label, {7 - k} AS month_order, bill_amt_m{k} AS bill_amt, "
    f"pay_amt_m{k} AS pay_amt, CAST(pay_status_m{k} AS DOUBLE) AS pay_status, pay_status_m{k} >= 1 AS is_delinquent, "
    f"bill_amt_m{k} / credit_limit AS utilisation FROM feat" for k in M) + ")"


def on_clients(body: str, ctes: str = "") -> str:
    return f"WITH {CLIENTS}{',' + ctes if ctes else ''} {body}"


def on_clean(body: str, ctes: str = "") -> str:
    return f"WITH {CLEAN}{',' + ctes if ctes else ''} {body}"


def on_features(body: str, ctes: str = "") -> str:
    return f"WITH {FEATURES}{',' + ctes if ctes else ''} {body}"


def on_panel(body: str, ctes: str = "") -> str:
    return f"WITH {PANEL}{',' + ctes if ctes else ''} {body}"


def melted(source: str, columns, key: str = "client_id", extra: str = "") -> str:
    """UNION ALL of (key, extra, feature, value) over the columns, nulls left out."""
    keep = f"{key}, " + (f"{extra}, " if extra else "")
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )
