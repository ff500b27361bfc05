"""Column names, code labels, thresholds and bands.

Everything in this module is a plain constant.  The values follow the public
"default of credit card clients" data description and the contract this library
has to honour; nothing here computes anything.
"""

from __future__ import annotations

ID = "client_id"
TARGET = "default_next_month"
UNKNOWN = "Unknown"
CURRENCY = "NT$"

# --- fixed values: source header -> canonical column -------------------------
SOURCE_HEADERS = {
    "ID": "client_id",
    "LIMIT_BAL": "credit_limit",
    "SEX": "sex_code",
    "EDUCATION": "education_code",
    "MARRIAGE": "marriage_code",
    "AGE": "age",
    "PAY_0": "pay_status_m1",
    "PAY_1": "pay_status_m1",
    "PAY_2": "pay_status_m2",
    "PAY_3": "pay_status_m3",
    "PAY_4": "pay_status_m4",
    "PAY_5": "pay_status_m5",
    "PAY_6": "pay_status_m6",
    "BILL_AMT1": "bill_amt_m1",
    "BILL_AMT2": "bill_amt_m2",
    "BILL_AMT3": "bill_amt_m3",
    "BILL_AMT4": "bill_amt_m4",
    "BILL_AMT5": "bill_amt_m5",
    "BILL_AMT6": "bill_amt_m6",
    "PAY_AMT1": "pay_amt_m1",
    "PAY_AMT2": "pay_amt_m2",
    "PAY_AMT3": "pay_amt_m3",
    "PAY_AMT4": "pay_amt_m4",
    "PAY_AMT5": "pay_amt_m5",
    "PAY_AMT6": "pay_amt_m6",
    "default payment next month": "default_next_month",
    "default.payment.next.month": "default_next_month",
}
EXPECTED_ROWS = 30_000
EXPECTED_COLUMNS = 25
PANEL_MONTHS = 6

# --- fixed values: month number -> label (1 is the newest) -------------------
MONTH_LABELS = {
    1: "Sep 2005",
    2: "Aug 2005",
    3: "Jul 2005",
    4: "Jun 2005",
    5: "May 2005",
    6: "Apr 2005",
}

# --- fixed values: code -> label ---------------------------------------------
SEX_LABELS = {1: "Male", 2: "Female"}
EDUCATION_LABELS = {1: "Graduate school", 2: "University", 3: "High school", 4: "Others"}
MARRIAGE_LABELS = {1: "Married", 2: "Single", 3: "Others"}
PAY_STATUS_LABELS = {
    -2: "No transaction (undocumented code)",
    -1: "Paid in full",
    0: "Revolving credit used (undocumented code)",
    1: "1 month delay",
    2: "2 months delay",
    3: "3 months delay",
    4: "4 months delay",
    5: "5 months delay",
    6: "6 months delay",
    7: "7 months delay",
    8: "8 months delay",
    9: "9+ months delay",
}
TARGET_LABELS = {0: "No default", 1: "Default"}

#: code column -> (label column, documented labels, known but undocumented codes)
CODED_COLUMNS = {
    "sex_code": ("sex", SEX_LABELS, ()),
    "education_code": ("education", EDUCATION_LABELS, (0, 5, 6)),
    "marriage_code": ("marriage", MARRIAGE_LABELS, (0,)),
}
PAY_STATUS_UNDOCUMENTED = (-2, 0)
DELINQUENT_FROM = 1
AGE_RANGE = (18, 100)

# --- fixed values: feature thresholds and bands ------------------------------
FULL_PAYER_FROM = 0.95
REVOLVER_BELOW = 0.30
RATIO_CAP = 2.0
AGE_BANDS = (
    ("Under 30", 0, 29),
    ("30-39", 29, 39),
    ("40-49", 39, 49),
    ("50-59", 49, 59),
    ("60+", 59, 200),
)
DELAY_GROUPS = (
    ("No delay", -0.5, 0.5),
    ("1 month", 0.5, 1.5),
    ("2 months", 1.5, 2.5),
    ("3+ months", 2.5, 100.0),
)
DELINQUENCY_TRENDS = ("Improving", "Stable", "Worsening")
LIMIT_BANDS = 4
EXTREME_FENCE = 3.0

# --- fixed values: statistics labels -----------------------------------------
WEAK, MODERATE, STRONG = 0.10, 0.30, 0.50
FLAT_TREND_PCT = 2.0
ANOMALY_Z = 2.0
ANOMALY_MODIFIED_Z = 3.5
MODIFIED_Z_SCALE = 0.6745
MAD_SCALE = 1.4826

# --- fixed values: quality score weights and bands ---------------------------
QUALITY_WEIGHTS = {"completeness": 30.0, "uniqueness": 20.0, "validity": 35.0, "consistency": 15.0}

# --- fixed values: columns that restate the same measure ---------------------
DERIVATION_FAMILIES = {
    "balance": ("bill_amt_m", "avg_bill_6m", "bill_volatility", "bill_trend_slope", "balance_growth_6m"),
    "payment": ("pay_amt_m", "total_paid_6m", "avg_payment_6m"),
    "delinquency": (
        "pay_status_m",
        "delinquent_months_count",
        "max_delinquency",
        "current_delinquency",
        "ever_delinquent",
        "is_currently_delinquent",
        "delinquency_trend",
    ),
    "utilisation": ("utilisation_", "is_high_utilisation", "is_over_limit"),
    "repayment_ratio": ("repayment_ratio_", "is_full_payer", "is_revolver", "months_zero_payment"),
    "credit_limit": ("credit_limit",),
}
FAMILY_DEPENDENCIES = {
    "utilisation": ("balance", "credit_limit"),
    "repayment_ratio": ("payment", "balance"),
}

# --- fixed values: roles this kind of data cannot supply ---------------------
ABSENT_ROLES = {
    "income": "There is no income column; a credit limit is shown as a limit, never as income.",
    "savings": "There is no savings column, so a savings rate cannot be computed.",
    "expenses": "There is no expenses column, so an expense ratio cannot be computed.",
    "credit_score": "There is no bureau credit score column.",
    "employment": "There is no employment status column.",
    "loan_amount": "Revolving card accounts carry no loan amount or term.",
    "date": "There is no calendar date column; the six months are an ordinal panel.",
}

COLUMN_MEANINGS = {
    "client_id": "Surrogate client key; used to join and count only.",
    "credit_limit": "Revolving credit granted, in NT$. A limit, not an income.",
    "sex_code": "Sex as an integer code (1 male, 2 female).",
    "sex": "Label of sex_code.",
    "education_code": "Education level code; 1-4 documented, 0, 5 and 6 not.",
    "education": "Label of education_code; undocumented codes are Unknown.",
    "marriage_code": "Marital status code; 1-3 documented, 0 not.",
    "marriage": "Label of marriage_code; undocumented codes are Unknown.",
    "age": "Age in years at extract time.",
    "default_next_month": "Observed outcome: 1 when the next payment was missed.",
    "is_duplicate_excluding_id": "Row equals another one once the key is ignored.",
    "has_negative_balance": "At least one month ended in credit.",
    "has_extreme_value": "At least one amount lies outside the extreme fence.",
    "age_is_implausible": "Age lies outside 18-100.",
    "credit_limit_original": "Credit limit before unusable values were set to null.",
}
PANEL_MEANINGS = {
    "bill_amt_m": "Statement balance of {month} in NT$; negative means in credit.",
    "pay_amt_m": "Amount paid during {month} in NT$; settles the month before.",
    "pay_status_m": "Repayment status of {month}; 1 or more counts months of delay.",
}
