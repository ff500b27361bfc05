"""Wide to long: one row per client and month, from a single scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import unpivot
from ledgerlens.roles import Roles, month_label

SCHEMA = (
    "client_id long, month_index int, month_label string, month_order int, bill_amt double, pay_amt double, "
    "pay_status double, is_delinquent boolean, utilisation double"
)


def build_panel(df: DataFrame) -> DataFrame:
    """Long panel; ``month_order`` ascends with time (dense over the months present)."""
    roles = Roles.of(df)
    months = roles.panel_months()
    if not months:
        return df.sparkSession.createDataFrame([], SCHEMA)
    families = {
        "bill_amt": roles.months("bill_amount"),
        "pay_amt": roles.months("payment_amount"),
        "pay_status": roles.months("payment_status"),
    }
    blocks = []
    for order, month in enumerate(sorted(months, reverse=True), start=1):
        block = {"month_index": str(month), "month_label": s.text(month_label(month)), "month_order": str(order)}
        for column, by_month in families.items():
            block[column] = s.value(df, by_month[month]) if month in by_month else "CAST(NULL AS DOUBLE)"
        blocks.append(block)
    limit = s.value(df, roles.one("credit_limit")) if roles.has("credit_limit") else "CAST(NULL AS DOUBLE)"
    key = f"bigint({v.ID})" if v.ID in df.columns else "CAST(NULL AS BIGINT)"
    # one narrow projection first, so the generator carries only what it needs
    base = s.project(df, {"__key": key, "__limit": limit})
    long = unpivot(base, blocks, keep=("__key", "__limit"))
    return long.selectExpr(
        "__key AS client_id", "month_index", "month_label", "month_order", "bill_amt", "pay_amt", "pay_status",
        f"coalesce(pay_status >= {v.DELINQUENT_FROM}, false) AS is_delinquent",
        f"{s.divide('bill_amt', '__limit')} AS utilisation",
    )


def panel_repayment_ratio(panel: DataFrame) -> DataFrame:
    """Lagged repayment ratio on the long panel: payment over the previous month's balance."""
    before = F.lag("bill_amt").over(Window.partitionBy("client_id").orderBy("month_order"))
    return panel.withColumn("prior_bill", before).withColumn(
        "repayment_ratio", F.expr(s.divide("pay_amt", "prior_bill", positive_only=True))
    )
