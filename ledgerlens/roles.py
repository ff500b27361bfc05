"""Which columns of a DataFrame play which part, found by name only.

Reading ``df.columns`` needs no Spark job, so a registry can be rebuilt after
every stage for free.
"""

from __future__ import annotations

from dataclasses import dataclass

from ledgerlens import vocabulary as v

SINGLE = {
    "client_id": ("client_id",),
    "age": ("age",),
    "sex": ("sex", "sex_code"),
    "education": ("education", "education_code"),
    "marriage": ("marriage", "marriage_code"),
    "credit_limit": ("credit_limit",),
    "target": ("default_next_month",),
    "limit_band": ("limit_band",),
    "age_band": ("age_band",),
}
MONTHLY = {
    "bill_amount": "bill_amt_m",
    "payment_amount": "pay_amt_m",
    "payment_status": "pay_status_m",
    "utilisation": "utilisation_m",
    "repayment_ratio": "repayment_ratio_m",
}
SUMMARIES = {
    "utilisation": ("utilisation_latest", "utilisation_mean_6m", "utilisation_max_6m"),
    "repayment_ratio": ("repayment_ratio_mean",),
    "delinquency": (
        "delinquent_months_count",
        "max_delinquency",
        "current_delinquency",
        "ever_delinquent",
    ),
}


def month_number(column: str, prefix: str) -> int | None:
    tail = column[len(prefix):] if column.startswith(prefix) else ""
    return int(tail) if tail.isdigit() else None


def month_label(month: int) -> str:
    return v.MONTH_LABELS.get(month, f"Month {month}")


@dataclass(frozen=True)
class Roles:
    columns: tuple[str, ...]
    found: dict[str, tuple[str, ...]]

    @classmethod
    def of(cls, df) -> "Roles":
        """Roles of a DataFrame (or of a plain list of names)."""
        names = tuple(df.columns if hasattr(df, "columns") else df)
        found: dict[str, list[str]] = {}
        for role, options in SINGLE.items():
            hit = next((name for name in options if name in names), None)
            if hit:
                found[role] = [hit]
        for role, prefix in MONTHLY.items():
            months = {month_number(name, prefix): name for name in names if month_number(name, prefix) is not None}
            if months:
                found[role] = [months[m] for m in sorted(months)]
        for role, options in SUMMARIES.items():
            present = [name for name in options if name in names]
            if present:
                found[role] = found.get(role, []) + present
        return cls(names, {role: tuple(cols) for role, cols in found.items()})

    def has(self, *roles: str) -> bool:
        return all(role in self.found for role in roles)

    def has_any(self, *roles: str) -> bool:
        return any(role in self.found for role in roles)

    def one(self, role: str) -> str | None:
        return self.found[role][0] if role in self.found else None

    def all(self, role: str) -> tuple[str, ...]:
        return self.found.get(role, ())

    def missing(self, *roles: str) -> tuple[str, ...]:
        return tuple(role for role in roles if role not in self.found)

    def months(self, role: str) -> dict[int, str]:
        """Month number -> column for a monthly role, newest month first."""
        prefix = MONTHLY[role]
        numbered = {month_number(name, prefix): name for name in self.all(role)}
        return {m: numbered[m] for m in sorted(k for k in numbered if k is not None)}

    def panel_months(self) -> list[int]:
        families = ("bill_amount", "payment_amount", "payment_status")
        return sorted({m for role in families for m in self.months(role)})

    def absent(self) -> dict[str, str]:
        return {role: why for role, why in v.ABSENT_ROLES.items() if role not in self.found}


def describe(column: str) -> str:
    """Meaning of a column, from the fixed descriptions."""
    if column in v.COLUMN_MEANINGS:
        return v.COLUMN_MEANINGS[column]
    for prefix, text in v.PANEL_MEANINGS.items():
        month = month_number(column, prefix)
        if month is not None:
            return text.format(month=month_label(month))
    if column.endswith("_was_missing"):
        return f"{column.removesuffix('_was_missing')} was null in the source and has been filled."
    return "No description is registered for this column."
