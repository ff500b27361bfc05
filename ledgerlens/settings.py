"""Analysis settings passed explicitly to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    min_rows: int = 30
    high_utilisation: float = 0.80
    iqr_multiplier: float = 1.5
    warnings: tuple[str, ...] = field(default=())

    @classmethod
    def resolve(cls, **given) -> "Settings":
        """Settings from loose input; an invalid value keeps its default and is reported."""
        rules = {
            "seed": (int, lambda v: v >= 0),
            "min_rows": (int, lambda v: v >= 1),
            "high_utilisation": (float, lambda v: 0 < v <= 5),
            "iqr_multiplier": (float, lambda v: v > 0),
        }
        kept, warnings = {}, []
        for name, value in given.items():
            if name not in rules:
                warnings.append(f"{name}: unknown setting ignored")
                continue
            cast, accept = rules[name]
            try:
                parsed = cast(value)
            except (TypeError, ValueError):
                warnings.append(f"{name}: {value!r} is not a number, default kept")
                continue
            if accept(parsed):
                kept[name] = parsed
            else:
                warnings.append(f"{name}: {value!r} is out of range, default kept")
        return cls(**kept, warnings=tuple(warnings))


DEFAULTS = Settings()
