"""Display text of numbers, as SQL text over small result tables."""

from __future__ import annotations

from ledgerlens.vocabulary import CURRENCY

SCALES = (("1e12D", "T"), ("1e9D", "B"), ("1e6D", "M"), ("1e3D", "K"))


def _or_na(x: str, body: str) -> str:
    return f"IF(abs({x}) < double('Infinity'), {body}, 'n/a')"


def _sign(x: str) -> str:
    return f"IF({x} < 0, '-', '')"


def currency(x: str, symbol: str = CURRENCY) -> str:
    return _or_na(x, f"concat({_sign(x)}, '{symbol}', format_number(abs({x}), 0))")


def currency_compact(x: str, symbol: str = CURRENCY) -> str:
    arms = " ".join(
        f"WHEN abs({x}) >= {scale} THEN concat(format_number(abs({x}) / {scale}, 2), '{suffix}')" for scale, suffix in SCALES
    )
    return _or_na(x, f"concat({_sign(x)}, '{symbol}', CASE {arms} ELSE format_number(abs({x}), 0) END)")


def integer(x: str) -> str:
    """Halves round away from zero."""
    return _or_na(x, f"format_number(CAST(IF({x} >= 0, floor({x} + 0.5D), ceil({x} - 0.5D)) AS BIGINT), 0)")


def decimal(x: str, places: int = 2, suffix: str = "", grouped: bool = False) -> str:
    body = f"format_number({x}, {places})" if grouped else f"format_string('%.{places}f', {x})"
    return _or_na(x, f"concat({body}, '{suffix}')")


def by_format(x: str, fmt: str) -> str:
    """Text chosen by a format-name column."""
    return (
        f"CASE {fmt} WHEN 'integer' THEN {integer(x)} WHEN 'currency' THEN {currency(x)} "
        f"WHEN 'currency_compact' THEN {currency_compact(x)} WHEN 'percentage' THEN {decimal(x, 2, '%')} "
        f"WHEN 'ratio' THEN {decimal(x, 2, 'x')} WHEN 'months' THEN {decimal(x, 2, ' months')} "
        f"ELSE {decimal(x, 2, grouped=True)} END"
    )
