import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions import pvalues, scalars as s, text
from ledgerlens.settings import Settings


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} double" for c in columns)) if columns else spark.range(1)
    return row.selectExpr(f"{expression} AS x").first()[0]


def test_nan_and_infinities_become_null(spark):
    rows = spark.sql("SELECT * FROM VALUES (double('NaN')), (double('Infinity')), (double('-Infinity')), (1.5D), (null) AS t(a)")
    assert [r[0] for r in rows.selectExpr(s.finite("a")).collect()] == [None, None, None, 1.5, None]


@pytest.mark.parametrize("given_text, wanted", [(" 12 ", 12.0), ("1,000", None), ("12d", None), ("NaN", None), ("-3.5e2", -350.0), ("", None), (".5", 0.5)])
def test_text_to_number(spark, given_text, wanted):
    rows = spark.createDataFrame([(given_text,)], "a string")
    assert rows.selectExpr(s.parse_number("a")).first()[0] == wanted


def test_division_never_raises_or_overflows(spark):
    assert value(spark, s.divide("a", "b"), a=5.0, b=0.0) is None
    assert value(spark, s.divide("a", "b"), a=5.0, b=2.0) == 2.5
    assert value(spark, s.divide("a", "b", positive_only=True), a=5.0, b=-2.0) is None
    assert value(spark, s.divide("a", "b", invalid=(7.0,)), a=5.0, b=7.0) is None
    assert value(spark, s.divide("a", "b"), a=1e308, b=1e-10) is None


def test_row_aggregates_skip_nulls(spark):
    row = spark.createDataFrame([(1.0, None, 4.0, 10.0), (None, None, None, None)], "a double, b double, c double, d double")
    xs = ["a", "b", "c", "d"]
    out = row.selectExpr(f"{s.row_mean(xs)} m", f"{s.row_median(xs)} md", f"{s.row_sum(xs)} t", f"{s.row_max(xs)} mx", f"{s.row_slope(xs)} sl").collect()
    assert out[0]["m"] == 5.0 and out[0]["md"] == 4.0 and out[0]["t"] == 15.0 and out[0]["mx"] == 10.0
    assert math.isclose(out[0]["sl"], np.polyfit([1, 3, 4], [1, 4, 10], 1)[0])
    assert out[1].asDict() == {"m": None, "md": None, "t": 0.0, "mx": None, "sl": None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=6, max_size=6))
def test_row_statistics_match_numpy(spark, numbers):
    names = list("abcdef")
    row = spark.createDataFrame([tuple(numbers)], ", ".join(f"{n} double" for n in names))
    out = row.selectExpr(f"{s.row_mean(names)} m", f"{s.row_median(names)} md", f"{s.row_slope(names)} sl").selectExpr("*").first()
    present = [x for x in numbers if x is not None]
    if not present:
        assert out["m"] is None and out["md"] is None
        return
    assert math.isclose(out["m"], np.mean(present), rel_tol=1e-9, abs_tol=1e-6)
    assert math.isclose(out["md"], np.median(present), rel_tol=1e-9, abs_tol=1e-6)
    if len(present) >= 2:
        at = [i + 1 for i, x in enumerate(numbers) if x is not None]
        assert math.isclose(out["sl"], np.polyfit(at, present, 1)[0], rel_tol=1e-6, abs_tol=1e-3)
    else:
        assert out["sl"] is None


def test_bands_are_right_closed(spark):
    label, place = s.right_closed("x", [("low", 0, 29), ("mid", 29, 39)], lowest_included=True)
    rows = spark.createDataFrame([(0.0,), (29.0,), (29.5,), (39.0,), (40.0,), (None,)], "x double")
    assert [(r[0], r[1]) for r in rows.selectExpr(f"{label} l", f"{place} p").collect()] == [
        ("low", 0), ("low", 0), ("mid", 1), ("mid", 1), (None, None), (None, None)]


@pytest.mark.parametrize("expression, wanted", [
    (text.currency("167484.32D"), "NT$167,484"), (text.currency_compact("5024529900D"), "NT$5.02B"), (text.currency_compact("-1500D"), "-NT$1.50K"),
    (text.integer("1234.5D"), "1,235"), (text.integer("-2.5D"), "-3"), (text.decimal("12.345D", 2, "%"), "12.35%"),
    (text.currency("double('NaN')"), "n/a"), (text.decimal("double(null)"), "n/a"), (text.by_format("3D", "'months'"), "3.00 months"),
])
def test_display_text(spark, expression, wanted):
    assert value(spark, expression) == wanted


def test_p_values_against_published_tables():
    assert math.isclose(pvalues.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert math.isclose(pvalues.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(pvalues.chi2_upper(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(pvalues.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(pvalues.t_two_sided(12.706204736432095, 1), 0.05, rel_tol=1e-8)
    assert pvalues.correlation_p(1.0, 10) == 0.0 and math.isnan(pvalues.correlation_p(0.5, 2))


def test_invalid_settings_keep_their_defaults():
    got = Settings.resolve(min_rows="0", high_utilisation="abc", iqr_multiplier=2, colour="red")
    assert (got.min_rows, got.high_utilisation, got.iqr_multiplier) == (30, 0.8, 2.0)
    assert len(got.warnings) == 3
