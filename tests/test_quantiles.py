from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from undertow.operators.quantiles import exact_quantiles, interpolate

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def searched(spark, values, **settings_):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    count = sum(v is not None for v in values)
    return exact_quantiles(frame, {"v": count}, SHARES, **settings_)["v"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=120))
def test_search_equals_sorting(spark, values):
    got = searched(spark, [float(v) for v in values], direct_rows=0, accuracy=4, zone_rows=3)
    assert got == pytest.approx(list(np.quantile(values, SHARES)))


def test_one_value_holds_most_rows(spark):
    values = [5.0] * 900 + [float(v) for v in range(100)]
    got = searched(spark, values, direct_rows=0, accuracy=10, zone_rows=5)
    assert got == pytest.approx(list(np.quantile(values, SHARES)))


def test_direct_and_searched_agree_with_gaps(spark):
    values = [None if i % 7 == 0 else (i * 37 % 101) / 3 for i in range(500)]
    direct = searched(spark, values)
    assert direct == pytest.approx(
        searched(spark, values, direct_rows=0, accuracy=20, zone_rows=10)
    )


def test_no_values(spark):
    assert searched(spark, [None, None]) == [None] * len(SHARES)


def test_interpolation_meets_both_ends():
    assert interpolate(1.25, 2.0, 4.0) == 2.5
    assert interpolate(3.0, 7.0, 7.0) == 7.0
