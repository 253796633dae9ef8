"""Exact quantiles by counting against numpy, with tiny steps to force the search."""

import numpy as np
import pandas as pd
import pytest

from tabwise.operators import quantiles
from tabwise.operators.quantiles import exact_quantiles

RNG = np.random.default_rng(7)
N = 4001
COLUMNS = {
    "wide": np.exp(RNG.normal(0, 60, N)),
    "hot": np.where(RNG.random(N) < 0.4, 7.0, RNG.normal(size=N)),
    "extreme": np.concatenate([[1e308, -1e308], RNG.random(N - 2)]),
    "endless": np.concatenate([[np.inf, -np.inf], RNG.random(N - 2)]),
    "whole": RNG.integers(0, 9, N).astype(float),
    "constant": np.full(N, 3.0),
    "tiny": RNG.random(N) * 5e-324,
}


@pytest.mark.parametrize(
    ("slices", "few", "accuracy"), [(8, 20, 20), (1024, 50_000, 8_000), (2, 0, 100), (64, 500, 8_000)]
)
def test_quantiles(spark, slices, few, accuracy):
    _compare(spark, slices, few, accuracy)


def _compare(spark, slices, few, accuracy):
    frame = pd.DataFrame(COLUMNS)
    names = list(COLUMNS) if slices > 2 else ["hot", "whole"]
    df = spark.createDataFrame(frame[names])
    counts = dict.fromkeys(names, N)
    limits = {c: (float(frame[c].min()), float(frame[c].max())) for c in names}
    probabilities = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, probabilities, counts, limits, slices, few, accuracy)
    for c in names:
        assert got[c] == pytest.approx(list(frame[c].quantile(probabilities)), rel=1e-15), c


def test_bounds_that_miss_are_made_good(spark, monkeypatch):
    wrong = {c: [(-0.5, 0.25), (0.5, 0.75)] for c in COLUMNS}
    monkeypatch.setattr(quantiles, "_bounds", lambda cells, names, *rest: {c: wrong[c] for c in names})
    _compare(spark, 64, 100, 1)


def test_two_passes_over_the_table(spark, monkeypatch):
    """All that follows the sketch and the count reads what lies between the bounds alone."""
    read = []
    counted = quantiles._count_slices
    monkeypatch.setattr(
        quantiles, "_count_slices",
        lambda cells, *rest: read.append(cells.agg({"n": "sum"}).first()[0]) or counted(cells, *rest),
    )
    df = spark.range(100_000).selectExpr("double(id * 7 % 100000) AS x")
    got = exact_quantiles(df, [0.25, 0.5, 0.75], {"x": 100_000}, {"x": (0.0, 99_999.0)})
    assert got == {"x": [24_999.75, 49_999.5, 74_999.25]}
    assert read and max(read) < 2_000


def test_gaps_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "x double")
    assert exact_quantiles(df, [0.5], {"x": 2}, {"x": (1.0, 3.0)}) == {"x": [2.0]}
    assert exact_quantiles(df, [0.5], {"x": 0}, {}) == {}
