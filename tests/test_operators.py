"""Edge cases of the operators: gaps, hot values, sparse columns, long texts, odd names."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabwise as tw
from tabwise.operators import cleaning, eda, frames, roles as role_ops
from tabwise.operators.frequency import smallest_modes
from tabwise.operators.profile import profile
from tabwise.operators.samples import first_values
from tabwise.operators.validation import distinct_rows
from tabwise.plans.charts import ChartSpec


def test_profile_equals_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.lognormal(size=500), "b": rng.integers(0, 5, 500).astype(float)})
    frame.loc[::7, "a"] = np.nan
    measured = profile(spark.createDataFrame(frame))
    assert measured.rows == 500 and measured.nulls["a"] == int(frame["a"].isna().sum())
    for c in frame:
        s = measured.numeric[c]
        assert s.mean == pytest.approx(frame[c].mean())
        assert s.std == pytest.approx(frame[c].std())
        assert s.skewness == pytest.approx(frame[c].skew())


def test_profile_totals_do_not_drift(spark):
    rng = np.random.default_rng(4)
    prices = np.round(rng.uniform(-1e8, 1e9, 300_000), 2)
    df = spark.createDataFrame(pd.DataFrame({"price": prices, "rate": prices / 1e12}))
    for parts in (1, 7):
        found = profile(df.repartition(parts)).numeric
        assert found["price"].total == math.fsum(prices)
        assert found["price"].mean == math.fsum(prices) / len(prices)
        assert found["rate"].total == pytest.approx(math.fsum(prices / 1e12), rel=1e-12)
    far = profile(spark.createDataFrame([(math.inf, -2.5), (1.0, 2.5)], "a double, b double")).numeric
    assert (far["a"].total, far["a"].mean, far["b"].total) == (math.inf, math.inf, 0.0)


def test_profile_of_little(spark):
    one = profile(spark.createDataFrame([(2.0, None)], "a double, b double"))
    assert (one.numeric["a"].std, one.numeric["a"].skewness, "b" in one.numeric) == (0.0, 0.0, False)
    none = profile(spark.createDataFrame([], "a double, t string"))
    assert (none.rows, none.nulls) == (0, {"a": 0, "t": 0})


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, t string")
    assert tw.validate(df).where("fully_empty").count() == 2
    assert tuple(tw.table_summary(df).first()) == (0, 2, 0, 0)
    assert tw.describe_numeric(df).count() == 0


def test_equal_rows_with_gaps_and_signed_zero(spark):
    rows = [(0.0, None, "x"), (-0.0, None, "x"), (float("nan"), "a", "x"), (None, "a", "x"), (1.0, "a", "x")]
    assert distinct_rows(spark.createDataFrame(rows, "a double, b string, c string")) == 3


def test_long_texts_are_told_apart(spark):
    base = "x" * 5000
    digest = "#" + hashlib.sha256(base.encode()).hexdigest()
    df = spark.createDataFrame([(base,), (base,), (base + "y",), (digest,), (None,)], "t string")
    assert distinct_rows(df) == 4
    rows = tw.top_categories(df).orderBy("rank").collect()
    assert rows[0]["value"] == base and rows[0]["count"] == 2
    assert {r["value"] for r in rows} == {base, base + "y", digest}
    assert rows[0]["unique_count"] == 3


def test_hot_value_counts(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    row = tw.top_categories(df).where("rank = 1").first()
    assert (row["value"], row["count"], row["unique_count"]) == ("hot", 10_000, 20_001)
    assert smallest_modes(df, ["t"]) == {"t": "hot"}


def test_modes_of_long_texts_equal_brute_force(spark):
    x, y, z = "x" * 80, "é" * 90, "x" * 79 + "w" * 30
    columns = {
        "one_long": [x, x, "short", y, None],
        "tied_long": [y, y, x, x, z],
        "short_and_long": [z, z, "a", "a", None],
        "short_wins_not": ["z", "z", x, x, None],
        "all_differ": [y, x, z, "y" * 70, None],
        "no_value": [None] * 5,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns))
    wanted = {}
    for c, values in columns.items():
        counts = Counter(v for v in values if v is not None)
        if counts:
            wanted[c] = min(v for v, n in counts.items() if n == max(counts.values()))
    assert smallest_modes(df.repartition(3), list(columns)) == wanted


def test_first_values_of_sparse_columns(spark):
    df = spark.range(0, 20_000, 1, 16).select(
        "id", F.when(F.col("id") % 100 == 99, F.col("id")).alias("sparse"), F.lit(None).cast("string").alias("none")
    )
    for order in (None, "id"):
        rows = first_values(df, 50, order).collect()
        sparse = [r["value"] for r in sorted(rows, key=lambda r: r["position"]) if r["column_name"] == "sparse"]
        assert sparse == [str(100 * i + 99) for i in range(50)]
        assert sum(r["column_name"] == "id" for r in rows) == 50
        assert not any(r["column_name"] == "none" for r in rows)


def test_first_rows_by_key_with_gaps_and_ties(spark):
    df = spark.range(0, 5000, 1, 8).select((F.lit(4999) - F.col("id")).alias("k"))
    assert [r["k"] for r in frames.first_rows(df, 3, "k").collect()] == [0, 1, 2]
    same = df.select(F.lit(1).alias("k"))
    assert frames.first_rows(same, 10, "k").count() == 10
    gaps = df.select(F.when(F.col("k") > 2, F.col("k")).alias("k"))
    assert [r["k"] for r in frames.first_rows(gaps, 5, "k").collect()] == [None, None, None, 3, 4]


def test_names_that_become_equal(spark):
    with pytest.raises(ValueError, match="equal after normalisation"):
        cleaning.normalise_names(spark.createDataFrame([(1, 2)], "`a  b` int, `a b ` int"))


def test_odd_names_survive(spark):
    rows = [(f"r{i}", float(i), f"c{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "`a.b` string, `x ``y` double, `p,q;{}` string")
    report = tw.analyze(spark, df)
    assert report.warnings == []
    assert report.cleaned.columns == ["a.b", "x `y", "p,q;{}"]


def test_all_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "-", None, None)], "n int, t string, d timestamp_ntz, id string")
    cleaned, audit = tw.clean(df)
    assert [tuple(r) for r in cleaned.orderBy("n").collect()] == [(1, 0.0, None, "Unknown"), (2, 0.0, None, "Unknown")]
    assert audit.imputed["t"] == "Imputed 2 missing values with median (0.00)"
    assert audit.missing_after == 2


def test_boolean_and_whole_number_gaps(spark):
    df = spark.createDataFrame([(1, True), (None, None), (3, True), (8, False)], "n bigint, b boolean")
    cleaned, _ = tw.clean(df)
    assert sorted(tuple(r) for r in cleaned.collect()) == [(1.0, True), (3.0, True), (3.0, True), (8.0, False)][:1] + [(3.0, True), (8.0, False)]


def test_date_columns(spark):
    rows = [("2024-01-05", 20240105), ("13/01/2024", 20240106), ("x", 20240107), ("2024-01-05", 20240108)]
    cleaned, audit = tw.clean(spark.createDataFrame(rows, "order_date string, ship_date bigint"))
    assert dict(cleaned.dtypes) == {"order_date": "timestamp_ntz", "ship_date": "timestamp_ntz"}
    assert audit.to_datetime == ["order_date", "ship_date"]
    assert audit.imputed["order_date"] == "Imputed 1 missing dates with mode (2024-01-05 00:00:00)"
    kept, audit = tw.clean(spark.createDataFrame([(5,), (7,)], "due_date bigint"))
    assert dict(kept.dtypes) == {"due_date": "bigint"} and audit.to_datetime == []


def test_free_text_guard(spark):
    rows = [("up 5% today",), ("all calm",), ("nothing",)]
    df = spark.createDataFrame(rows, "note string")
    kept, _ = tw.clean(df)
    assert sorted(r["note"] for r in kept.collect()) == sorted(r[0] for r in rows)


def test_one_sign_among_many_texts(spark):
    text = F.when(F.col("id") == 3, F.lit("up 5%")).otherwise(F.concat(F.lit("note "), F.col("id")))
    kept, audit = tw.clean(spark.range(2000).select(text.alias("note")))
    assert audit.percentages == [] and kept.filter("note = 'up 5%'").count() == 1 and kept.count() == 2000


def test_currency_signs_after_plain_values(spark):
    text = F.when(F.col("id") >= 50, F.concat(F.lit("$"), F.col("id"))).otherwise(F.col("id").cast("string"))
    converted, audit = tw.clean(spark.range(2000).select(text.alias("paid")))
    assert audit.currencies == {"paid": "$"}
    assert converted.agg(F.sum("paid")).first()[0] == sum(range(2000))


def test_scatter_text_and_draw(spark):
    points = spark.range(5000).select(
        (F.col("id") * 3).alias("whole"), (F.col("id") + 12345678.5).alias("large"), F.col("id").cast("double").alias("y")
    )

    def drawn(df, x):
        rows = tw.chart_data(df, ChartSpec("c", "scatter", "", x, "y", "raw", "")).collect()
        return [(r["category"], r["value"]) for r in rows]

    whole = drawn(points.repartition(3), "whole")
    assert len(whole) == 100 and whole == drawn(points.repartition(5), "whole")
    assert all(c == str(int(y) * 3) for c, y in whole)
    assert all(c == f"{y + 12345678.5:.1f}" for c, y in drawn(points, "large"))


def test_percent_numbers(spark):
    cleaned, audit = tw.clean(spark.createDataFrame([(50.0, 0.5, 500.0), (100.0, 1.0, 7.0)], "a_pct double, b_pct double, c_pct double"))
    assert audit.percentages == ["a_pct"]
    assert sorted(r["a_pct"] for r in cleaned.collect()) == [0.5, 1.0]


def test_analysis_decides_roles_by_whole_columns(spark):
    late = F.col("id") >= 600
    df = spark.range(0, 4000, 1, 4).select(
        F.when(late, F.concat(F.lit("$"), F.col("id").cast("string"))).otherwise(F.lit("7")).alias("amount"),
        F.when(late, F.concat(F.lit("word "), F.col("id").cast("string"))).otherwise(F.lit("7")).alias("note"),
        F.when(F.col("id") == 3999, F.lit("5% of all")).otherwise(F.lit("plain")).alias("words"),
        F.least("id", F.lit(900)).alias("level"),
    )
    report = tw.analyze(spark, df)
    raw = {r.column_name: r for r in report.raw_roles}
    assert not report.warnings
    assert (raw["amount"].role, raw["amount"].currency_symbol) == ("currency", "$")
    assert raw["note"].role == "categorical" and raw["words"].role == "categorical"
    assert raw["level"].unique_count == 901
    assert {r.column_name: r.unique_count for r in report.roles}["level"] == 901
    sampled = {r.column_name: r for r in tw.analyze(spark, df, role_sample=500).raw_roles}
    assert sampled["amount"].currency_symbol is None and sampled["level"].unique_count == 500


def test_roles_of_the_cleaned_head_when_rows_repeat(spark):
    df = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") < 30_000, F.lit(0)).otherwise(F.col("id")).alias("n")
    )
    plan = cleaning.plan_cleaning(df)
    head = cleaning.cleaned_head(df, plan, 500)
    assert [r["n"] for r in head.collect()] == [0, *range(30_000, 30_499)]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("n", [5, 40, 512, 600])
def test_histogram_equals_numpy(spark, whole, n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 8, n) if whole else rng.gamma(2.0, size=n)
    df = spark.createDataFrame(pd.DataFrame({"x": data}))
    counts, edges = np.histogram(data, bins="auto")
    if len(counts) > 10:
        counts, edges = np.histogram(data, bins=10)
    got = tw.histograms(df).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(counts)
    assert [r["bin_left"] for r in got] == [round(float(e), 2) for e in edges[:-1]]


def test_histogram_needs_three_values(spark):
    assert tw.histograms(spark.createDataFrame([(i % 2,) for i in range(20)], "x int")).count() == 0


def test_bin_edges():
    assert eda.bin_edges(2.0, 2.0, 8)[0] == 1.5 and eda.bin_edges(2.0, 2.0, 8)[-1] == 2.5
    assert eda.bin_edges(0.0, 1.0, 4) == list(np.linspace(0, 1, 5))


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, 300)
    frame = pd.DataFrame({"a": x, "b": x + rng.normal(size=300), "c": rng.normal(size=300), "d": 1.0})
    frame.loc[::3, "b"] = np.nan
    frame.loc[frame.index % 3 != 0, "c"] = np.nan
    frame["e"] = np.where(frame["b"].isna(), rng.normal(size=300), 2.0)
    got = {(r[0], r[1]): r[2] for r in tw.correlations(spark.createDataFrame(frame)).collect()}
    want = frame[["a", "b", "c", "e"]].corr()
    assert {a for a, _ in got} == {"a", "b", "c", "e"}
    for a, b in got:
        expected = 0.0 if math.isnan(want.loc[a, b]) else round(want.loc[a, b], 3)
        assert got[a, b] == pytest.approx(expected, abs=0.0011), (a, b)


def test_many_columns(spark):
    wide = spark.range(200).select(*[(F.col("id") * i % 17).cast("double").alias(f"m{i}") for i in range(1, 41)])
    assert tw.correlations(wide).count() == sum(1 for i in range(1, 41) if i % 17) ** 2
    assert tw.describe_numeric(wide).count() == 40


def test_wide_correlations_equal_pandas(spark, monkeypatch):
    """Values of wide tables are read for the correlations alone, not for the roles of all columns."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 1))
    frame = pd.DataFrame(rng.normal(size=(400, 30)) + base * rng.normal(size=30), columns=[f"m{i}" for i in range(30)])
    frame["m1"] += 1e7
    for i in range(0, 30, 4):
        frame.loc[i::5, f"m{i}"] = np.nan
    frame["m8"] = frame["m8"].where(frame.index < 3)
    frame["row_id"], frame["serial"], frame["flat"] = np.arange(400), np.arange(400), 1.0
    df = spark.createDataFrame(frame).withColumns(
        {
            "whole": F.when(F.col("m4") > 0, F.col("row_id") % 7),
            "yes": F.when(F.col("m5") > -1, F.col("m6") > 0),
            "exact": F.col("m7").cast("decimal(20, 4)"),
            "nothing": F.lit(None).cast("double"),
        }
    )
    seen = []
    evidence = role_ops.whole_evidence
    monkeypatch.setattr(role_ops, "whole_evidence", lambda d, *a: seen.extend(d.columns) or evidence(d, *a))
    got = {(r[0], r[1]): r[2] for r in tw.correlations(df).collect()}
    assert seen == ["serial"]
    local = df.drop("row_id", "serial", "flat", "nothing").toPandas().astype(float)
    want = local.corr(min_periods=1)
    assert set(got) == {(a, b) for a in local for b in local}
    for a, b in got:
        expected = 1.0 if a == b else 0.0 if math.isnan(want.loc[a, b]) else round(want.loc[a, b], 3)
        assert got[a, b] == pytest.approx(expected, abs=0.0011), (a, b)


def spec(kind, x, y=None, how="sum"):
    return ChartSpec("c", kind, "", x, y, how, "")


def test_chart_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 3.0), (None, 9.0), ("c", None)], "k string, v double")
    bars = tw.chart_data(df, spec("bar", "k", "v")).collect()
    assert [(r["category"], r["value"]) for r in bars] == [("b", 5.0), ("a", 4.0)]
    means = tw.chart_data(df, spec("bar", "k", "v", "top10_mean")).collect()
    assert [(r["category"], r["value"]) for r in means] == [("b", 5.0), ("a", 2.0)]
    for nothing in (spec("bar", "none", "v"), spec("line", "k", "v"), spec("histogram", "k")):
        assert [(r["category"], r["value"]) for r in tw.chart_data(df, nothing).collect()] == [("No Data", 0.0)]
    flat = tw.chart_data(df.select(F.lit(2.0).alias("v")), spec("histogram", "v")).collect()
    counts, _ = np.histogram([2.0] * 5, bins=8)
    assert [r["value"] for r in flat] == list(counts)


def test_scatter_without_key_keeps_small_tables_whole(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert tw.chart_data(df, spec("scatter", "x", "y", "raw")).count() == 40
    big = spark.range(4000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert tw.chart_data(big, spec("scatter", "x", "y", "raw")).count() == 100


def test_failing_stage_is_reported(spark, monkeypatch):
    monkeypatch.setattr("tabwise.analysis.describe", lambda *a: 1 / 0)
    with pytest.warns(UserWarning, match="statistics"):
        report = tw.analyze(spark, spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, t string"))
    assert report.eda == {} and report.kpis.count() >= 1


def test_tuned_session_is_restored(spark, monkeypatch):
    names = [frames._PARTITIONS, frames._METHOD_LIMIT]
    before = [spark.conf.get(n, None) for n in names]
    monkeypatch.setattr(frames, "PARTITION_BYTES", 8)
    with frames.tuned(spark.range(1000)):
        assert int(spark.conf.get(names[0])) > 8 and spark.conf.get(names[1]) == "8000"
    assert [spark.conf.get(n, None) for n in names] == before


def test_evidence_of_all_values(spark):
    """Few and many values, long texts with signs, and a weak identifier's name."""
    from tabwise.operators.roles import role_evidence

    long = "1" * 70
    rows = [
        (f"{i}%" if i % 10 else "none", f"n{i}", "7 %" + long if i % 2 else long, f"2024-01-{1 + i % 28:02d}", i, i % 3)
        for i in range(1, 3001)
    ]
    df = spark.createDataFrame(rows, "share string, serial_no string, digits string, day string, number bigint, small int")
    found = {r["column_name"]: r for r in role_evidence(df).collect()}
    assert (found["share"]["distinct"], found["share"]["has_percent"], found["share"]["numbers"]) == (None, True, 2700)
    assert found["serial_no"]["nearly_unique"] and found["serial_no"]["distinct"] is None
    assert (found["digits"]["distinct"], found["digits"]["numbers"], found["digits"]["has_percent"]) == (2, 1500, False)
    assert (found["day"]["distinct"], found["day"]["dates"], found["day"]["dated"]) == (28, 3000, 3000)
    assert found["number"]["nearly_unique"] and not found["small"]["nearly_unique"]
    roles = {r["column_name"]: r for r in tw.detect_roles(df).collect()}
    assert [roles[c]["role"] for c in df.columns] == [
        "percentage", "identifier", "categorical", "datetime", "identifier", "numeric",
    ]
    assert roles["number"]["unique_count"] is None and roles["small"]["unique_count"] == 3
