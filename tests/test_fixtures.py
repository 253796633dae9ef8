"""Small files through the whole analysis, with hand-computed expectations."""

import random

import pytest
from pyspark.sql import functions as F

import tabwise as tw

MESSY = """Booking_ID, Guest  Name ,Amount,Discount,State
BK-7, Ana Lima ,"  €1,200.50",20%,open
BK-8,Noor Aziz,€310,--,closed
BK-9,N/A,€95.25 ,5%,open
BK-7, Ana Lima ,"  €1,200.50",20%,open
BK-10, Ana Lima,-,12%,held
BK-11,Per Holm,null,N/A,closed
BK-12,Ida Berg,"€2,000.00",8%,open
BK-13,Tom Reyes,€44.75,0%,held
BK-14,Mei Tan,€610.00,30%,closed
"""


def roles_of(report):
    return {r.column_name: r.role for r in report.roles}


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("messy")
    (folder / "messy.csv").write_text(MESSY, encoding="utf-8")
    return tw.analyze_path(spark, f"{folder}/messy.csv", out=f"{folder}/report")


def test_messy_audit(messy):
    audit = messy.audit
    assert messy.warnings == []
    assert (audit.original_rows, audit.cleaned_rows, audit.duplicates_removed) == (9, 8, 1)
    assert (audit.missing_before, audit.missing_after) == (5, 0)
    assert audit.currencies == {"Amount": "€"}
    assert audit.percentages == ["Discount"]
    assert audit.identifiers == ["Booking_ID"]
    assert audit.imputed == {
        "Guest Name": "Imputed 1 missing values with mode ('Ana Lima')",
        "Amount": "Imputed 2 missing values with median (610.00)",
        "Discount": "Imputed 2 missing values with median (0.12)",
    }


def test_messy_rows(messy):
    rows = {r["Booking_ID"]: r for r in messy.cleaned.collect()}
    assert len(rows) == 8
    assert rows["BK-9"]["Guest Name"] == "Ana Lima"
    assert rows["BK-10"]["Amount"] == 610.0
    assert rows["BK-9"]["Discount"] == pytest.approx(0.05)


def test_messy_figures(messy):
    figures = {r["label"]: r["formatted_value"] for r in messy.kpis.collect()}
    assert figures["Total Records"] == "8"
    assert figures["Total Amount"] == "€5,480.50"


def test_messy_report(spark, messy, tmp_path):
    path = tw.write_report(messy, str(tmp_path / "r"))
    row = tw.check_report(spark, path).first()
    assert (row["valid"], row["original_rows"], row["cleaned_rows"]) == (True, 9, 8)
    dashboard = spark.read.parquet(f"{path}/dashboard").where("section = 'summary'").collect()
    assert {r["label"]: r["value"] for r in dashboard} == {
        "Total Rows": 8.0, "Total Columns": 5.0, "Duplicate Rows Removed": 1.0, "Missing Values Cleaned": 5.0,
    }


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_report_formats(spark, messy, tmp_path, fmt):
    path = tw.write_report(messy, str(tmp_path / fmt), fmt=fmt)
    row = tw.check_report(spark, path, fmt).first()
    assert (row["valid"], row["cleaned_rows"]) == (True, 8)


def test_report_without_tables(spark, tmp_path):
    row = tw.check_report(spark, str(tmp_path / "none")).first()
    assert not row["valid"] and row["error"].startswith("Output does not exist")
    spark.range(3).write.parquet(str(tmp_path / "some/original_data"))
    row = tw.check_report(spark, str(tmp_path / "some")).first()
    assert row["error"].startswith("Missing required tables: dashboard, cleaned_data")


def test_employee_table(spark, csv):
    draw = random.Random(1)
    lines = ["Employee,Efficiency in Percentage,Attended Calls,Active With Cust,Active Time"]
    for i in range(25):
        lines.append(
            f"EMP_{i:03},{draw.uniform(60, 99):.1f}%,{draw.randint(50, 150)},"
            f"{draw.uniform(200, 400):.1f},{draw.uniform(300, 500):.1f}"
        )
    report = tw.analyze_path(spark, csv("employee.csv", "\n".join(lines)))
    assert roles_of(report) == {
        "Employee": "categorical", "Efficiency in Percentage": "percentage", "Attended Calls": "count",
        "Active With Cust": "measure", "Active Time": "measure",
    }
    assert report.cleaned.agg(F.max("Efficiency in Percentage")).first()[0] < 1
    assert [c.chart_type for c in report.charts] == ["bar", "scatter", "histogram"]


def test_numeric_table(spark, csv):
    draw = random.Random(2)
    lines = ["Sensor_ID,Temperature_C,Pressure_PSI,Vibration_Hz"]
    for i in range(100):
        t = draw.gauss(70, 5)
        lines.append(f"SENS_{i:04},{t:.2f},{1000 + 2 * t:.1f},{draw.uniform(3, 12):.2f}")
    report = tw.analyze_path(spark, csv("numeric.csv", "\n".join(lines)))
    assert roles_of(report)["Sensor_ID"] == "identifier"
    assert roles_of(report)["Vibration_Hz"] == "percentage"
    pairs = {(r[0], r[1]): r[2] for r in report.eda["correlations"].collect()}
    assert pairs["Temperature_C", "Pressure_PSI"] == pytest.approx(1.0, abs=0.01)
    assert all(pairs[a, b] == pairs[b, a] for a, b in pairs) and pairs["Vibration_Hz", "Vibration_Hz"] == 1
    bins = report.eda["distributions"].groupBy("column_name").agg(F.sum("count").alias("n")).collect()
    assert {r["n"] for r in bins} == {100} and len(bins) == 3


def test_category_table(spark, csv):
    lines = ["Ticket_ID,Department,Priority,Rating_Score"]
    for i in range(60):
        lines.append(f"TKT-{i:04},{['Sales', 'Support', 'Product', 'HR', 'IT'][i % 5]},{'LMH'[i % 3]},{i % 5 + 1}")
    report = tw.analyze_path(spark, csv("tickets.csv", "\n".join(lines)))
    assert roles_of(report)["Rating_Score"] == "percentage" or roles_of(report)["Rating_Score"] == "rating"
    assert len(report.charts) >= 2
    top = report.eda["categorical_summaries"].where("column_name = 'Department' and rank = 1").first()
    assert (top["unique_count"], top["value"], top["count"], top["percentage"]) == (5, "HR", 12, 20.0)


def test_tables_like_workbook_sheets(spark):
    text = "a string, b string, c string"
    tables = {
        "Dashboard": spark.createDataFrame([("Total", "5", None)], text),
        "Summary": spark.createDataFrame([("Region", "Sales"), ("North", "10")], "a string, b string"),
        "Raw Data": spark.createDataFrame([(f"T{i}", "2024-01-01", "North") for i in range(50)], text),
        "Report": spark.createDataFrame([("Done",)], "a string"),
    }
    best = tw.rank_tables(tables).where("selected").collect()
    assert [r["table_name"] for r in best] == ["Raw Data"]
    alone = tw.rank_tables({"x": tables["Report"]}).first()
    assert (alone["score"], alone["selected"]) == (100.0, True)
