"""File checks, loading and typing."""

import os

import pytest
from pyspark.sql import functions as F

import tabwise as tw
from tabwise.functions import parse
from tabwise.sources import load
from tabwise.sources.audit import Limits
from tabwise.sources.records import records


def verdicts(spark, path, **limits):
    rows = tw.audit_files(spark, str(path), Limits(**limits)).collect()
    return {r["path"].rsplit("/", 1)[-1]: r for r in rows}


def test_audit(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b,c\n1,2,3\n\n4,5,6\n")
    (tmp_path / "sem i.csv").write_text("a;b\n1;2\n")
    (tmp_path / "tabs.csv").write_text("a\tb\tc\td\r\n1\t2\t3\t4\r\n")
    (tmp_path / "latin.csv").write_bytes("naïve,b\né,2\n".encode("latin1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("hello")
    (tmp_path / "long.csv").write_text("a\n" + "1\n" * 50)
    (tmp_path / "wide.csv").write_text(",".join("abcdefgh") + "\n")
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 200)
    found = verdicts(spark, tmp_path, rows=40, columns=6, file_bytes=500)
    good = found["good.csv"]
    assert (good["valid"], good["rows"], good["columns"], good["encoding"]) == (True, 2, 3, "utf-8")
    assert (found["sem%20i.csv"]["delimiter"], found["tabs.csv"]["delimiter"]) == (";", "\t")
    assert found["tabs.csv"]["columns"] == 4
    assert found["latin.csv"]["encoding"] == "latin1" and found["latin.csv"]["valid"]
    errors = {n: r["error"] for n, r in found.items() if not r["valid"]}
    assert set(errors) == {"empty.csv", "notes.txt", "long.csv", "wide.csv", "big.csv"}
    assert "empty (0 bytes)" in errors["empty.csv"]
    assert errors["notes.txt"].startswith("Unsupported file type '.txt'")
    assert errors["long.csv"] == "CSV has 50 rows, exceeding the maximum limit of 40."
    assert errors["wide.csv"] == "CSV has 8 columns, exceeding the maximum limit of 6."
    assert "exceeds maximum allowed size" in errors["big.csv"]


def test_audit_missing(spark, tmp_path):
    row = tw.audit_files(spark, f"{tmp_path}/none.csv").first()
    assert not row["valid"] and row["error"].startswith("File not found")


def test_small_splits_keep_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1,h2,h3\n" + "1,2\n" * 400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert verdicts(spark, tmp_path)["a.csv"]["columns"] == 3
        assert verdicts(spark, tmp_path)["a.csv"]["rows"] == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_types(spark, csv):
    path = csv(
        "t.csv",
        "n,gap,x,flag,flag_gap,day,mixed,none\n"
        "1,1,1.5,True,True,2024-01-01,1,NA\n"
        "2,,2e3,False,,2024-01-02,x,\n"
        "-3,N/A,inf,true,False,2024-01-03,-,nan\n",
    )
    table = tw.load_csv(spark, path)
    assert dict(table.dtypes) == {
        "n": "bigint", "gap": "double", "x": "double", "flag": "boolean", "flag_gap": "string",
        "day": "string", "mixed": "string", "none": "double",
    }
    assert [r["mixed"] for r in table.collect()] == ["1", "x", "-"]


def test_delimiter_and_encoding(spark, csv):
    table = tw.load_csv(spark, csv("s.csv", "name;n\ncafé;1\n", "latin1"))
    assert table.collect() == [("café", 1)]
    marked = tw.load_csv(spark, csv("b.csv", "name,n\ncafé,1\n", "utf-8-sig"))
    assert marked.columns == ["name", "n"] and marked.first()["name"] == "café"
    odd = tw.load_csv(spark, csv("o.csv", "name,n\n�,1\n"))
    assert odd.first()["name"] == "�"


def test_quotes(spark, csv):
    table = tw.load_csv(spark, csv("q.csv", 'a,b\n"x, ""y""",2\n'))
    assert table.first()["a"] == 'x, "y"'


def test_load_table(spark, tmp_path, csv):
    assert tw.load_table(spark, csv("a.csv", "a,b\n1,2\n"))[1] == "CSV Data"
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / f"t.{fmt}")
        spark.range(3).write.format(fmt).save(path)
        table, name = tw.load_table(spark, path)
        assert (table.count(), name) == (3, "t")
    with pytest.raises(ValueError, match="Unsupported file format"):
        tw.load_table(spark, "a.xls")


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tw.load_table(spark, f"{tmp_path}/none.csv")


def test_refused_file(spark, csv):
    path = csv("r.csv", "a,b\n1,2\n3,4\n")
    with pytest.raises(ValueError, match="exceeding the maximum limit of 1"):
        tw.analyze_path(spark, path, limits=tw.Limits(rows=1))


def test_best_of_several_tables(spark):
    data = spark.range(60).selectExpr("id AS order_no", "id % 4 AS kind", "id * 1.5 AS price")
    note = spark.createDataFrame([("hello",)], "text string")
    name, report = tw.analyze_tables(spark, {"notes": note, "orders": data})
    assert name == "orders" and report.audit.cleaned_rows == 60 and report.seconds > 0


@pytest.fixture
def tiny_splits(spark):
    """Files in splits of a few hundred bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_line_breaks_over_splits(spark, csv, tiny_splits):
    import csv as plain_csv
    import io
    import random

    rng = random.Random(5)
    parts = ["a", "b;c", ",", "\n", "\n\n", '"', '""', "é", "x" * 90, " ", ""]
    rows = [[str(i), "".join(rng.choices(parts, k=rng.randint(0, 9))) or "none", f"t{i % 7}"] for i in range(400)]
    rows[17][1], rows[200][1] = "long\n" * 300, '"\n' * 200
    out = io.StringIO()
    plain_csv.writer(out, lineterminator="\n").writerows([["id", "text", "kind"], *rows])
    path = csv("breaks.csv", out.getvalue())
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got = {r["id"]: (r["text"], r["kind"]) for r in tw.load_table(spark, path)[0].collect()}
    assert got == {int(i): (text, kind) for i, text, kind in rows}


def test_lines_stay_where_they_are_read(spark, csv, tiny_splits, tmp_path):
    """Lines are neither joined by a shuffle nor followed again for each use; only pieces are shuffled."""
    rows = [f'{i},"line {i}\nof ""{i}""",x' for i in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    path = csv("many.csv", "\n".join(["id,text,kind", *rows]) + "\n")
    table = tw.load_table(spark, path)[0]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan
    found = records(spark.read.text(path), ",").filter("NOT header")
    assert found.count() == table.count() == 300
    written = spark.read.parquet(*{os.path.dirname(f) for f in found.inputFiles()})
    pieces = written.filter("c3 IS NOT NULL").count()
    assert pieces <= 2 * spark.read.text(path).rdd.getNumPartitions() < 20
    assert {r["id"]: r["text"] for r in table.collect()} == {i: f'line {i}\nof "{i}"' for i in range(300)}


def test_no_cast_of_texts_that_are_no_whole_numbers(spark):
    """A failing cast throws and catches an exception, which takes microseconds a cell."""
    texts = [("12",), ("-7 ",), ("x1",), ("",), (None,), ("1.0",), ("99999999999999999999",)]
    df = spark.createDataFrame(texts, "t string").select(parse.whole_number(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [12, -7, None, None, None, None, None]
    assert "nullif" in df._jdf.queryExecution().logical().toString()


def test_files_are_told_apart_without_sorting_lines(spark, csv, tmp_path):
    csv("a.csv", "name,n\n" + "José,1\n" * 50)
    csv("b.csv", "n;name\n" + "2;Zoë\n" * 50, "latin-1")
    lines = spark.read.text(str(tmp_path))
    kinds_of_files = load._file_kinds(lines, None, None, None)
    assert [(k["sep"], k["encoding"]) for k in kinds_of_files] == [(",", "UTF-8"), (";", "ISO-8859-1")]
    plan = load._file_headers(lines)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_single_quote_in_a_cell_is_text(spark, csv, tiny_splits):
    lines = ["id,size,note", '1,5" pipe,a', '2,6,"two\nlines"'] + [f'{i},{i}" rod,plain' for i in range(3, 60)]
    rows = {r["id"]: r for r in tw.load_table(spark, csv("inch.csv", "\n".join(lines) + "\n"))[0].collect()}
    assert len(rows) == 59
    assert (rows[1]["size"], rows[2]["note"], rows[30]["size"]) == ('5" pipe', "two\nlines", '30" rod')


def test_folder_of_several_kinds(spark, csv, tmp_path):
    csv("a.csv", "name,n\nJosé,1\n")
    csv("b.csv", "n;name\n2;Zoë\n", "latin-1")
    csv("c.csv", "name\tn\textra\nplain\t3\tx\n")
    csv("d.csv", 'name,n\n"two\nlines",4\n')
    rows = {r["n"]: (r["name"], r["extra"]) for r in tw.load_table(spark, str(tmp_path), "csv")[0].collect()}
    assert rows == {1: ("José", None), 2: ("Zoë", None), 3: ("plain", "x"), 4: ("two\nlines", None)}
    with pytest.raises(ValueError):
        tw.load_table(spark, csv("empty.csv", ""))
