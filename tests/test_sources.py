"""Tables whose files have columns of their own, read by name."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortcheck import Layout, Settings, normalize, violations
from cohortcheck.sources import choose_site, list_sites, read_cells, read_sites, stage, union_by_name
from tests.helpers import AS_OF, PACK, table


def put(folder, name, text):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def cells(df):
    return Counter(tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in df.collect())


def wanted(*rows):
    return Counter(tuple(sorted(r.items())) for r in rows)


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    put(tmp_path, "in/site=01/part-1.csv", "subject_id,age,shot1_date\n1,40,2021-03-01\n")
    put(tmp_path, "in/site=01/part-2.csv", "subject_id,age,shot1_date\n2,41,2021-03-02\n")
    put(tmp_path, "in/site=b/part.csv", "subject_id,Shot1_Date,AGE,shot2_date\n3,2021-04-01,50,2021-05-01\n")
    put(tmp_path, "in/site=c d/part.csv", '"shot1_date","subject_id",zip\n"2021-06-01","4","a,b"\n,5,\n')
    df = read_cells(spark, str(tmp_path / "in"), "csv")
    assert df.columns == ["subject_id", "age", "shot1_date", "site", "shot2_date", "zip"]
    assert set(dict(df.dtypes).values()) == {"string"}
    assert cells(df) == wanted(
        {"subject_id": "1", "age": "40", "shot1_date": "2021-03-01", "site": "01"},
        {"subject_id": "2", "age": "41", "shot1_date": "2021-03-02", "site": "01"},
        {"subject_id": "3", "age": "50", "shot1_date": "2021-04-01", "shot2_date": "2021-05-01", "site": "b"},
        {"subject_id": "4", "shot1_date": "2021-06-01", "zip": "a,b", "site": "c d"},
        {"subject_id": "5", "site": "c d"},
    )
    # Two files of one header are one scan.
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    assert [r.site for r in list_sites(df).collect()] == ["01", "b", "c d"]
    one = choose_site(df, "01")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(site" in one._jdf.queryExecution().toString()


def test_empty_files_and_rows(spark, tmp_path):
    put(tmp_path, "in/a.csv", "")
    put(tmp_path, "in/b.csv", "x,y\n")
    put(tmp_path, "in/c.csv", "y\n1\n")
    df = read_cells(spark, str(tmp_path / "in"), "csv")
    assert df.columns == ["x", "y"] and cells(df) == wanted({"y": "1"})
    put(tmp_path, "none/a.csv", "")
    with pytest.raises(ValueError, match="no files"):
        read_cells(spark, str(tmp_path / "none"), "csv")


def test_header_that_names_a_column_twice(spark, tmp_path):
    put(tmp_path, "in/a.csv", "rx,date,RX\n1,2,3\n")
    with pytest.raises(ValueError, match="a.csv.*RX, rx"):
        read_cells(spark, str(tmp_path / "in"), "csv")


def test_options_reach_the_headers(spark, tmp_path):
    put(tmp_path, "in/a.csv", "x;y\n1;2\n")
    put(tmp_path, "in/b.csv", "y;x;\n3;4;5\n")
    got = read_cells(spark, str(tmp_path / "in"), "csv", sep=";")
    assert cells(got) == wanted({"x": "1", "y": "2"}, {"x": "4", "y": "3", "_c2": "5"})


def test_parquet_of_several_schemas(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("1", "2021-03-01")], "subject_id string, shot1_date string").write.parquet(f"{path}/site=a")
    spark.createDataFrame([("5", "2021-04-01", "2")], "shot2_date string, Shot1_Date string, subject_id string").write.parquet(
        f"{path}/site=02"
    )
    want = wanted(
        {"subject_id": "1", "shot1_date": "2021-03-01", "site": "a"},
        {"subject_id": "2", "shot1_date": "2021-04-01", "shot2_date": "5", "site": "02"},
    )
    df = read_cells(spark, path)
    # Either spelling may name the column.
    df = df.toDF(*[c.lower() for c in df.columns])
    assert cells(df) == want and set(dict(df.dtypes).values()) == {"string"}
    # A type that no other file has: columns still meet by name, as text.
    spark.createDataFrame([(3, 7)], "subject_id long, shot2_date int").write.parquet(f"{path}/site=c")
    want += wanted({"subject_id": "3", "shot2_date": "7", "site": "c"})
    df = read_cells(spark, path)
    assert cells(df.toDF(*[c.lower() for c in df.columns])) == want


def test_parquet_scan_stays_pruned(spark, tmp_path):
    path = str(tmp_path / "in")
    table(spark, {}, {}).withColumn("site", F.expr("concat('s', row_id)")).write.partitionBy("site").parquet(path)
    df = read_cells(spark, path)
    plan = choose_site(df, "s1").select("rx")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<rx:string>" in plan and "site#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_named_tables(spark, tmp_path):
    put(tmp_path, "north.csv", "subject_id,rx\n1,0\n")
    put(tmp_path, "south.csv", "RX,subject_id,age\n1,2,30\n")
    paths = {name: str(tmp_path / f"{name}.csv") for name in ("north", "south")}
    df = read_sites(spark, paths, "csv")
    assert cells(df) == wanted(
        {"site": "north", "subject_id": "1", "rx": "0"}, {"site": "south", "subject_id": "2", "rx": "1", "age": "30"}
    )
    plan = choose_site(df, "south")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "south.csv" in plan
    with pytest.raises(ValueError, match="no tables"):
        read_sites(spark, {}, "csv")
    put(tmp_path, "odd.csv", "Site,subject_id\nx,1\n")
    with pytest.raises(ValueError, match="column site of its own"):
        read_sites(spark, {"odd": str(tmp_path / "odd.csv")}, "csv")


def test_union_keeps_the_first_spelling(spark):
    a = spark.createDataFrame([("1", "2")], "A string, b string")
    b = spark.createDataFrame([("3", "4")], "`c.d` string, a string")
    got = union_by_name([a, b])
    assert got.columns == ["A", "b", "c.d"]
    assert Counter(map(tuple, got.collect())) == Counter([("1", "2", None), ("4", None, "3")])


def test_slots_that_only_one_site_has_are_checked(spark, tmp_path):
    """A later slot of one file is seen, and its neighbours are found in columns of another order."""
    full = table(spark, {"shot2_date": "2021-06-01"}).drop("row_id")
    more = full.selectExpr("* EXCEPT (shot3_date, shot3_dose, subject_id)", "'2030-01-01' AS shot4_date", "'2' AS subject_id")
    for name, df in (("a", full), ("b", more.select(*reversed(more.columns)))):
        df.coalesce(1).write.option("header", "true").csv(str(tmp_path / f"in/site={name}"))
    staged = stage(read_cells(spark, str(tmp_path / "in"), "csv"), str(tmp_path / "staged"), by=("site",))
    layout = Layout(by=("site",))
    typed = normalize(staged, layout, drop_keyless=False)
    got = violations(typed, PACK.only("V30", "V36"), Settings(as_of=AS_OF), layout)
    assert {(r.site, r.rule_id, r.column2 or r.column1) for r in got.collect()} == {
        ("a", "V30", "shot2_date"), ("b", "V30", "shot2_date"), ("b", "V36", "shot4_date"),
    }
