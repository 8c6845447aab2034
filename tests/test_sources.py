import datetime as dt

import pytest

from tests.conftest import day, rows
from wardlens.operators.derive import normalize_sir, sir_columns
from wardlens.schema import ADMISSIONS, AGENTS, PRESCRIPTIONS
from wardlens.sources import coerce_dates, read_dim, read_table, read_tests, rejected_values, stamped_name, write_csv


def _file(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    path = _file(
        tmp_path,
        "adm_id,id,extra,gender,adm_start_date,adm_end_date,death_during_adm,adm_route,sub_specialty,specialty,birth_date\n"
        "a1,007,x,F,2020-01-31,2020-02-03,FALSE,GP,,\"sur,gery\",1950-12-31\n"
        "a2,p2,x,NA,2020-13-31,NA,TRUE,\"\",s,i,1950-01-01\n",
    )
    df = read_table(spark, path, ADMISSIONS)
    assert df.columns == ADMISSIONS.fieldNames()
    assert rows(df) == [
        ("007", "a1", "F", dt.date(2020, 1, 31), dt.date(2020, 2, 3), False, "GP", None, "sur,gery", dt.date(1950, 12, 31)),
        ("p2", "a2", None, None, None, True, None, "s", "i", dt.date(1950, 1, 1)),
    ]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = _file(tmp_path, 'atc_code,ab_type,ab_group\nJ01,"two\nlines","say ""x"""\n')
    assert rows(read_dim(spark, path, AGENTS, multiline=True)) == [("J01", "two\nlines", 'say "x"')]


def test_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="ddd_per_day"):
        read_table(spark, _file(tmp_path, "id,ab_start_date,ab_stop_date,ab_route,atc_code\n"), PRESCRIPTIONS)


def test_semicolons_and_decimal_commas(spark, tmp_path):
    text = "id;ab_start_date;ab_stop_date;ab_route;atc_code;ddd_per_day\np;2020-01-01;2020-01-02;IV;J01;1.234,5\n"
    df = read_table(spark, _file(tmp_path, text), PRESCRIPTIONS, fmt="csv2")
    assert rows(df, "ddd_per_day", "ab_stop_date") == [(1234.5, dt.date(2020, 1, 2))]


def test_agent_columns_are_whatever_else_is_there(spark, tmp_path):
    text = "id,specialty,amox,mo,cipr,material,test_date,test_number,note\np,surgery,r,m, S,blood,2020-01-01,1,hello\n"
    path = _file(tmp_path, text)
    df = normalize_sir(read_tests(spark, path))
    assert sir_columns(df) == ["amox", "cipr"]
    assert rows(df, "amox", "cipr", "note") == [("R", "S", "hello")]
    assert "note" not in read_tests(spark, path, agent_cols=["amox"]).columns


def test_export_comes_back(spark, tmp_path):
    df = spark.createDataFrame(
        [("p", day(1), True, None, 1.5), ("q", None, None, "a,\"b\"", None)],
        "id string, d_date date, flag boolean, text string, x double",
    )
    path = write_csv(df, str(tmp_path / "out"), single_file=True, na="NA")
    assert rows(read_table(spark, path, df.schema)) == rows(df)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert "TRUE" in text and "NA" in text and '"a,""b"""' in text
    assert stamped_name("mine", "cohort", day(1)) == "mine_cohort_2020-01-01.csv"


def test_texts_that_look_missing_survive_an_export(spark, tmp_path):
    texts = ["NA", "", " x ", None, '"', "a,b", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    path = write_csv(df, str(tmp_path / "out"))
    assert rows(read_table(spark, path, df.schema, missing=(), trim=False)) == rows(df)
    assert rows(read_table(spark, path, df.schema), "text").count((None,)) == 3


def _two_files(tmp_path, one, two):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(one)
    (folder / "b.csv").write_text(two)
    return str(folder)


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    path = _two_files(tmp_path, "atc_code,ab_type,ab_group\nJ01,a,G1\n", "ab_group,atc_code,ab_type\nG2,J02,b\n")
    expected = [("J01", "a", "G1"), ("J02", "b", "G2")]
    assert rows(read_dim(spark, path, AGENTS)) == expected
    assert rows(read_dim(spark, [f"{path}/b.csv", f"{path}/a.csv"], AGENTS)) == expected
    head = "id,ab_start_date,ab_stop_date,ab_route,atc_code,ddd_per_day"
    rx = tmp_path / "rx"
    rx.mkdir()
    (rx / "a.csv").write_text(f"{head}\np,2020-01-01,2020-01-02,IV,J01,1.5\n")
    (rx / "b.csv").write_text("ddd_per_day,atc_code,ab_route,ab_stop_date,ab_start_date,id\n2.5,J02,oral,2020-01-04,2020-01-03, q \n")
    found = rows(read_table(spark, str(rx), PRESCRIPTIONS), "id", "ab_route", "ddd_per_day")
    assert found == [("p", "IV", 1.5), ("q", "oral", 2.5)]


def test_laboratories_with_other_agents(spark, tmp_path):
    path = _two_files(
        tmp_path,
        "id,test_number,test_date,material,mo,specialty,amox,cipr\np,1,2020-01-01,blood,m,s,S,R\n",
        "gent,amox,specialty,mo,material,test_date,test_number,id\nI,R,s,m,urine,2020-01-02,2,q\n",
    )
    df = normalize_sir(read_tests(spark, path))
    assert rows(df, "id", "material", "amox", "cipr", "gent") == [("p", "blood", "S", "R", None), ("q", "urine", "R", None, "I")]


def test_values_that_do_not_fit_are_counted(spark, tmp_path):
    text = "id,ab_start_date,ab_stop_date,ab_route,atc_code,ddd_per_day\np,2020-13-01,2020-01-02,IV,J01,x\nq,,NA,IV,J01,1\n"
    found = {r[0]: tuple(r[1:]) for r in rejected_values(spark, _file(tmp_path, text), PRESCRIPTIONS).collect()}
    assert found["ab_start_date"] == (1, 1) and found["ab_stop_date"] == (1, 0) and found["ddd_per_day"] == (2, 1)
    assert found["id"] == (2, 0)


def test_parquet(spark, tmp_path):
    dim = spark.createDataFrame([("J01", "a", "b", 1)], "atc_code string, ab_type string, ab_group string, n int")
    dim.write.parquet(str(tmp_path / "dim"))
    assert rows(read_dim(spark, str(tmp_path / "dim"), AGENTS, fmt="parquet")) == [("J01", "a", "b")]


def test_dates_by_column_name(spark):
    df = spark.createDataFrame([("2020-01-02", "x", 3)], "start_Date string, name string, n int")
    assert rows(coerce_dates(df)) == [(dt.date(2020, 1, 2), "x", 3)]
    stamps = df.selectExpr("timestamp'2020-01-02 23:59:59' AS test_date")
    assert rows(coerce_dates(stamps)) == [(dt.date(2020, 1, 2),)]


def test_one_job_finds_the_headers_of_many_files(spark, tmp_path):
    """Three column orders in 300 files, whose names need quoting; some start with blank lines or hold nothing."""
    orders = (["atc_code", "ab_type", "ab_group"], ["ab_group", "note", "atc_code", "ab_type"], ["ab_type", "ab_group", "atc_code"])
    folder = tmp_path / "many files"
    folder.mkdir()
    expected = []
    for k in range(300):
        value = {"atc_code": f"J{k}", "ab_type": f"t{k % 7}", "ab_group": f"g {k % 3}", "note": "x"}
        names = orders[k % 3]
        text = "\n" * (k % 5 == 0) + ",".join(names) + "\n" + ",".join(value[n] for n in names) + "\n"
        (folder / f"part %20 {k:03d}.csv").write_text("" if k % 50 == 49 else text)
        if k % 50 != 49:
            expected.append((value["atc_code"], value["ab_type"], value["ab_group"]))
    context = spark.sparkContext
    context.setJobGroup("headers", "headers of many files")
    try:
        df = read_dim(spark, str(folder), AGENTS)
        jobs = context.statusTracker().getJobIdsForGroup("headers")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # One for all first lines and up to three for each different header, where Spark lists its files
    # (more than it lists on the driver) and reads one header; none for each file.
    assert len(jobs) <= 2 + 3 * len(orders), len(jobs)
    assert rows(df) == sorted(expected, key=str)


def test_headers_that_run_over_lines(spark, tmp_path):
    """Headers that differ after a line break inside quotes are told apart."""
    for k, last in enumerate(("ab_type", "ab_group")):
        other = "ab_group" if last == "ab_type" else "ab_type"
        (tmp_path / f"{k}.csv").write_text(f'atc_code,"a\nb",{last},{other}\nJ{k},x,{last[3]},{other[3]}\n')
    assert rows(read_dim(spark, str(tmp_path), AGENTS, multiline=True)) == [("J0", "t", "g"), ("J1", "t", "g")]


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="lacks"):
        read_dim(spark, str(tmp_path), AGENTS)
