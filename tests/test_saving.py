"""Saved tables keep their buckets, and tasks do not grow with the input."""

import pytest

from tests.conftest import day, rows
from wardlens import Cohort, CohortSpec
from wardlens.operators.intervals import attribute_intervals
from wardlens.plans.enrich import attribute_rx, derive_admissions, save_attributed, save_enriched
from wardlens.schema import ADMISSIONS, AGENTS, KEY, ORGANISMS, PRESCRIPTIONS, TESTS
from wardlens.session import PARTITION_BYTES, PARTITIONS, configure
from wardlens.sources.buckets import default_buckets


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield configure(spark)
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def sources(spark):
    stays = [(f"p{i % 7}", f"a{i}", "F", day(i * 9), day(i * 9 + 8), False, "GP", "s", "S", day(-9000)) for i in range(60)]
    # One key with two rows that differ, a row that comes twice, unknown keys and columns.
    stays += [("p1", "a1", "M", day(9), day(30), None, None, None, "T", None)] + stays[2:3]
    stays += [("p3", None, "F", day(20), day(40), True, "ER", "s2", "S", day(-900)), (None, "n", *stays[0][2:])]
    stays += [("p3", None, "M", day(20), day(40), None, None, None, None, None)]
    rx = [(f"p{i % 7}", day(i), day(i + i % 4), "IV", f"J{i % 3}", 1.0) for i in range(560)]
    rx += [*rx[9:12], (None, *rx[0][1:]), ("p3", day(21), day(22), None, None, None)]
    tests = [(f"p{i % 7}", "lab", f"m{i % 2}", "blood", day(i * 3), str(i)) for i in range(190)]
    return (
        spark.createDataFrame(stays, ADMISSIONS),
        spark.createDataFrame(rx, PRESCRIPTIONS),
        spark.createDataFrame(tests, TESTS),
        spark.createDataFrame([("J1", "one", "G1"), ("J2", "two", "G2")], AGENTS),
        spark.createDataFrame([("m1", "Mo one", "F1")], ORGANISMS),
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_those_of_the_plain_attribution(spark, sources, tmp_path, no_broadcast, monkeypatch):
    adm, rx, _, agents, _ = sources
    widths = []

    def seen(events, stays, *args, **kwargs):
        widths.append(len(stays.columns))
        return attribute_intervals(events, stays, *args, **kwargs)

    monkeypatch.setattr("wardlens.plans.enrich.attribute_intervals", seen)
    saved = save_attributed(*sources, str(tmp_path / "a"), buckets=3).prescriptions
    plain = attribute_rx(rx, derive_admissions(adm), agents)
    assert saved.columns == plain.columns and rows(saved) == rows(plain)
    assert saved.filter("adm_id is null and gender = 'F'").count() and saved.filter("adm_id = 'a1' and gender = 'M'").count()
    # Key, dates, number and what a row without a key carries; not the other columns.
    assert widths[0] == 6


def test_no_row_moves_after_the_attribution(spark, sources, tmp_path, no_broadcast):
    saved = save_enriched(*sources, str(tmp_path / "e"))
    number = default_buckets(spark)
    assert len(list((tmp_path / "e" / "prescriptions").glob("year=2020-01-01/*.parquet"))) <= number
    cohort = Cohort.of(saved.prescriptions, saved.tests, CohortSpec())
    for grain in (cohort.prescriptions.repartition(number, *KEY), cohort.admissions(), cohort.tests(False), cohort.total()):
        text = _plan(grain).replace("Exchange SinglePartition", "")
        assert "Exchange" not in text, text
    kept = cohort.save(str(tmp_path / "c"))
    assert rows(kept.admissions()) == rows(cohort.admissions()) and rows(kept.prescriptions) == rows(cohort.prescriptions)
    assert rows(kept.tests(False).select(*cohort.tests().columns)) == rows(cohort.tests(False))
    assert len(list((tmp_path / "c" / "prescriptions").glob("*.parquet"))) <= number


def test_partitions_follow_the_bytes_of_the_sources(spark, tmp_path):
    folder = tmp_path / "big.parquet"
    folder.mkdir()
    for name in "ab":
        with open(folder / name, "wb") as f:
            f.truncate(4 * PARTITION_BYTES)
    try:
        assert default_buckets(configure(spark, [f"{tmp_path}/{{big,other}}.parquet"])) == 8
        (tmp_path / "small.parquet").write_bytes(b"x")
        assert default_buckets(configure(spark, [f"{tmp_path}/small.parquet"])) == 3
    finally:
        spark.conf.unset(PARTITIONS)
