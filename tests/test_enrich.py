"""The enriched tables end to end, on hand-made sources."""

from tests.conftest import day, rows
from wardlens import Cohort, CohortSpec, Enriched, enrich
from wardlens.operators.derive import normalize_sir, sir_columns
from wardlens.plans.cohort import selector_domains
from wardlens.plans.enrich import save_enriched
from wardlens.schema import ADMISSIONS, AGENTS, ORGANISMS, PRESCRIPTIONS, TESTS


def _sources(spark, with_tests=True):
    adm = spark.createDataFrame(
        [
            ("p", "a", "F", day(10), day(20), False, "GP", "s1", "S", day(-9000)),
            ("p", "b", "F", day(400), day(410), True, "GP", None, "S", day(-9000)),
            ("q", "c", None, day(10), day(12), False, None, "s2", "I", None),
            ("r", "d", "M", day(10), None, None, "ER", "s2", "I", day(-9000)),
        ],
        ADMISSIONS,
    )
    rx = spark.createDataFrame(
        [
            ("p", day(12), day(14), "IV", "J1", 2.0),
            ("p", day(14), day(18), "oral", "J2", 1.0),
            ("p", day(12), day(13), None, "J9", None),
            ("p", day(401), day(401), "IV", None, 1.0),
            ("p", day(19), day(21), "IV", "J1", 1.0),
            ("q", day(11), day(12), "IV", "J1", 4.0),
            ("r", day(11), day(12), "IV", "J1", 4.0),
        ],
        PRESCRIPTIONS,
    )
    tests = [
        ("p", "lab", "m1", "blood", day(11), "1", "s", "R"),
        ("p", "lab", "m1", "blood", day(15), "2", "R", None),
        ("p", "lab", None, "urine", day(13), "3", None, None),
        ("p", "lab", "m1", "blood", day(402), "4", "R", "R"),
        ("p", "lab", "m1", "blood", day(300), "5", "R", "R"),
        ("q", "lab", "m2", "urine", day(10), "6", "S", "S"),
    ]
    schema = TESTS.simpleString()[7:-1].replace(":", " ")
    columns = [f for f in schema.split(",")] + ["amox string", "cipr string"]
    tests = spark.createDataFrame(tests if with_tests else [], ", ".join(columns))
    agents = spark.createDataFrame([("J1", "one", "G1"), ("J2", "two", "G2"), ("J3", "three", "G1")], AGENTS)
    organisms = spark.createDataFrame([("m1", "Mo one", "F1")], ORGANISMS)
    return adm, rx, normalize_sir(tests, ["amox", "cipr"]), agents, organisms


def _check(tables):
    assert rows(tables.admissions, "adm_id", "LOS", "age", "year", "bc_timing", "uc_timing") == [
        ("a", 11, 25, 2020, -1, 1),
        ("b", 11, 26, 2021, 1, None),
        ("c", 3, None, 2020, None, -1),
        ("d", None, 25, 2020, None, None),
    ]
    rx = rows(
        tables.prescriptions, "adm_id", "atc_code", "ab_type", "ab_days", "ab_timing", "ab_first", "ddd_total",
        "ab_days_all", "bc_timing",
    )
    assert rx == [
        ("a", "J1", "one", 2, 2, True, 8.0, 7, -1),
        ("a", "J2", "two", 4, 4, False, 8.0, 7, -1),
        ("a", "J9", None, 1, 2, True, 8.0, 7, -1),
        ("b", None, None, 0, 1, True, 0.0, 1, 1),
        ("c", "J1", "one", 1, 1, True, 4.0, 2, None),
    ]
    tests = rows(tables.tests, "test_number", "adm_id", "first_isolate", "fullname", "specialty", "amox")
    # Test 5 lies in no admission and within the episode of test 1; test 4 comes 391 days after that.
    assert tests == [
        ("1", "a", True, "Mo one", "S", "S"),
        ("2", "a", False, "Mo one", "S", "R"),
        ("3", "a", False, None, "S", None),
        ("4", "b", True, "Mo one", "S", "R"),
        ("6", "c", True, None, "I", "S"),
    ]
    assert sir_columns(tables.tests) == ["amox", "cipr"]


def test_lazy_and_saved_tables_agree(spark, tmp_path):
    sources = _sources(spark)
    _check(enrich(*sources))
    path = str(tmp_path / "enriched")
    _check(save_enriched(*sources, path=path))
    _check(Enriched.load(spark, path))


def test_cohort_of_saved_tables(spark, tmp_path):
    tables = save_enriched(*_sources(spark), path=str(tmp_path / "enriched"))
    cohort = Cohort.of(tables.prescriptions, tables.tests).cache()
    # Known route, agent and origin; admission c has no origin.
    assert rows(cohort.prescriptions, "adm_id", "atc_code", "check") == [("a", "J1", "Taken"), ("a", "J2", "Taken")]
    assert rows(cohort.admissions("check", "ab_type")) == [("p", "a", "Taken", "one")]
    assert rows(cohort.tests(), "test_number") == [("1",), ("2",), ("3",)]
    cohort.unpersist()
    urine = Cohort.of(tables.prescriptions, tables.tests, CohortSpec(diagnostic=("urine", 0, 5)))
    assert rows(urine.tests(), "test_number") == [("1",), ("2",), ("3",)]
    ranges, values = selector_domains(tables)
    assert ("LOS", 3, 11) in rows(ranges) and ("bc_timing", -1, 1) in rows(ranges)
    assert ("ab_group", "G2") in rows(values) and ("adm_route", "ER") in rows(values)


def test_no_tests_at_all(spark, tmp_path):
    tables = save_enriched(*_sources(spark, with_tests=False), path=str(tmp_path / "enriched"))
    assert tables.tests.count() == 0
    assert {r for (r,) in rows(tables.admissions, "bc_timing")} == {None}
