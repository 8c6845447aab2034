"""Small tables with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tests.conftest import day, rows
from wardlens.operators import intervals
from wardlens.operators.counts import admission_grain, count_by, with_share
from wardlens.operators.courses import all_courses, first_course
from wardlens.operators.derive import (
    normalize_sir,
    sir_columns,
    sir_long,
    with_age,
    with_diagnostic,
    with_discharge_event,
    with_los,
    with_rx_measures,
)
from wardlens.operators.dims import agent_label, agents_in_groups, normalize_code, with_dim
from wardlens.operators.dosing import dose_density
from wardlens.operators.intervals import (
    attribute_intervals,
    attribute_points,
    days_to_first_test,
    first_rx,
    with_admission_dose,
    with_first_flag,
)
from wardlens.operators.isolates import co_resistance, first_isolate, sir_counts, sir_portions
from wardlens.operators.runchart import fewest_crossings, run_chart
from wardlens.operators.stay import los_summary
from wardlens.operators.survival import km_curve
from wardlens.plans.cohort import Cohort, CohortSpec, build_cohort, cohort_tests, min_size

RX = "id string, ab_start_date date, ab_stop_date date, atc_code string"
ADM = "id string, adm_id string, adm_start_date date, adm_end_date date"
TESTS = "id string, mo string, test_date date, test_number string, material string"


def test_stay_and_age(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 1, 1), dt.date(2020, 1, 1), dt.date(2000, 12, 31))],
        "adm_start_date date, adm_end_date date, birth_date date",
    )
    assert rows(with_age(with_los(df)), "LOS", "age") == [(1, 20)]


def test_same_day_prescription(spark):
    df = spark.createDataFrame(
        [("p", "a", day(3), day(3), day(1), 2.0)],
        "id string, adm_id string, ab_start_date date, ab_stop_date date, adm_start_date date, ddd_per_day double",
    )
    measured = with_rx_measures(df)
    assert rows(measured, "ab_days", "ab_timing", "ddd_per_prescription") == [(0, 2, 0.0)]
    assert rows(first_course(measured), "ab_days_all") == [(1,)]


def test_containment_edges(spark):
    adm = spark.createDataFrame([("p", "a", day(10), day(20))], ADM)
    spans = [(10, 20), (10, 10), (20, 20), (9, 12), (18, 21), (12, None)]
    rx = spark.createDataFrame(
        [("p", day(a), day(b) if b else None, f"{a}-{b}") for a, b in spans] + [("q", day(12), day(13), "other")], RX
    )
    assert rows(attribute_intervals(rx, adm), "atc_code") == [("10-10",), ("10-20",), ("20-20",)]


def test_each_prescription_meets_its_own_admission(spark):
    adm = spark.createDataFrame([("p", "a", day(1), day(5)), ("p", "b", day(40), day(45))], ADM)
    rx = spark.createDataFrame([("p", day(2), day(3), "x"), ("p", day(41), day(43), "y")], RX)
    assert rows(attribute_intervals(rx, adm), "adm_id", "atc_code") == [("a", "x"), ("b", "y")]


def test_overlapping_admissions_and_reversed_stays(spark):
    adm = spark.createDataFrame(
        [("p", "a", day(1), day(9)), ("p", "b", day(5), day(12)), ("p", "c", day(9), day(2)), ("p", "d", day(1), None)],
        ADM,
    )
    tests = spark.createDataFrame([("p", "m", day(6), "1", "blood"), ("p", "m", day(11), "2", "blood")], TESTS)
    assert rows(attribute_points(tests, adm), "adm_id", "test_number") == [("a", "1"), ("b", "1"), ("b", "2")]
    assert rows(intervals.tests_in_admissions(tests, adm), "test_number") == [("1",), ("2",)]


def test_two_isolates_of_one_test(spark):
    adm = spark.createDataFrame([("p", "a", day(1), day(9))], ADM)
    tests = spark.createDataFrame([("p", "m", day(6), "1", "blood"), ("p", "n", day(6), "1", "blood")], TESTS)
    assert rows(attribute_points(tests, adm), "mo") == [("m",), ("n",)]


def test_one_row_per_test_in_a_cohort(spark):
    tests = spark.createDataFrame([("p", "a", "1"), ("q", "b", "2")], "id string, adm_id string, test_number string")
    cohort = spark.createDataFrame(
        [("p", "a", "Taken")] * 3 + [("q", "b", "Not taken")], "id string, adm_id string, check string"
    )
    assert rows(cohort_tests(tests, cohort), "test_number", "check") == [("1", "Taken")]
    assert len(rows(cohort_tests(tests, cohort, taken_only=False))) == 2


def _course_rows(spark, *spans):
    return spark.createDataFrame(
        [("p", "a", day(a), day(b)) for a, b in spans],
        "id string, adm_id string, ab_start_date date, ab_stop_date date",
    )


@pytest.mark.parametrize(
    ("spans", "start", "stop"),
    [
        ([(1, 3), (2, 5), (5, 6), (8, 9), (9, 10)], 1, 6),
        ([(1, 3), (4, 5)], 1, 3),
        ([(1, 10), (2, 3), (5, 6)], 1, 10),
        ([(1, 10), (2, 3), (3, 12)], 1, 12),
        ([(1, 2), (1, 2), (1, 4), (4, 4)], 1, 4),
    ],
)
def test_first_course(spark, spans, start, stop):
    found = rows(first_course(_course_rows(spark, *spans)), "ab_start_cont", "ab_stop_cont", "ab_days_all")
    assert found == [(day(start), day(stop), stop - start + 1)]


def test_all_courses(spark):
    columns = ("course", "course_start", "course_stop")
    long_first = _course_rows(spark, (1, 10), (2, 3), (5, 6), (12, 13))
    assert rows(all_courses(long_first), *columns) == [(1, day(1), day(10)), (2, day(12), day(13))]
    next_day = _course_rows(spark, (1, 3), (4, 5))
    assert rows(all_courses(next_day, tolerance=1), *columns) == [(1, day(1), day(5))]
    assert len(rows(all_courses(next_day))) == 2


def test_first_isolate(spark):
    start = dt.date(2018, 1, 1)
    offsets = [0, 0, 100, 300, 366, 700, 731, 732]
    tests = spark.createDataFrame(
        [("p", "m", start + dt.timedelta(days=d), f"{i}", "blood") for i, d in enumerate(offsets)]
        + [("p", None, start, "n", "blood"), ("q", "m", start, "q", "urine")],
        TESTS,
    )
    flagged = rows(first_isolate(tests), "test_number", "first_isolate")
    assert [n for n, first in flagged if first] == ["0", "4", "7", "q"]
    assert len(flagged) == 10


def test_first_isolate_by_material_and_copies(spark):
    tests = spark.createDataFrame(
        [("p", "m", day(1), "1", "blood")] * 3 + [("p", "m", day(2), "2", "urine"), ("p", "m", day(1), None, "urine")],
        TESTS,
    )
    flagged = rows(first_isolate(tests), "test_number", "first_isolate")
    # The row without a test number sorts first on its day.
    assert flagged.count((None, True)) == 1
    assert sum(first for _, first in flagged) == 1
    assert len(flagged) == 5
    by_material = rows(first_isolate(tests, by_material=True), "test_number", "material", "first_isolate")
    assert by_material.count(("1", "blood", True)) == 1
    assert by_material.count(("1", "blood", False)) == 2
    assert sum(first for _, _, first in by_material) == 2


def test_many_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("wardlens.operators.isolates.COPIES_PER_PIECE", 3)
    tests = spark.createDataFrame([("p", "m", day(1), "1", "blood")] * 10, TESTS)
    flagged = rows(first_isolate(tests), "first_isolate")
    assert flagged == [(False,)] * 9 + [(True,)]


def test_diagnostic_flag(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, -1, 1, 2])], "i int, bc_timing int")
    assert rows(with_diagnostic(df), "i", "check") == [
        (0, "Not taken"),
        (1, "Taken"),
        (2, "Taken"),
        (3, "Not taken"),
    ]


def test_discharge_event(spark):
    df = spark.createDataFrame([(0, False), (1, True), (2, None)], "i int, death_during_adm boolean")
    assert rows(with_discharge_event(df), "i", "event") == [(0, 1), (1, 0), (2, None)]


COHORT = "id string, adm_id string, sub_specialty string, bc_timing int, uc_timing int, gender string, ab_days int"


def test_exclude_keeps_unknown(spark):
    rx = spark.createDataFrame(
        [("1", "1", "A", 0, None, "F", 0), ("2", "2", "B", 0, None, "M", 2), ("3", "3", None, 0, None, None, 5)], COHORT
    )
    pick = lambda **spec: rows(build_cohort(rx, CohortSpec(**spec)), "id")
    assert pick(exclude_sub=["A"]) == [("2",), ("3",)]
    assert pick() == [("1",), ("2",), ("3",)]
    assert pick(include_sub=["A", "B"]) == [("1",), ("2",)]
    assert pick(genders=["F", None]) == [("1",), ("3",)]
    assert pick(genders=["F"]) == [("1",)]
    assert pick(genders="known") == [("1",), ("2",)]
    assert pick(ab_days=(1, None)) == [("2",), ("3",)]
    assert pick(ab_days=(None, 2)) == [("1",), ("2",)]


def test_minimum_size(spark):
    # Copies of a prescription do not make a ward larger; the unknown ward counts too.
    members = [(f"a{i}", "small") for i in range(5)] + [(f"b{i}", "large") for i in range(12)]
    members += [(f"c{i}", None) for i in range(10)] + [("a0", "small")] * 20
    df = spark.createDataFrame([(i, i, s) for i, s in members], "id string, adm_id string, sub_specialty string")
    kept = rows(min_size(df, 10).groupBy("sub_specialty").count())
    assert kept == [(None, 10), ("large", 12)]
    assert rows(min_size(df, 10, max_groups=None)) == rows(min_size(df, 10))
    timed = df.selectExpr("*", "0 AS bc_timing", "0 AS uc_timing")
    with pytest.raises(SparkRuntimeException, match="max_groups=None"):
        build_cohort(timed, CohortSpec(min_n=10, max_groups=1)).collect()
    assert build_cohort(timed, CohortSpec(min_n=10, max_groups=None)).count() == 22


def test_quartiles(spark):
    adm = spark.createDataFrame([("A", v) for v in (1, 2, 3, 4, None)], "check string, LOS int")
    found = rows(los_summary(adm, "check", digits=2))
    assert found == [("A", 2.5, 2.5, 1.75, 3.25, 5, 1, 100.0)]
    assert rows(los_summary(adm, percent_text=True), "proportion") == [("100 %",)]


def test_kaplan_meier(spark):
    adm = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (None, 1), (5, None)], "LOS int, event int")
    found = [(t, n, d, c, round(s, 6)) for t, n, d, c, s in rows(km_curve(adm))]
    assert found == [(1, 4, 1, 0, 0.75), (2, 3, 1, 1, 0.5), (3, 1, 1, 0, 0.0)]
    assert [r[0] for r in rows(km_curve(adm, xlim=(2, None)))] == [2, 3]


def test_dose_density(spark):
    rx = spark.createDataFrame(
        [("p", "a", "G", 10.0, 4, 5), ("q", "b", "G", 20.0, 3, 10), ("q", "b", "G", 10.0, None, 10), ("q", "b", "G", None, 1, 10)],
        "id string, adm_id string, ab_group string, ddd_per_prescription double, ab_days int, LOS int",
    )
    assert rows(dose_density(rx, "ab_group", digits=6)) == [("G", 0.05, 0.012)]
    assert rows(dose_density(rx, "ab_group", method="pooled", digits=2)) == [("G", 266.67, 53.33)]


def test_unknown_doses_sum_to_zero(spark):
    rx = spark.createDataFrame([("p", "a", None), ("p", "a", None)], "id string, adm_id string, ddd_per_prescription double")
    assert rows(with_admission_dose(rx), "ddd_total") == [(0.0,), (0.0,)]


def test_first_flag_and_timing(spark):
    rx = spark.createDataFrame(
        [("p", "a", day(3)), ("p", "a", day(3)), ("p", "a", day(4)), ("q", "b", day(9))],
        "id string, adm_id string, ab_start_date date",
    )
    flags = rows(with_first_flag(rx), "id", "ab_start_date", "ab_first")
    assert flags == [("p", day(3), True), ("p", day(3), True), ("p", day(4), False), ("q", day(9), True)]
    tests = spark.createDataFrame(
        [("p", "a", day(1), "blood"), ("p", "a", day(2), "urine"), ("p", "a", day(9), "blood"), ("r", "c", day(1), "blood")],
        "id string, adm_id string, test_date date, material string",
    )
    assert rows(days_to_first_test(tests, first_rx(rx), "blood")) == [("p", "a", -2)]
    assert rows(days_to_first_test(tests, first_rx(rx), "urine")) == [("p", "a", -1)]


def test_co_resistance(spark):
    isolates = spark.createDataFrame([("R", "R"), ("R", "S"), ("R", None)], "amox string, cipr string")
    assert rows(co_resistance(isolates, ["amox", "cipr"])) == [(2, 1)]
    assert rows(co_resistance(isolates, ["amox", "cipr"], proportion=True, minimum=2)) == [(2, 0.5)]
    assert rows(co_resistance(isolates, ["amox", "cipr"], proportion=True)) == [(2, None)]


def test_sir_counts_and_portions(spark):
    isolates = spark.createDataFrame(
        [("A", "S")] * 20 + [("A", "I")] * 4 + [("A", "R")] * 6 + [("B", "S")] * 29 + [("B", None)] * 9,
        "check string, amox string",
    )
    assert rows(sir_counts(isolates, "amox", "check")) == [
        ("A", "amox", "I", 4),
        ("A", "amox", "R", 6),
        ("A", "amox", "S", 20),
        ("B", "amox", "I", 0),
        ("B", "amox", "R", 0),
        ("B", "amox", "S", 29),
    ]
    assert rows(sir_portions(isolates, "amox", "check")) == [
        ("A", "amox", "R", 0.2),
        ("A", "amox", "SI", 0.8),
        ("B", "amox", "R", None),
        ("B", "amox", "SI", None),
    ]


def test_run_chart(spark):
    df = spark.createDataFrame([(x, x) for x in range(1, 13)], "x int, y int")
    found = rows(run_chart(df, "x", "y"))
    assert len(found) == 12
    assert {r[2:] for r in found} == {(6.5, 12, 6, 7, 1, 3, True)}
    # Points on the centre line are not counted and do not interrupt a run.
    values = [5, 9, 5, 9, 1, 1, 5, 1, 9]
    facets = spark.createDataFrame([(f, i, v) for f in (None, "b") for i, v in enumerate(values)], "f string, x int, y int")
    found = rows(run_chart(facets, "x", "y", facet="f"))
    assert {r[3:] for r in found} == {(5.0, 6, 3, 6, 2, 1, False)}


def test_fewest_crossings_in_exact_integers(spark):
    chosen = [*range(1, 200), 1000, 4001, 5000]
    points = spark.createDataFrame([(n,) for n in chosen], "n int")
    for n, crossings in points.select("n", fewest_crossings(F.col("n"))).collect():
        trials = n - 1
        at_most = sum(math.comb(trials, i) for i in range(crossings + 1))
        assert 20 * at_most >= 2**trials
        assert crossings == 0 or 20 * (at_most - math.comb(trials, crossings)) < 2**trials


def test_run_chart_of_many_periods(spark):
    df = spark.range(5000).select("id", F.pmod(F.col("id") * 7919, F.lit(5003)).alias("y"))
    found = run_chart(df, "id", "y").agg(F.count("*"), F.max("n_useful"), F.max("longest_run_max")).first()
    assert tuple(found) == (5000, 5000, round(math.log2(5000) + 3))


def test_sir_detection_and_long_form(spark):
    df = spark.createDataFrame(
        [(i, s, "M" if i % 2 else "F", None) for i, s in enumerate(["s", " R", "I ", "S", None, "", "r", "i", "S", "S"])],
        "n int, amox string, gender string, empty string",
    )
    found = normalize_sir(df)
    assert sir_columns(found) == ["amox"]
    assert [r[0] for r in found.orderBy("n").select("amox").collect()] == list("SRIS") + [None] * 2 + list("RISS")
    assert len(rows(sir_long(found))) == 8
    assert set(sir_long(found).columns) == {"n", "gender", "empty", "agent", "interpretation"}


def test_lookups(spark):
    names = spark.createDataFrame([("amox", "Amoxicillin"), ("cipr", "Ciprofloxacin")], "agent string, agent_name string")
    assert agent_label(["cipr", "amox"], names).first()["label"] == "Ciprofloxacin & Amoxicillin"
    aliases = spark.createDataFrame([("E. Coli", "B_ESCHR"), ("ecoli", "B_ESCHR")], "alias string, code string")
    codes = spark.createDataFrame([(" e. coli",), ("ECOLI",), ("x",), (None,)], "mo string")
    assert rows(normalize_code(codes, "mo", aliases)) == [(None,), ("B_ESCHR",), ("B_ESCHR",), ("x",)]
    assert rows(normalize_code(codes, "mo", aliases, keep_unknown=False)).count((None,)) == 2
    dim = spark.createDataFrame([("t1", "G1"), ("t2", "G2"), ("t3", None)], "ab_type string, ab_group string")
    assert rows(agents_in_groups(dim, ["G1"]), "ab_type") == [("t1",)]
    assert rows(agents_in_groups(dim, [])) == []


def test_dimension_join(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("z",)], "atc_code string")
    dim = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "atc_code string, n int")
    expected = [(None, None), ("a", 1), ("b", 2), ("z", None)]
    assert rows(with_dim(df, dim, "atc_code")) == expected
    one_null = dim.filter("n <> 4")
    assert rows(with_dim(df, one_null, "atc_code", null_safe=True))[0] == (None, 3)
    with pytest.raises(SparkRuntimeException, match="not unique"):
        with_dim(df, dim, "atc_code", null_safe=True).collect()
    twice = with_dim(df, dim.unionByName(dim), "atc_code")
    with pytest.raises(SparkRuntimeException, match="not unique"):
        twice.collect()
    # Rows are never multiplied, also where nothing of the dimension is read.
    assert twice.count() == 4


def test_admission_grain(spark):
    schema = "id string, adm_id string, specialty string, ab_start_date date, ab_stop_date date, atc_code string, ab_route string, ab_type string"
    cohort = spark.createDataFrame(
        [
            ("p", "a", None, day(2), day(3), "z", "IV", "Z"),
            ("p", "a", None, day(1), day(5), "y", "IV", "Y"),
            ("p", "a", None, day(1), day(4), None, "IV", None),
            ("p", "b", "S", day(1), day(4), "x", "IV", "X"),
            ("p", "b", "S", day(1), day(4), "x", "IV", "X"),
        ],
        schema,
    )
    assert rows(admission_grain(cohort), "adm_id", "specialty", "ab_stop_date", "ab_type") == [
        ("a", None, day(4), None),
        ("b", "S", day(4), "X"),
    ]
    assert rows(admission_grain(cohort, ["specialty"])) == [("p", "a", None), ("p", "b", "S")]
    assert rows(Cohort(cohort).total()) == [(2,)]


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] * 3 + [(None, 2)] * 4, "g string, h int")
    assert [tuple(r) for r in count_by(df, "g").collect()] == [(None, 4), ("a", 3), ("b", 3)]
    assert [tuple(r) for r in count_by(df, "g", top=2).collect()] == [(None, 4), ("a", 3)]
    counts = count_by(df, ["g", "h"])
    assert rows(with_share(counts, within="h").select("g", "share")) == [(None, 1.0), ("a", 0.5), ("b", 0.5)]
    assert rows(with_share(counts).select("g", F.round("share", 3))) == [(None, 0.4), ("a", 0.3), ("b", 0.3)]
