"""Operators against plain loops on random tables."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import day, rows
from wardlens.operators import intervals
from wardlens.operators.courses import all_courses, first_course
from wardlens.operators.isolates import first_isolate
from wardlens.operators.stay import los_density
from wardlens.operators.survival import chi_square_tail, km_curve, logrank_table, logrank_test
from wardlens.plans.cohort import CohortSpec, build_cohort

ADM = "id string, adm_id int, adm_start_date date, adm_end_date date"
RX = "id string, n int, ab_start_date date, ab_stop_date date"


def _stays_and_rx(seed, longest):
    rng = random.Random(seed)
    stays, rx = [], []
    for i in range(120):
        # A third of the rows belong to one patient.
        patient = "hot" if rng.random() < 0.33 else f"p{rng.randrange(12)}"
        start = rng.randrange(-3000, 3000)
        stays.append((patient, i, day(start), day(start + rng.choice([0, 3, 9, 31, 32, 33, longest]))))
    for i in range(400):
        patient = "hot" if rng.random() < 0.33 else f"p{rng.randrange(12)}"
        start = rng.randrange(-3000, 3000)
        rx.append((patient, i, day(start), day(start + rng.choice([0, 1, 5, 40, 2000]))))
    return stays, rx


@pytest.mark.parametrize("longest", [60, 2500, 150_000])
@pytest.mark.parametrize("declared", [None, 0])
def test_containment(spark, longest, declared):
    stays, rx = _stays_and_rx(longest, longest)
    adm, prescriptions = spark.createDataFrame(stays, ADM), spark.createDataFrame(rx, RX)
    inside = [(n, a) for p, n, s, e in rx for q, a, b, c in stays if p == q and b <= s and e <= c]
    on_day = [(n, a) for p, n, s, _ in rx for q, a, b, c in stays if p == q and b <= s <= c]
    joined = intervals.attribute_intervals(prescriptions, adm, max_stay_days=declared)
    assert Counter(rows(joined, "n", "adm_id")) == Counter(inside)
    points = intervals.attribute_points(prescriptions, adm, day="ab_start_date", max_stay_days=declared)
    assert Counter(rows(points, "n", "adm_id")) == Counter(on_day)
    kept = intervals.rx_in_admissions(prescriptions, adm, max_stay_days=declared)
    assert Counter(rows(kept, "n")) == Counter({(n,): 1 for n, _ in inside})


def _leading_run(spans):
    spans = sorted(spans)
    run = [spans[0]]
    for before, span in zip(spans, spans[1:], strict=False):
        if span[0] > before[1]:
            break
        run.append(span)
    return day(min(s for s, _ in run)), day(max(e for _, e in run))


def _merged(spans, tolerance):
    found = []
    for s, e in sorted(spans):
        if found and s - found[-1][1] <= tolerance:
            found[-1][1] = max(found[-1][1], e)
        else:
            found.append([s, e])
    return [(day(s), day(e)) for s, e in found]


def test_courses(spark):
    rng = random.Random(5)
    spans = defaultdict(list)
    for i in range(300):
        # Some stops lie before their start.
        for _ in range(rng.randrange(1, 9)):
            start = rng.randrange(1, 25)
            spans[f"a{i}"].append((start, start + rng.choice([-1, 0, 0, 1, 2, 6])))
    table = [("p", a, day(s), day(e)) for a, found in spans.items() for s, e in found]
    rx = spark.createDataFrame(table, "id string, adm_id string, ab_start_date date, ab_stop_date date")
    first = {r[0]: r[1:] for r in rows(first_course(rx), "adm_id", "ab_start_cont", "ab_stop_cont")}
    assert first == {a: _leading_run(found) for a, found in spans.items()}
    forward = rx.filter("ab_stop_date >= ab_start_date")
    every = defaultdict(list)
    for a, s, e in rows(all_courses(forward, tolerance=1), "adm_id", "course_start", "course_stop"):
        every[a].append((s, e))
    expected = {a: _merged([x for x in f if x[1] >= x[0]], 1) for a, f in spans.items()}
    assert every == {a: f for a, f in expected.items() if f}


@pytest.mark.parametrize("episode", [365, 30])
def test_first_isolates_are_an_episode_apart(spark, episode):
    rng = random.Random(episode)
    start = dt.date(2015, 1, 1)
    table = [
        (f"p{rng.randrange(6)}", rng.choice(["m", "n", None]), start + dt.timedelta(days=rng.randrange(0, 2200)), str(i))
        for i in range(500)
    ]
    tests = spark.createDataFrame(table, "id string, mo string, test_date date, test_number string")
    expected, last = set(), {}
    for p, mo, d, n in sorted(table, key=lambda r: (r[2], r[3])):
        if mo and ((p, mo) not in last or (d - last[p, mo]).days > episode):
            last[p, mo] = d
            expected.add(n)
    flagged = rows(first_isolate(tests, episode_days=episode), "test_number", "first_isolate")
    assert len(flagged) == 500
    assert {n for n, first in flagged if first} == expected


def _survival_rows(seed, strata):
    rng = random.Random(seed)
    return [(rng.choice("abcde"[:strata]), rng.randrange(1, 15), int(rng.random() < 0.8)) for _ in range(300)]


def _logrank(table, strata):
    o, e, v = np.zeros(strata), np.zeros(strata), np.zeros((strata, strata))
    for t in sorted({t for _, t, _ in table}):
        n = np.array([sum(g == s and u >= t for s, u, _ in table) for g in "abcde"[:strata]], dtype=float)
        d = np.array([sum(g == s and u == t and x for s, u, x in table) for g in "abcde"[:strata]], dtype=float)
        total, dead = n.sum(), d.sum()
        o, e = o + d, e + dead * n / total
        if total > 1:
            p = n / total
            v += dead * (total - dead) / (total - 1) * (np.diag(p) - np.outer(p, p))
    diff = (o - e)[:-1]
    return o, e, v, float(diff @ np.linalg.solve(v[:-1, :-1], diff))


@pytest.mark.parametrize("strata", [2, 3, 5])
def test_logrank(spark, strata):
    table = _survival_rows(strata, strata)
    adm = spark.createDataFrame(table, "check string, LOS int, event int")
    o, e, v, chisq = _logrank(table, strata)
    found = rows(logrank_table(adm))
    assert [r[2] for r in found] == list(o)
    assert np.allclose([r[3] for r in found], e)
    assert np.allclose([r[4] for r in found], np.diag(v))
    result = logrank_test(adm).first()
    assert result["df"] == strata - 1
    assert math.isclose(result["chisq"], chisq, rel_tol=1e-9)
    assert math.isclose(result["p_value"], chi_square_tail(chisq, strata - 1), rel_tol=1e-9)


def test_chi_square_tail():
    # The 5 % points of the chi-square distribution.
    for df, x in {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729}.items():
        assert math.isclose(chi_square_tail(x, df), 0.05, rel_tol=1e-5)


def test_kaplan_meier_falls_from_one(spark):
    table = _survival_rows(9, 4)
    adm = spark.createDataFrame(table, "check string, LOS int, event int")
    curves = defaultdict(list)
    for s, _, value in rows(km_curve(adm, strata="check"), "check", "time", "survival"):
        curves[s].append(value)
    for s, _ in curves.items():
        left, level, expected = sum(g == s for g, _, _ in table), 1.0, {}
        for t in sorted({u for g, u, _ in table if g == s}):
            dead = sum(g == s and u == t and x for g, u, x in table)
            level *= 1 - dead / left
            left -= sum(g == s and u == t for g, u, _ in table)
            expected[t] = level
        found = {t: v for g, t, v in rows(km_curve(adm, strata="check"), "check", "time", "survival") if g == s}
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[t], expected[t], abs_tol=1e-12) for t in found)


def test_density_sums_to_one(spark):
    rng = random.Random(3)
    table = [(rng.choice("ab"), rng.randrange(5, 25)) for _ in range(200)]
    adm = spark.createDataFrame(table, "check string, LOS int")
    for bw in (1.0, "shared"):
        total = defaultdict(float)
        for group, _, value in rows(los_density(adm, "check", grid=(-10, 45, 0.25), bw=bw)):
            total[group] += value * 0.25
        assert all(math.isclose(v, 1, abs_tol=1e-3) for v in total.values())
    whole = rows(los_density(adm, grid=(0, 30, 1), bw="shared"))
    assert len(whole) == 31


def test_more_conditions_never_widen_a_cohort(spark):
    rng = random.Random(4)
    table = [
        (i, i, rng.choice(["IV", "oral", None]), rng.randrange(0, 9), rng.choice("MF"), rng.randrange(-2, 3), None)
        for i in range(200)
    ]
    schema = "id int, adm_id int, ab_route string, ab_days int, gender string, bc_timing int, uc_timing int"
    rx = spark.createDataFrame(table, schema)
    size = len(table)
    spec = {}
    for name, value in {"routes": ["IV", "oral"], "ab_days": (2, None), "genders": ["F"]}.items():
        spec[name] = value
        smaller = build_cohort(rx, CohortSpec(**spec)).count()
        assert smaller < size
        size = smaller
