"""Two-level running sums and what is built on them, against plain loops."""

import datetime as dt
import math
import random
import statistics

import pytest

from tests.conftest import day, rows
from wardlens.operators import prefix
from wardlens.operators.prefix import with_running_sums
from wardlens.operators.runchart import run_chart
from wardlens.operators.survival import km_curve, logrank_table


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(prefix, "PIECE_VALUES", 4)


ORDERS = {
    "int": lambda k: k - 20,
    "double": lambda k: k * 0.7 - 9,
    "date": lambda k: day(k - 20),
    "string": lambda k: f"{2000 + k // 12}-{k % 12:02}",
    "timestamp": lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * k),
}


@pytest.mark.parametrize("kind", ORDERS)
def test_running_sums(spark, small_pieces, kind):
    rng = random.Random(kind)
    table = [(rng.choice(["a", "b", None]), ORDERS[kind](rng.randrange(40)), rng.choice([None, 1, 2, 5])) for _ in range(150)]
    df = spark.createDataFrame(table, f"g string, t {kind}, v int")
    for keys in ([], ["g"]):

        def total(g, chosen):
            own = [v for h, t, v in table if (not keys or h == g) and v is not None and chosen(t)]
            return sum(own) if own else None

        expected = [(g, t, v, total(g, lambda u, t=t: u <= t), total(g, lambda u, t=t: u >= t)) for g, t, v in table]
        found = with_running_sums(df, keys, "t", forward={"up": "v"}, backward={"down": "v"})
        assert found.columns == ["g", "t", "v", "up", "down"]
        assert sorted(rows(found), key=str) == sorted(expected, key=str)
    empty = with_running_sums(df.limit(0), [], "t", forward={"up": "v"})
    assert empty.collect() == []


def _chart(values):
    """Centre, useful points, longest run and crossings of values in order."""
    centre = statistics.median(values)
    sides = [v > centre for v in values if v != centre]
    lengths = []
    for k, side in enumerate(sides):
        if k and side == sides[k - 1]:
            lengths[-1] += 1
        else:
            lengths.append(1)
    return centre, len(sides), max(lengths, default=0), max(len(lengths) - 1, 0)


@pytest.mark.parametrize("kind", ORDERS)
def test_run_charts(spark, small_pieces, kind):
    rng = random.Random(kind)
    charts = {
        "mixed": [rng.randrange(5) for _ in range(60)],
        "long runs": [k // 17 % 2 for k in range(60)],
        None: [3 * (k % 9 == 0) + rng.randrange(2) for k in range(60)],
        "flat": [4] * 60,
        "one": [1],
    }
    table = [(f, ORDERS[kind](k), v) for f, values in charts.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(table, f"f string, x {kind}, y int")
    picked = ["centre", "n_useful", "longest_run", "n_crossings"]
    found = {tuple(r) for r in run_chart(df, "x", "y", facet="f").select("f", *picked).collect()}
    assert found == {(f, *_chart(values)) for f, values in charts.items()}
    for f, values in charts.items():
        whole = run_chart(df.filter(df["f"].eqNullSafe(f)), "x", "y")
        assert whole.count() == len(values)
        assert {tuple(r) for r in whole.select(*picked).collect()} == {_chart(values)}
    assert run_chart(df.limit(0), "x", "y").collect() == []


def test_curve_without_strata(spark, small_pieces):
    rng = random.Random(7)
    table = [(rng.choice("ab"), rng.randrange(60), int(rng.random() < 0.6)) for _ in range(400)]
    adm = spark.createDataFrame(table, "check string, LOS int, event int")
    level, expected = 1.0, {}
    for t in sorted({t for _, t, _ in table}):
        at_risk = sum(u >= t for _, u, _ in table)
        dead = sum(u == t and e for _, u, e in table)
        level *= 1 - dead / at_risk
        expected[t] = (at_risk, dead, level)
    found = {t: (n, d, s) for t, n, d, _, s in rows(km_curve(adm))}
    assert found.keys() == expected.keys()
    assert all(found[t][:2] == expected[t][:2] and math.isclose(found[t][2], expected[t][2], abs_tol=1e-12) for t in found)
    observed, due = {"a": 0, "b": 0}, {"a": 0.0, "b": 0.0}
    for t in expected:
        for g in "ab":
            observed[g] += sum(h == g and u == t and e for h, u, e in table)
            due[g] += expected[t][1] * sum(h == g and u >= t for h, u, _ in table) / expected[t][0]
    for g, _, seen, hoped, _ in rows(logrank_table(adm)):
        assert seen == observed[g] and math.isclose(hoped, due[g])
