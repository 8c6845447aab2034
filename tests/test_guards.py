"""Arguments a view refuses."""

import pytest

from wardlens.operators.derive import with_diagnostic
from wardlens.operators.dosing import dose_density, dose_timeseries
from wardlens.operators.isolates import first_isolates, resistance_table, resistance_timeseries, sir_counts
from wardlens.operators.runchart import run_chart
from wardlens.operators.survival import logrank_test
from wardlens.plans.cohort import Cohort


@pytest.fixture(scope="module")
def adm(spark):
    table = [(f"g{i}", "one", i, 1) for i in range(6)]
    return spark.createDataFrame(table, "specialty string, check string, LOS int, event int")


def test_two_to_five_groups(adm):
    with pytest.raises(ValueError, match="at least two"):
        logrank_test(adm, strata="check")
    with pytest.raises(ValueError, match="at most 5"):
        logrank_test(adm, strata="specialty")


def test_agents_must_be_chosen(adm):
    for view in (
        lambda: sir_counts(adm, [], "check"),
        lambda: resistance_table(adm, [], "check"),
        lambda: resistance_timeseries(adm, []),
    ):
        with pytest.raises(ValueError, match="at least one agent"):
            view()


def test_unknown_choices(adm):
    with pytest.raises(ValueError, match="cannot group by"):
        dose_density(adm, "LOS")
    with pytest.raises(ValueError, match="method"):
        dose_density(adm, "check", method="mean")
    with pytest.raises(ValueError, match="cannot group by"):
        dose_timeseries(adm, "ddd", "week")
    with pytest.raises(ValueError, match="measure"):
        dose_timeseries(adm, "mg")
    with pytest.raises(ValueError, match="material"):
        first_isolates(adm, "sputum")
    with pytest.raises(ValueError, match="material"):
        with_diagnostic(adm, "sputum")
    with pytest.raises(ValueError, match="organism"):
        first_isolates(adm, "blood", organisms=[])
    with pytest.raises(ValueError, match="calc"):
        resistance_table(adm, "amox", "check", calc="mean")
    with pytest.raises(ValueError, match="agg"):
        run_chart(adm, "LOS", "event", agg="max")
    with pytest.raises(ValueError, match="without tests"):
        Cohort(adm).tests()
