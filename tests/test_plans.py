"""What the physical plans must and must not contain."""

import random
from collections import defaultdict

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from checks.bindings import tables
from checks.queries import QUERIES, run
from tests.conftest import day, rows
from wardlens.operators import intervals
from wardlens.operators.dims import with_dim
from wardlens.operators.intervals import attribute_intervals, attribute_points, rx_in_admissions
from wardlens.operators.isolates import first_isolate
from wardlens.plans.cohort import CohortSpec, build_cohort, min_size
from wardlens.plans import enrich as enrich_module
from wardlens.plans.enrich import enrich, save_attributed
from wardlens.session import configure, scratch_path

SF_DIR = "/root/testdata/sf0.001"
# Joins without an equality and rows handed to Python do not scale.
BANNED = ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def whole_schemas_in_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(run(name, spark, SF_DIR))
    assert [b for b in BANNED if b in text] == []


def test_scan_reads_only_what_the_view_needs(spark):
    rx = tables(spark, SF_DIR).saved.prescriptions
    spec = CohortSpec(routes=["IV"], years=(1996, 1998), ab_timing=(0, 5), exclude_sub=["A", "B"])
    view = build_cohort(rx, spec).groupBy("ab_group").count()
    text = plan(view)
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "ab_route", "ab_timing", "ab_group", "sub_specialty",
    }
    assert "PartitionFilters: [isnotnull(year" in text
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ab_timing,0)" in pushed and "EqualTo(ab_route,IV)" in pushed
    assert "Or(IsNull(sub_specialty),Not(In(sub_specialty" in pushed


def test_unused_facts_are_not_computed(spark):
    t = tables(spark, SF_DIR)
    lazy = enrich(t.admissions, t.prescriptions, t.tests, t.agents, t.organisms, 30)
    text = plan(lazy.prescriptions.groupBy("specialty").count())
    assert "events.parquet" not in text and "Window" not in text
    assert text.count("lineitem.parquet") == 1


@pytest.fixture
def tiny_thresholds(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    configure(spark)
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_cohort_does_not_move_to_find_large_groups(spark, tiny_thresholds):
    cohort = tables(spark, SF_DIR).saved.prescriptions
    sizes = sorted(n for (n,) in rows(cohort.select("sub_specialty", "id", "adm_id").distinct().groupBy("sub_specialty").count().select("count")))
    middle = sizes[len(sizes) // 2]
    few = min_size(cohort, middle)
    text = plan(few)
    assert "array_contains(Subquery" in text and "Join" not in text
    assert "Exchange" not in text.split("Subquery subquery")[0]
    joined = min_size(cohort, middle, max_groups=None)
    assert "_piece" in plan(joined) and 0 < few.count() < cohort.count() and rows(few) == rows(joined)
    with pytest.raises(SparkRuntimeException, match="max_groups=None"):
        min_size(cohort, 1, max_groups=2).collect()


def jobs_of(spark, build):
    """What ``build`` returns, and the jobs that ran meanwhile."""
    context = spark.sparkContext
    context.setJobGroup("building", "building")
    try:
        return build(), len(context.statusTracker().getJobIdsForGroup("building"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_nothing_runs_while_plans_are_built(spark):
    t = tables(spark, SF_DIR)
    cohort, agents, tests = t.saved.prescriptions, t.agents, t.tests
    t.prescriptions, t.organisms  # noqa: B018
    for build in (
        lambda: min_size(cohort, 20),
        lambda: min_size(cohort, 20, max_groups=None),
        lambda: with_dim(t.prescriptions, agents, "atc_code"),
        lambda: with_dim(tests, t.organisms, "mo"),
    ):
        assert jobs_of(spark, build)[1] == 0


def test_an_unused_dimension_is_not_read(spark):
    t = tables(spark, SF_DIR)
    joined = with_dim(t.tests, t.agents.withColumnRenamed("atc_code", "mo"), "mo")
    assert "part.parquet" in plan(joined) and "part.parquet" not in plan(joined.groupBy("material").count())


ATTRIBUTED = ["ab_first", "ddd_total", "join_course", "join_adm_on_rx", "join_adm_on_tests", "join_timing"]


@pytest.mark.parametrize("name", ATTRIBUTED)
def test_attribution_runs_once(spark, tiny_thresholds, name):
    text = plan(run(name, spark, SF_DIR))
    assert "lineitem.parquet" not in text  # prescriptions come attributed
    assert "events.parquet" not in text  # and so do tests
    assert "Exchange" not in text  # rows and facts meet in their buckets


def test_one_attribution_of_tests(spark, monkeypatch, tmp_path):
    """Facts and enriched tests come from one join of tests and admissions."""
    joined = []
    whole = enrich_module.attribute_points
    monkeypatch.setattr(enrich_module, "attribute_points", lambda *a, **k: joined.append(a) or whole(*a, **k))
    t = tables(spark, SF_DIR)
    saved = save_attributed(t.admissions, t.prescriptions, t.tests, t.agents, t.organisms, str(tmp_path / "a"), 30)
    assert saved.enriched().tests.count() and len(joined) == 1


def test_whole_tests_move_once_to_their_first_days(spark, tiny_thresholds):
    path = scratch_path(spark, "plain-tests")
    tables(spark, SF_DIR).tests.write.parquet(path)
    found = first_isolate(spark.read.parquet(path))
    assert found.count() == spark.read.parquet(path).count()
    text = plan(found)
    assert "LeftSemi" not in text and "LeftAnti" not in text
    found.collect()
    final = plan(found).split("Initial Plan")[0]
    shuffled = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # Days and rows by group, then what shares a first day: firsts and counted copies.
    assert len(shuffled) <= 4, "\n".join(shuffled)


def test_views_of_a_saved_cohort_read_it_only(spark):
    t = tables(spark, SF_DIR)
    for view in (t.cohort.admissions("specialty"), t.cohort.tests(), t.cohort.total()):
        text = plan(view)
        assert text.count("FileScan") == 1 and "lineitem.parquet" not in text and "enriched-" not in text


def test_one_scan_for_all_stay_lengths(spark):
    t = tables(spark, SF_DIR)
    stays = t.admissions.select("id", "adm_id", "adm_start_date", F.lit("9999-12-31").cast("date").alias("adm_end_date"))
    for view, table in (
        (attribute_intervals(t.prescriptions, stays), "lineitem"),
        (attribute_points(t.tests, stays), "events"),
        (rx_in_admissions(t.prescriptions, stays), "lineitem"),
        (intervals.tests_in_admissions(t.tests, stays), "events"),
    ):
        assert plan(view).count(f"{table}.parquet") == 1
    every = t.tests.join(stays.select("id").distinct(), "id")
    assert intervals.tests_in_admissions(t.tests, stays).count() <= every.count()


def test_a_hot_patient_is_split(spark, tiny_thresholds):
    rng = random.Random(1)
    stays, rx = [], []
    for i in range(12_000):
        patient = "hot" if i % 3 == 0 else f"p{i}"
        # The hot patient's rows fall in one bucket, too.
        start = rng.randrange(20, 25) if patient == "hot" else rng.randrange(1, 900)
        rx.append((patient, i, day(start), day(start + 2)))
        if patient != "hot" or i < 30:
            stays.append((patient, i, day(start), day(start + 4)))
    adm = spark.createDataFrame(stays, "id string, adm_id int, adm_start_date date, adm_end_date date")
    prescriptions = spark.createDataFrame(rx, "id string, n int, ab_start_date date, ab_stop_date date").repartition(8)
    joined = attribute_intervals(prescriptions, adm, max_stay_days=10)
    by_admission = joined.groupBy("id", "adm_id").agg(F.count("n"), F.max("n"))
    by_patient = defaultdict(list)
    for q, _, b, c in stays:
        by_patient[q].append((b, c))
    expected = sum(b <= s and e <= c for p, _, s, e in rx for b, c in by_patient[p])
    assert sum(n for _, _, n, _ in by_admission.collect()) == expected
    assert "skew=true" in plan(by_admission)


def test_copies_of_one_test_are_spread(spark, tiny_thresholds, monkeypatch):
    monkeypatch.setattr("wardlens.operators.isolates.COPIES_PER_PIECE", 10)
    table = [("p", "m", day(1), "1")] * 600 + [(f"p{i}", "m", day(i), "1") for i in range(1200)]
    tests = spark.createDataFrame(table, "id string, mo string, test_date date, test_number string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    flagged = first_isolate(tests)
    per_task = [sum(1 for r in part if r["id"] == "p") for part in flagged.rdd.glom().collect()]
    assert sum(per_task) == 600
    # Pieces of ten copies hash to different tasks.
    assert max(per_task) <= 300
    assert sum(f for (f,) in rows(flagged, "first_isolate")) == 1201
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
