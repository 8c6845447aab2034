"""The enriched tables: admissions, prescriptions and tests that know each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators.courses import first_course
from wardlens.operators.derive import with_age, with_calendar, with_los, with_rx_measures
from wardlens.operators.dims import with_dim
from wardlens.operators.intervals import (
    attribute_intervals,
    attribute_points,
    first_test_dates,
    longest_stay,
)
from wardlens.operators.isolates import first_isolate
from wardlens.schema import KEY, TIMING_COLUMN
from wardlens.sources.buckets import default_buckets, write_bucketed

TABLES = ("admissions", "prescriptions", "tests")
# Number of an admission in its bucketed table, which tells rows of one key apart.
ROW = "_row"


def derive_admissions(adm: DataFrame) -> DataFrame:
    """Admissions with calendar columns, length of stay and age."""
    return with_age(with_los(with_calendar(adm, "adm_start_date", "adm", year="year")))


def admission_facts(attributed_rx: DataFrame, attributed_tests: DataFrame) -> DataFrame:
    """One row per admission with a prescription: first start, dose, course, test timing.

    Grouped by the admission key throughout, so that a plan which does not use
    the course or the timings drops their joins.
    """
    totals = attributed_rx.groupBy(*KEY).agg(
        F.min("ab_start_date").alias("min_ab_start"),
        F.coalesce(F.sum("ddd_per_prescription"), F.lit(0.0)).alias("ddd_total"),
    )
    facts = totals.join(first_course(attributed_rx), KEY, "left").join(
        first_test_dates(attributed_tests), KEY, "left"
    )
    timing = {
        name: F.datediff(f"first_{material}", "min_ab_start")
        for material, name in TIMING_COLUMN.items()
    }
    return facts.withColumns(timing).drop(*(f"first_{m}" for m in TIMING_COLUMN))


def enrich_admissions(adm: DataFrame, facts: DataFrame) -> DataFrame:
    """Derived admissions with the days to the first blood and urine test."""
    return adm.join(facts.select(*KEY, *TIMING_COLUMN.values()), KEY, "left")


def enrich_rx(attributed_rx: DataFrame, facts: DataFrame) -> DataFrame:
    """Attributed prescriptions with admission facts and the first-day flag."""
    return attributed_rx.join(facts, KEY, "left").withColumn(
        "ab_first", F.col("ab_start_date") == F.col("min_ab_start")
    )


def name_tests(tests: DataFrame, organisms: DataFrame) -> DataFrame:
    """Tests with organism name and family, test calendar and first-isolate flag."""
    dated = with_calendar(tests, "test_date", "test")
    return with_dim(first_isolate(dated), organisms, "mo")


def enrich_tests(attributed_tests: DataFrame, enriched_adm: DataFrame) -> DataFrame:
    """Attributed tests with their admission's columns, found by the admission key.

    A column of both, such as the ordering specialty, is the admission's.
    """
    own = [c for c in attributed_tests.columns if c in KEY or c not in enriched_adm.columns]
    return attributed_tests.select(*own).join(enriched_adm, KEY)


def attribute_rx(
    rx: DataFrame, adm: DataFrame, agents: DataFrame, max_stay_days: int | None = None
) -> DataFrame:
    """Prescriptions with the columns of their admission, measures and agent."""
    joined = attribute_intervals(rx, adm, max_stay_days=max_stay_days)
    return with_dim(with_rx_measures(joined), agents, "atc_code")


def attribute_rx_by_row(
    rx: DataFrame, adm: DataFrame, agents: DataFrame, buckets: int, max_stay_days: int | None = None
) -> DataFrame:
    """``attribute_rx`` for admissions in buckets of the key, numbered in ``ROW``.

    Only key, number and dates of an admission meet the prescriptions; its other columns
    come from its bucket, to which the prescriptions then go. A null ``adm_id`` is not
    found there, so such an admission carries its columns along.
    """
    dates = ["adm_start_date", "adm_end_date"]
    others = [c for c in adm.columns if c not in (*KEY, *dates, ROW)]
    carried = F.when(F.col("adm_id").isNull(), F.struct(*others)).alias("_carried")
    narrow = adm.select(*KEY, *dates, ROW, carried)
    own = [c for c in rx.columns if c not in adm.columns or c == "id"]
    met = attribute_rx(rx.select(*own), narrow, agents, max_stay_days)
    m, a = met.repartition(buckets, *KEY).alias("m"), adm.alias("a")
    # The number is compared as a range, so that the key alone deals the rows.
    same = (F.col(f"m.{ROW}") <= F.col(f"a.{ROW}")) & (F.col(f"m.{ROW}") >= F.col(f"a.{ROW}"))
    for c in KEY:
        same = same & (F.col(f"m.{c}") == F.col(f"a.{c}"))
    found = {c: F.coalesce(f"a.{c}", f"m._carried.{c}").alias(c) for c in others}
    added = [c for c in met.columns if c not in (*own, *narrow.columns)]
    first = [c for c in met.columns if c in own]
    columns = [*first, *(c for c in adm.columns if c not in ("id", ROW)), *added]
    return m.join(a, same, "left").select(*(found.get(c, F.col(f"m.{c}")) for c in columns))


def attribute_tests(
    named_tests: DataFrame, adm: DataFrame, max_stay_days: int | None = None
) -> DataFrame:
    """Tests with the key and the dates of the admission they fall in."""
    bounds = adm.select(*KEY, "adm_start_date", "adm_end_date")
    return attribute_points(named_tests, bounds, max_stay_days=max_stay_days)


@dataclass(frozen=True)
class Enriched:
    """The three enriched tables."""

    admissions: DataFrame
    prescriptions: DataFrame
    tests: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Enriched:
        """The tables a call of ``save_enriched`` wrote."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def enrich(
    adm: DataFrame,
    rx: DataFrame,
    tests: DataFrame,
    agents: DataFrame,
    organisms: DataFrame,
    max_stay_days: int | None = None,
) -> Enriched:
    """All three enriched tables as lazy plans from the sources and the dimensions.

    Good for one view, whose plan then holds only what it needs. For many views
    use ``save_enriched``, which does the attribution once.
    """
    stay = longest_stay(adm) if max_stay_days is None else max_stay_days
    adm = derive_admissions(adm)
    bare = with_rx_measures(attribute_intervals(rx, adm, max_stay_days=stay))
    tested = attribute_tests(tests.select("id", "test_date", "material"), adm, stay)
    facts = admission_facts(bare, tested)
    named = attribute_tests(name_tests(tests, organisms), adm, stay)
    return _assemble(adm, with_dim(bare, agents, "atc_code"), named, facts)


def _assemble(adm, attributed_rx, attributed_tests, facts) -> Enriched:
    enriched_adm = enrich_admissions(adm, facts)
    return Enriched(
        admissions=enriched_adm,
        prescriptions=enrich_rx(attributed_rx, facts),
        tests=enrich_tests(attributed_tests, enriched_adm),
    )


@dataclass(frozen=True)
class Attributed:
    """Admissions, attributed prescriptions and tests, and facts, in buckets of the admission.

    Each attribution ran once. What joins or groups these tables by the admission key
    reads them in place, without a shuffle.
    """

    admissions: DataFrame
    prescriptions: DataFrame
    tests: DataFrame
    facts: DataFrame

    def enriched(self) -> Enriched:
        """The enriched tables as plans that start from the buckets."""
        return _assemble(self.admissions, self.prescriptions, self.tests, self.facts)


def save_attributed(
    adm: DataFrame,
    rx: DataFrame,
    tests: DataFrame,
    agents: DataFrame,
    organisms: DataFrame,
    path: str,
    max_stay_days: int | None = None,
    mode: str = "errorifexists",
    buckets: int | None = None,
) -> Attributed:
    """Write the attributed tables under ``path``, bucketed by the admission key.

    ``buckets`` is the number of files of each table; None takes the session's shuffle
    partitions. The sources are parsed and the attribution joins run once, and lost
    executors do not set the later steps back. A patient's admissions are spread over
    the buckets; one admission's rows are together.
    """
    number = buckets or default_buckets(adm.sparkSession)

    def keep(table: DataFrame, name: str) -> DataFrame:
        return write_bucketed(table, f"{path}/{name}", KEY, number, mode)

    numbered = keep(derive_admissions(adm).withColumn(ROW, F.monotonically_increasing_id()), "admissions")
    adm = numbered.drop(ROW)
    stay = longest_stay(adm) if max_stay_days is None else max_stay_days
    rx = keep(attribute_rx_by_row(rx, numbered, agents, number, stay), "prescriptions")
    tests = keep(attribute_tests(name_tests(tests, organisms), adm, stay), "tests")
    return Attributed(adm, rx, tests, keep(admission_facts(rx, tests), "facts"))


def save_enriched(
    adm: DataFrame,
    rx: DataFrame,
    tests: DataFrame,
    agents: DataFrame,
    organisms: DataFrame,
    path: str,
    max_stay_days: int | None = None,
    mode: str = "errorifexists",
    buckets: int | None = None,
) -> Enriched:
    """Write the enriched tables under ``path`` as Parquet by admission year and load them.

    What several steps need is written first, under ``stage`` (see ``save_attributed``).
    The tables keep its buckets inside each year: no row moves again, a year is split, and
    what joins or groups the loaded tables by the admission key has no shuffle.
    """
    number = buckets or default_buckets(adm.sparkSession)
    stage = save_attributed(
        adm, rx, tests, agents, organisms, f"{path}/stage", max_stay_days, mode, number
    )
    tables = stage.enriched()
    return Enriched(
        *(write_bucketed(getattr(tables, name), f"{path}/{name}", KEY, number, mode, ["year"]) for name in TABLES)
    )
