"""The domain tables as projections of the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators.derive import normalize_sir, with_rx_measures
from wardlens.operators.intervals import attribute_intervals, attribute_points
from wardlens.plans.cohort import Cohort
from wardlens.plans.enrich import Attributed, Enriched, derive_admissions, save_attributed, save_enriched
from wardlens.schema import KEY
from wardlens.session import configure, scratch_path

AGENT_COLUMNS = ["amox", "cipr", "gent"]
# The bindings give stays of 3 to 30 days.
MAX_STAY_DAYS = 30
# Given tables that the domain tables are made of.
SOURCES = "{customer,part,orders,lineitem,events}.parquet"


class Tables:
    """Lazy tables of one folder; nothing is read before a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

        self._given: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._given[name]

    @cached_property
    def orders(self) -> DataFrame:
        return self.given("orders").withColumn("d", F.col("o_orderdate").cast("date"))

    @cached_property
    def admissions(self) -> DataFrame:
        customer = self.given("customer")
        nation = self.given("nation")
        region = self.given("region")
        o = (
            self.orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        patient, order = F.col("o_custkey"), F.col("o_orderkey")
        return o.select(
            patient.alias("id"),
            order.alias("adm_id"),
            F.when(patient % 23 == 0, F.lit(None))
            .when(patient % 2 == 0, "F")
            .otherwise("M")
            .alias("gender"),
            F.col("d").alias("adm_start_date"),
            F.date_add("d", (order % 28 + 3).cast("int")).alias("adm_end_date"),
            ((F.col("o_orderstatus") == "F") & (order % 5 == 0)).alias("death_during_adm"),
            F.col("o_orderpriority").alias("adm_route"),
            F.when(
                order % 31 != 0,
                F.concat("c_mktsegment", F.lit("-"), (order % 4).cast("string")),
            ).alias("sub_specialty"),
            F.col("r_name").alias("specialty"),
            F.date_add(F.lit("1920-01-01").cast("date"), (patient * 37 % 27000).cast("int")).alias(
                "birth_date"
            ),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        rows = self.given("lineitem").join(
            self.orders.select("o_orderkey", "o_custkey", "d"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).join(
            self.given("part").select("p_partkey", "p_brand"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        start = F.date_add("d", ((F.col("l_linenumber") - 1) * 3).cast("int"))
        return rows.select(
            F.col("o_custkey").alias("id"),
            start.alias("ab_start_date"),
            F.date_add(start, (F.col("l_quantity").cast("int") % 8).cast("int")).alias("ab_stop_date"),
            F.when(F.col("l_returnflag") == "A", "IV")
            .when(F.col("l_returnflag") == "R", "oral")
            .when(F.col("l_returnflag") == "N", "IM")
            .alias("ab_route"),
            F.col("p_brand").alias("atc_code"),
            (F.lit(0.5) + (F.col("l_partkey") % 6) * F.lit(0.25)).alias("ddd_per_day"),
        )

    @cached_property
    def raw_tests(self) -> DataFrame:
        event = F.col("event_id")
        rows = self.given("events").join(
            self.orders.select("o_orderkey", "o_custkey", "d"), event == F.col("o_orderkey")
        )
        return rows.select(
            F.col("o_custkey").alias("id"),
            event.alias("test_number"),
            F.date_add("d", (event % 9 - 2).cast("int")).alias("test_date"),
            F.when(event % 3 == 0, "urine").otherwise("blood").alias("material"),
            F.when(F.col("event_type") != "signup", F.col("event_type")).alias("mo"),
            F.when(event % 7 == 0, F.lit(None))
            .when(event % 5 == 0, "R")
            .when(event % 5 == 1, "I")
            .otherwise("S")
            .alias("amox"),
            F.when(event % 11 == 0, F.lit(None)).when(event % 4 == 0, "R").otherwise("S").alias("cipr"),
            F.when(event % 3 == 1, "R").when(event % 3 == 2, "I").otherwise("S").alias("gent"),
        )

    @cached_property
    def tests(self) -> DataFrame:
        return normalize_sir(self.raw_tests, AGENT_COLUMNS)

    @cached_property
    def agents(self) -> DataFrame:
        brand = F.col("p_brand")
        number = F.regexp_extract(brand, "([0-9]+)", 1).cast("int")
        return (
            self.given("part")
            .select(
                brand.alias("atc_code"),
                F.lower(brand).alias("ab_type"),
                F.concat(F.lit("G"), (number % 6).cast("string")).alias("ab_group"),
            )
            .filter(F.col("atc_code") != "Brand#25")
            .distinct()
        )

    @cached_property
    def organisms(self) -> DataFrame:
        kind = F.col("event_type")
        return (
            self.given("events")
            .select(
                kind.alias("mo"),
                F.upper(kind).alias("fullname"),
                F.concat(F.lit("F"), (F.length(kind) % 2).cast("string")).alias("family"),
            )
            .filter(F.col("mo") != "signup")
            .distinct()
        )

    @cached_property
    def agent_names(self) -> DataFrame:
        names = [("amox", "Amoxicillin"), ("cipr", "Ciprofloxacin"), ("gent", "Gentamicin")]
        return self.spark.createDataFrame(names, "agent string, agent_name string")

    # Attributed and enriched tables, as the library builds them.

    @cached_property
    def derived_admissions(self) -> DataFrame:
        return derive_admissions(self.admissions)

    @cached_property
    def attributed_rx(self) -> DataFrame:
        joined = attribute_intervals(
            self.prescriptions, self.derived_admissions, max_stay_days=MAX_STAY_DAYS
        )
        return with_rx_measures(joined)

    @cached_property
    def attributed_tests(self) -> DataFrame:
        bounds = self.admissions.select(*KEY, "adm_start_date", "adm_end_date")
        return attribute_points(self.tests, bounds, max_stay_days=MAX_STAY_DAYS)

    # Written once by the library, in buckets of the admission, where joins by it start.

    @cached_property
    def attributed(self) -> Attributed:
        return save_attributed(
            self.admissions,
            self.prescriptions,
            self.tests,
            self.agents,
            self.organisms,
            scratch_path(self.spark, "attributed"),
            max_stay_days=MAX_STAY_DAYS,
        )

    @cached_property
    def enriched(self) -> Enriched:
        return self.attributed.enriched()

    # The same tables written once to the shared folder, where the views start.

    @cached_property
    def saved(self) -> Enriched:
        return save_enriched(
            self.admissions,
            self.prescriptions,
            self.tests,
            self.agents,
            self.organisms,
            scratch_path(self.spark, "enriched"),
            max_stay_days=MAX_STAY_DAYS,
        )

    @cached_property
    def cohort(self) -> Cohort:
        chosen = Cohort.of(self.saved.prescriptions, self.saved.tests)
        return chosen.save(scratch_path(self.spark, "cohort"))


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder; an application enriches them once, for all its views."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(configure(spark, [f"{sf_dir}/{SOURCES}"]), sf_dir)
    return _TABLES[key]
