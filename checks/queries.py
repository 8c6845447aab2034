"""One query per operator, on the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.bindings import AGENT_COLUMNS, MAX_STAY_DAYS, Tables, tables
from wardlens.functions import period_label
from wardlens.operators import counts, courses, derive, diagnostics, dims, dosing, intervals
from wardlens.operators import isolates as iso
from wardlens.operators import stay, survival
from wardlens.operators.runchart import run_chart
from wardlens.plans.cohort import CohortSpec, build_cohort, cohort_tests, min_size, selector_domains
from wardlens.schema import ADMISSIONS, AGENTS, KEY, PRESCRIPTIONS
from wardlens.session import scratch_path
from wardlens.sources import coerce_dates, read_dim, read_table, read_tests, write_csv

PICK = ["id", "adm_id", "ab_start_date", "ab_stop_date", "atc_code"]

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
DIGITS: dict[str, int] = {}


def query(name: str, digits: int = 8):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = build
        DIGITS[name] = digits
        return build

    return register


def comparable(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded and days as text, so that two engines can be compared."""
    changed = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            changed[f.name] = F.round(f.name, digits)
        elif isinstance(f.dataType, T.DateType):
            changed[f.name] = F.col(f.name).cast("string")
    return df.withColumns(changed) if changed else df


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(QUERIES[name](tables(spark, sf_dir)), DIGITS[name])


def _written(t: Tables, df: DataFrame, name: str, sep: str = ",") -> str:
    path = scratch_path(t.spark, name)
    if sep == ",":
        return write_csv(df, path)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


# Sources and sinks ------------------------------------------------------


@query("read_admissions")
def _(t):
    return read_table(t.spark, _written(t, t.admissions, "admissions"), ADMISSIONS)


@query("read_prescriptions")
def _(t):
    return read_table(t.spark, _written(t, t.prescriptions, "prescriptions"), PRESCRIPTIONS)


@query("read_tests")
def _(t):
    # Two laboratories, whose files name the columns in another order.
    wards = t.admissions.select(F.col("adm_id").alias("test_number"), "specialty")
    tests = t.raw_tests.join(wards, "test_number")
    even = F.col("test_number") % 2 == 0
    one = _written(t, tests.filter(even), "tests")
    two = _written(t, tests.filter(~even).select(*sorted(tests.columns)), "tests")
    return read_tests(t.spark, [one, two])


@query("read_dim")
def _(t):
    return read_dim(t.spark, _written(t, t.agents, "agents"), AGENTS)


@query("read_delimited_semicolon")
def _(t):
    comma = F.replace(F.col("ddd_per_day").cast("string"), F.lit("."), F.lit(","))
    path = _written(t, t.prescriptions.withColumn("ddd_per_day", comma), "prescriptions2", sep=";")
    return read_table(t.spark, path, PRESCRIPTIONS, fmt="csv2")


@query("coerce_dates")
def _(t):
    days = {
        "ab_start_date": F.col("ab_start_date").cast("string"),
        "ab_stop_date": F.col("ab_stop_date").cast("timestamp"),
    }
    return coerce_dates(t.prescriptions.select(*PICK[:1], *PICK[2:]).withColumns(days))


@query("export_cohort")
def _(t):
    columns = [*PICK, "ab_type", "ab_first", "check", "LOS"]
    path = write_csv(t.cohort.prescriptions.select(*columns), scratch_path(t.spark, "cohort"))
    schema = "id long, adm_id long, ab_start_date date, ab_stop_date date, atc_code string, "
    schema += "ab_type string, ab_first boolean, check string, LOS int"
    return read_table(t.spark, path, T.StructType.fromDDL(schema), missing=(), trim=False)


@query("export_tests")
def _(t):
    columns = ["id", "adm_id", "test_number", "test_date", "material", "mo", "fullname", "first_isolate"]
    path = write_csv(t.cohort.tests().select(*columns), scratch_path(t.spark, "cohort-tests"))
    schema = "id long, adm_id long, test_number long, test_date date, material string, "
    schema += "mo string, fullname string, first_isolate boolean"
    return read_table(t.spark, path, T.StructType.fromDDL(schema), missing=(), trim=False)


@query("export_view")
def _(t):
    view = counts.count_by(t.cohort.admissions("sub_specialty"), "sub_specialty")
    path = write_csv(view, scratch_path(t.spark, "view"), single_file=True)
    schema = T.StructType.fromDDL("sub_specialty string, n long")
    return read_table(t.spark, path, schema, missing=(), trim=False)


# Derived columns ---------------------------------------------------------


@query("adm_calendar")
def _(t):
    rows = derive.with_calendar(t.admissions, "adm_start_date", "adm", year="year")
    return rows.select(*KEY, "adm_start_date", "year", "yearmonth_adm", "yearquarter_adm")


@query("test_calendar")
def _(t):
    rows = derive.with_calendar(t.tests, "test_date", "test")
    return rows.select("test_number", "test_date", "yearmonth_test", "yearquarter_test")


@query("length_of_stay")
def _(t):
    return derive.with_los(t.admissions).select(*KEY, "LOS")


@query("age_at_admission")
def _(t):
    return derive.with_age(t.admissions).select(*KEY, "age")


@query("ab_days")
def _(t):
    return t.attributed_rx.select(*PICK, "ab_days")


@query("ab_timing")
def _(t):
    return t.attributed_rx.select(*PICK, "ab_timing")


@query("ddd_per_prescription")
def _(t):
    return t.attributed_rx.select(*PICK, "ddd_per_prescription")


@query("normalize_sir")
def _(t):
    # Spoiled case and padding; the columns are then found by their content.
    spoiled = {c: F.concat(F.lit(" "), F.lower(c)) for c in AGENT_COLUMNS}
    found = derive.normalize_sir(t.raw_tests.withColumns(spoiled))
    return found.select("test_number", *derive.sir_columns(found))


@query("normalize_organism")
def _(t):
    events = t.given("events").join(t.orders, F.col("event_id") == F.col("o_orderkey"))
    codes = events.select(
        F.col("event_id").alias("test_number"), F.concat(F.upper("event_type"), F.lit(" ")).alias("mo")
    )
    aliases = t.organisms.select(F.col("fullname").alias("alias"), F.col("mo").alias("code"))
    return dims.normalize_code(codes, "mo", aliases)


@query("sir_columns")
def _(t):
    return derive.sir_profile(t.raw_tests)


@query("sir_long")
def _(t):
    return derive.sir_long(t.tests).select("test_number", "agent", "interpretation")


@query("agent_name")
def _(t):
    named = dims.with_agent_name(derive.sir_long(t.tests), t.agent_names)
    return named.groupBy("agent_name", "interpretation").agg(F.count("*").alias("n"))


@query("diagnostic_flag")
def _(t):
    return derive.with_diagnostic(t.enriched.admissions, "urine", 0, 2).select(*KEY, "uc_timing", "check")


@query("discharge_event")
def _(t):
    return derive.with_discharge_event(t.admissions).select(*KEY, "event")


@query("year_as_text")
def _(t):
    adm = t.cohort.admissions("year", "LOS")
    return stay.los_histogram(adm.withColumn("year", period_label("year", "year")), "year")


@query("period_label")
def _(t):
    return t.tests.select(
        "test_number",
        period_label("test_date", "month").alias("month_label"),
        period_label("test_date", "quarter").alias("quarter_label"),
    )


@query("rename_group")
def _(t):
    table = counts.count_by(t.cohort.admissions("sub_specialty"), "sub_specialty")
    return counts.relabel(table, {"sub_specialty": "Subspecialty"}, ["Subspecialty", "n"])


@query("percent_text")
def _(t):
    adm = t.cohort.admissions("specialty", "check")
    return diagnostics.diagnostic_table(adm, "specialty", percent_text=True)


@query("dynamic_group")
def _(t):
    parts = [
        counts.count_by(t.saved.prescriptions, by).select(
            F.lit(by).alias("by_column"), F.col(by).cast("string").alias("group_value"), "n"
        )
        for by in ("specialty", "adm_route", "gender", "year", "ab_group")
    ]
    return reduce(DataFrame.unionByName, parts)


# Filters -----------------------------------------------------------------


def _filter_query(name: str, column: str | None = None, **fields) -> None:
    @query(name)
    def _(t):
        return build_cohort(t.saved.prescriptions, CohortSpec(**fields)).select(*PICK, *([column] if column else []))


_filter_query("f_route", "ab_route", routes=["IV", "oral"])
_filter_query("f_first_only", "ab_first", first_only=True)
_filter_query("f_ab_timing", "ab_timing", ab_timing=(2, 9))
_filter_query("f_ab_type", "ab_type", agents=["brand#1", "brand#12", "brand#25"])
_filter_query("f_ab_days", "ab_days", ab_days=(2, None))
_filter_query("f_course_days", "ab_days_all", course_days=(3, 10))
_filter_query("f_origin", "adm_route", origins=["1-URGENT", "5-LOW"])
_filter_query("f_year", "year", years=(1996, 1998))
_filter_query("f_specialty", "specialty", specialties=["ASIA", "EUROPE"])
_filter_query("f_exclude_subspecialty", "sub_specialty", exclude_sub=["BUILDING-1", "MACHINERY-0"])
_filter_query("f_include_subspecialty", "sub_specialty", include_sub=["BUILDING-1", "MACHINERY-0"])
_filter_query("f_age", "age", age=(18, 65))
_filter_query("f_gender", "gender", genders=["F", None])
_filter_query("f_min_patients", "sub_specialty", min_n=600)
_filter_query("f_diagnostic", "check", diagnostic=("urine", -2, 0))


@query("semi_min_n")
def _(t):
    return counts.count_by(min_size(t.saved.prescriptions, 600), "sub_specialty")


@query("f_tests_taken")
def _(t):
    return t.cohort.tests().select(
        "id", "adm_id", "test_number", "test_date", "material", "mo", "check"
    )


@query("f_first_isolate_material")
def _(t):
    return iso.first_isolates(t.saved.tests, "urine").select("id", "adm_id", "test_number", "test_date", "mo")


@query("f_isolate_name")
def _(t):
    chosen = iso.first_isolates(t.saved.tests, "blood", organisms=["CLICK", "ERROR"])
    return chosen.select("id", "adm_id", "test_number", "fullname")


@query("f_material")
def _(t):
    first = intervals.first_rx(t.attributed_rx)
    blood = intervals.days_to_first_test(t.attributed_tests, first, "blood")
    urine = intervals.days_to_first_test(t.attributed_tests, first, "urine")
    return blood.join(urine, KEY, "full")


@query("f_not_null_agent")
def _(t):
    return counts.distinct_values(t.saved.prescriptions.filter(F.col("ab_type").isNotNull()), "ab_type", "ab_group")


@query("expand_groups")
def _(t):
    return dims.agents_in_groups(t.agents, ["G1", "G4"])


# Joins -------------------------------------------------------------------


@query("contain_join")
def _(t):
    bounds = t.admissions.select(*KEY, "adm_start_date", "adm_end_date")
    return intervals.attribute_intervals(t.prescriptions, bounds, max_stay_days=MAX_STAY_DAYS).select(
        *PICK, "ab_route", "ddd_per_day", "adm_start_date", "adm_end_date"
    )


@query("point_join")
def _(t):
    return t.attributed_tests.select(
        "id", "adm_id", "test_number", "test_date", "material", "mo", "adm_start_date", "adm_end_date"
    )


@query("join_organism")
def _(t):
    return dims.with_dim(t.tests, t.organisms, "mo").select("test_number", "mo", "fullname", "family")


@query("join_agent")
def _(t):
    return dims.with_dim(t.attributed_rx, t.agents, "atc_code").select(*PICK, "ab_type", "ab_group")


@query("join_timing")
def _(t):
    return t.enriched.admissions.select(*KEY, "bc_timing", "uc_timing")


@query("join_first_rx")
def _(t):
    tests = t.attributed_tests.join(intervals.first_rx(t.attributed_rx), KEY)
    return tests.select(
        *KEY, "test_number", "min_ab_start", F.datediff("test_date", "min_ab_start").alias("days")
    )


@query("semi_tests")
def _(t):
    kept = intervals.tests_in_admissions(t.tests, t.admissions, max_stay_days=MAX_STAY_DAYS)
    return kept.select("test_number", "id", "test_date", "material")


@query("semi_rx")
def _(t):
    kept = intervals.rx_in_admissions(t.prescriptions, t.admissions, max_stay_days=MAX_STAY_DAYS)
    return kept.select("id", "ab_start_date", "ab_stop_date", "atc_code", "ab_route")


@query("join_adm_on_tests")
def _(t):
    return t.enriched.tests.select(
        *KEY, "test_number", "test_date", "specialty", "sub_specialty", "year", "age", "LOS",
        "bc_timing", "uc_timing", "first_isolate", "fullname",
    )


@query("join_adm_on_rx")
def _(t):
    return t.enriched.prescriptions.select(
        *PICK, "gender", "specialty", "sub_specialty", "adm_route", "year", "LOS", "age",
        "bc_timing", "uc_timing",
    )


@query("join_course")
def _(t):
    return courses.with_course(t.attributed.prescriptions).select(*PICK, "ab_start_cont", "ab_stop_cont", "ab_days_all")


@query("join_los_back")
def _(t):
    doses = dosing.dose_per_admission(t.cohort.prescriptions, ["ab_group"])
    return doses.select(*KEY, "ab_group", "LOS", F.try_divide("ddd_sum", "LOS").alias("ddd_per_day"))


@query("semi_cohort_tests")
def _(t):
    tests = cohort_tests(t.saved.tests, t.cohort.prescriptions, taken_only=False)
    return tests.select(*KEY, "test_number", "test_date", "check")


def _versus_query(name: str, by: str) -> None:
    @query(name)
    def _(t):
        return diagnostics.diagnostic_vs_average(t.cohort.admissions(by, "check"), by)


_versus_query("join_overall", "specialty")
_versus_query("diagnostic_vs_average", "sub_specialty")
_versus_query("overall_rate", "adm_route")


# Aggregations ------------------------------------------------------------


@query("first_rx")
def _(t):
    return intervals.first_rx(t.attributed_rx)


@query("days_to_first_test")
def _(t):
    return intervals.days_to_first_test(t.attributed_tests, intervals.first_rx(t.attributed_rx), "blood")


@query("group_min_filter")
def _(t):
    return intervals.days_to_first_test(t.attributed_tests, intervals.first_rx(t.attributed_rx), "urine")


@query("agent_domain")
def _(t):
    return counts.agent_domain(t.saved.prescriptions)


@query("group_domain")
def _(t):
    return counts.distinct_values(t.saved.prescriptions, "ab_group", sort=True, nulls=False)


@query("agent_group_pairs")
def _(t):
    return counts.distinct_values(t.saved.prescriptions, "ab_type", "ab_group")


@query("selector_ranges")
def _(t):
    return selector_domains(t.saved)[0]


@query("selector_values")
def _(t):
    return selector_domains(t.saved)[1]


@query("admission_total")
def _(t):
    return t.cohort.total()


@query("distinct_admissions")
def _(t):
    return t.cohort.admissions(*PICK[2:], "ab_route", "ab_type", "ab_group", "specialty", "LOS", "check")


@query("patients_by_subspecialty")
def _(t):
    return counts.count_by(t.cohort.admissions("sub_specialty"), "sub_specialty", top=10)


@query("top_10")
def _(t):
    by = ["specialty", "sub_specialty"]
    return counts.count_by(t.cohort.admissions(*by), by, top=10)


@query("subspecialty_table")
def _(t):
    return counts.count_by(t.cohort.admissions("sub_specialty"), "sub_specialty")


@query("age_distribution")
def _(t):
    return counts.count_by(t.cohort.admissions("age", "gender"), ["age", "gender"])


@query("admissions_per_period")
def _(t):
    return counts.count_by(t.cohort.admissions("yearmonth_adm"), "yearmonth_adm")


@query("prescriptions_by")
def _(t):
    return counts.count_by(t.cohort.prescriptions, "ab_group")


@query("reorder_desc")
def _(t):
    return counts.order_by(counts.count_by(t.cohort.prescriptions, "ab_type"), desc="n", asc="ab_type")


@query("order_desc")
def _(t):
    return counts.order_by(counts.count_by(t.cohort.prescriptions, "adm_route"), desc="n", asc="adm_route")


@query("order_asc")
def _(t):
    return counts.distinct_values(t.saved.tests, "fullname", sort=True, nulls=False)


@query("distinct_rows")
def _(t):
    return counts.distinct_values(
        t.cohort.prescriptions, "specialty", "sub_specialty", "adm_route", "gender"
    )


@query("n_distinct_groups")
def _(t):
    return counts.n_groups(t.cohort.admissions("sub_specialty"), "sub_specialty")


@query("dose_density")
def _(t):
    return dosing.dose_density(t.cohort.prescriptions, "ab_group")


@query("dose_density_pooled")
def _(t):
    return dosing.dose_density(t.cohort.prescriptions, "ab_group", method="pooled")


@query("dose_table", digits=2)
def _(t):
    return dosing.dose_density(t.cohort.prescriptions, "sub_specialty", digits=2)


@query("dose_per_admission")
def _(t):
    return dosing.dose_per_admission(t.cohort.prescriptions)


@query("dose_timeseries")
def _(t):
    return dosing.dose_timeseries(t.cohort.prescriptions, "ddd", "yearmonth_adm", "specialty")


@query("dose_timeseries_dot")
def _(t):
    return dosing.dose_timeseries(t.cohort.prescriptions, "dot", "yearquarter_adm")


@query("run_chart")
def _(t):
    monthly = counts.count_by(
        t.cohort.admissions("sub_specialty", "yearmonth_adm"), ["sub_specialty", "yearmonth_adm"]
    )
    return run_chart(monthly, x="yearmonth_adm", y="n", facet="sub_specialty")


@query("run_chart_daily")
def _(t):
    daily = t.cohort.admissions("adm_start_date").groupBy("adm_start_date").agg(F.count("*").alias("n"))
    return run_chart(daily, x="adm_start_date", y="n")


@query("diagnostics_per_period")
def _(t):
    adm = t.cohort.admissions("yearquarter_adm", "check")
    return diagnostics.diagnostics_per_period(adm, "yearquarter_adm", proportion=True)


@query("diagnostic_timing")
def _(t):
    return diagnostics.diagnostic_timing(t.cohort.admissions("bc_timing", "check"), "blood")


@query("diagnostic_table", digits=1)
def _(t):
    return diagnostics.diagnostic_table(t.cohort.admissions("specialty", "check"), "specialty")


def _cohort_isolates(t: Tables) -> DataFrame:
    return iso.first_isolates(t.cohort.tests(), "blood")


def _all_isolates(t: Tables) -> DataFrame:
    return t.saved.tests.filter("first_isolate")


@query("isolate_frequency")
def _(t):
    return iso.isolate_frequency(_cohort_isolates(t), "specialty", top=12)


@query("top_n")
def _(t):
    return iso.isolate_frequency(iso.first_isolates(t.saved.tests, "urine"), top=3)


@query("isolate_freq_table")
def _(t):
    return iso.isolate_frequency(_cohort_isolates(t), "sub_specialty")


@query("sir_counts")
def _(t):
    return iso.sir_counts(_cohort_isolates(t), "amox", "fullname")


@query("sir_portions")
def _(t):
    return iso.sir_portions(_cohort_isolates(t), ["amox", "cipr"], "specialty")


@query("co_resistance")
def _(t):
    return iso.co_resistance(_all_isolates(t), ["amox", "cipr"], "fullname")


@query("co_resistance_share")
def _(t):
    return iso.co_resistance(_all_isolates(t), ["amox", "cipr"], "fullname", proportion=True)


@query("resistance_timeseries")
def _(t):
    return iso.resistance_timeseries(_all_isolates(t), "amox", "yearquarter_test")


@query("resistance_table")
def _(t):
    label = dims.agent_label(["gent"], t.agent_names).first()["label"]
    return iso.resistance_table(_cohort_isolates(t), "gent", "specialty", label=label)


@query("resistance_table_co")
def _(t):
    agents = ["amox", "cipr"]
    label = dims.agent_label(agents, t.agent_names).first()["label"]
    return iso.resistance_table(_all_isolates(t), agents, "year", calc="portion", label=label)


@query("resistance_table_text")
def _(t):
    return iso.resistance_table(_all_isolates(t), "amox", "yearquarter_test", calc="portion", as_text=True)


@query("los_histogram")
def _(t):
    return stay.los_histogram(t.cohort.admissions("specialty", "LOS"), "specialty", zoom=(5, 20))


@query("los_density")
def _(t):
    return stay.los_density(t.cohort.admissions("specialty", "LOS"), "specialty", grid=(0, 35, 1))


@query("los_ridges")
def _(t):
    return stay.los_ridges(t.cohort.admissions("specialty", "LOS"), "specialty", grid=(0, 40, 0.5))


@query("los_summary", digits=1)
def _(t):
    return stay.los_summary(t.cohort.admissions("ab_group", "LOS"), "ab_group")


# Window functions --------------------------------------------------------


@query("ddd_total")
def _(t):
    return intervals.with_admission_dose(t.attributed.prescriptions).select(*PICK, "ddd_total")


@query("ab_first")
def _(t):
    return intervals.with_first_flag(t.attributed.prescriptions).select(*PICK, "ab_first")


@query("first_course")
def _(t):
    return courses.first_course(t.attributed_rx)


@query("all_courses")
def _(t):
    return courses.all_courses(t.attributed_rx, tolerance=1)


@query("share_in_group")
def _(t):
    table = counts.count_by(t.cohort.prescriptions, ["gender", "ab_group"])
    return counts.with_share(table, within="gender")


@query("share_of_total")
def _(t):
    return counts.with_share(counts.count_by(t.cohort.prescriptions, "ab_type"))


@query("first_isolate")
def _(t):
    return iso.first_isolate(t.tests).select("test_number", "id", "mo", "test_date", "material", "first_isolate")


# Survival ----------------------------------------------------------------


def _at_risk(t: Tables, strata: str) -> DataFrame:
    adm = t.cohort.admissions(strata, "LOS", "death_during_adm")
    return derive.with_discharge_event(adm)


@query("km_curve")
def _(t):
    return survival.km_curve(_at_risk(t, "specialty"), strata="specialty")


@query("km_display_window")
def _(t):
    return survival.km_curve(_at_risk(t, "check"), strata="check", xlim=(5, 20))


@query("logrank_table")
def _(t):
    return survival.logrank_table(_at_risk(t, "specialty"), strata="specialty")


@query("logrank_test")
def _(t):
    return survival.logrank_test(_at_risk(t, "ab_route"), strata="ab_route")
