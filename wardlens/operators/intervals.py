"""Attribution of prescriptions and tests to admissions, and per-admission facts.

Rows meet on (patient, time bucket) rather than on the patient alone: an
admission is listed once for every bucket its stay touches, a prescription or
test only in the bucket of its day. Each match is found exactly once, and a
patient with very many rows is spread over the buckets instead of comparing
every event with every stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.schema import KEY, MATERIALS, TIMING_COLUMN, check_material

BUCKET_DAYS = 32
# Stays touching more buckets than this are of a class with buckets as many times wider.
BUCKETS_PER_STAY = 64


def longest_stay(adm: DataFrame, start: str = "adm_start_date", end: str = "adm_end_date") -> int:
    """Days from start to end of the longest admission."""
    return adm.agg(F.max(F.datediff(end, start))).first()[0] or 0


def _widths(max_stay_days: int) -> list[int]:
    widths = [BUCKET_DAYS]
    while widths[-1] * BUCKETS_PER_STAY < max_stay_days:
        widths.append(widths[-1] * BUCKETS_PER_STAY)
    return widths


def _stays(adm: DataFrame, start: str, end: str, widths: list[int]) -> DataFrame:
    """Admissions with the class of their length, each listed once per bucket its stay touches."""
    span = F.datediff(end, start)
    kind, width = F.lit(0), F.lit(widths[0])
    for i, narrower in enumerate(widths[:-1], 1):
        longer = span > narrower * BUCKETS_PER_STAY
        kind, width = F.when(longer, i).otherwise(kind), F.when(longer, widths[i]).otherwise(width)
    place = lambda day: F.floor(F.unix_date(day) / width).cast("int")
    stays = adm.filter(F.col(end) >= F.col(start)).withColumn("_class", kind)
    return stays.withColumn("_bucket", F.explode(F.sequence(place(start), place(end))))


def _events(events: DataFrame, day: str, widths: list[int]) -> DataFrame:
    """Events listed once per class of stays, in the bucket of their day."""
    place = lambda width: F.floor(F.unix_date(day) / width).cast("int")
    if len(widths) == 1:
        return events.withColumns({"_class": F.lit(0), "_bucket": place(widths[0])})
    slots = [F.struct(F.lit(i).alias("_class"), place(w).alias("_bucket")) for i, w in enumerate(widths)]
    return events.select("*", F.inline(F.array(*slots)))


def _inside(
    events: DataFrame,
    stays: DataFrame,
    days: tuple[str, str],
    stay: tuple[str, str],
    on: str,
    how: str,
) -> DataFrame:
    e, a = events.alias("e"), stays.alias("a")
    match = (
        (F.col(f"e.{on}") == F.col(f"a.{on}"))
        & (F.col("e._class") == F.col("a._class"))
        & (F.col("e._bucket") == F.col("a._bucket"))
        & (F.col(f"e.{days[0]}") >= F.col(f"a.{stay[0]}"))
        & (F.col(f"e.{days[1]}") <= F.col(f"a.{stay[1]}"))
    )
    kept = [F.col(f"e.{c}") for c in events.columns if c not in ("_class", "_bucket")]
    if how == "inner":
        kept += [F.col(f"a.{c}") for c in stays.columns if c not in (on, "_class", "_bucket")]
    return e.join(a, match, how).select(*kept)


def _attribute(
    events: DataFrame,
    adm: DataFrame,
    days: tuple[str, str],
    stay: tuple[str, str],
    on: str,
    max_stay_days: int | None,
) -> DataFrame:
    # A column present on both sides, such as a specialty, is the admission's.
    events = events.drop(*(c for c in events.columns if c in adm.columns and c != on))
    widths = _widths(longest_stay(adm, *stay) if max_stay_days is None else max_stay_days)
    return _inside(_events(events, days[0], widths), _stays(adm, *stay, widths), days, stay, on, "inner")


def _keep_attributed(
    events: DataFrame,
    adm: DataFrame,
    days: tuple[str, str],
    stay: tuple[str, str],
    on: str,
    max_stay_days: int | None,
) -> DataFrame:
    widths = _widths(longest_stay(adm, *stay) if max_stay_days is None else max_stay_days)
    stays = _stays(adm.select(on, *stay), *stay, widths)
    if len(widths) == 1:
        return _inside(_events(events, days[0], widths), stays, days, stay, on, "left_semi")
    # Stays of several classes may hold an event, which is kept once.
    numbered = events.withColumn("_event", F.monotonically_increasing_id())
    found = _inside(_events(numbered, days[0], widths), stays, days, stay, on, "left_semi")
    return found.dropDuplicates(["_event"]).drop("_event")


def attribute_intervals(
    rx: DataFrame,
    adm: DataFrame,
    start: str = "ab_start_date",
    stop: str = "ab_stop_date",
    adm_start: str = "adm_start_date",
    adm_end: str = "adm_end_date",
    on: str = "id",
    max_stay_days: int | None = None,
) -> DataFrame:
    """Prescriptions with the admission that contains them, both ends included.

    Prescriptions outside every admission drop out; one inside two overlapping
    admissions appears for each. ``max_stay_days`` only chooses bucket widths
    (the result does not depend on it); None measures the longest stay first.
    """
    return _attribute(rx, adm, (start, stop), (adm_start, adm_end), on, max_stay_days)


def attribute_points(
    tests: DataFrame,
    adm: DataFrame,
    day: str = "test_date",
    adm_start: str = "adm_start_date",
    adm_end: str = "adm_end_date",
    on: str = "id",
    max_stay_days: int | None = None,
) -> DataFrame:
    """Tests with the admission their day falls in, both ends included."""
    return _attribute(tests, adm, (day, day), (adm_start, adm_end), on, max_stay_days)


def rx_in_admissions(
    rx: DataFrame,
    adm: DataFrame,
    start: str = "ab_start_date",
    stop: str = "ab_stop_date",
    adm_start: str = "adm_start_date",
    adm_end: str = "adm_end_date",
    on: str = "id",
    max_stay_days: int | None = None,
) -> DataFrame:
    """The prescriptions that lie in some admission, each once and unchanged."""
    return _keep_attributed(rx, adm, (start, stop), (adm_start, adm_end), on, max_stay_days)


def tests_in_admissions(
    tests: DataFrame,
    adm: DataFrame,
    day: str = "test_date",
    adm_start: str = "adm_start_date",
    adm_end: str = "adm_end_date",
    on: str = "id",
    max_stay_days: int | None = None,
) -> DataFrame:
    """The tests that fall in some admission, each once and unchanged."""
    return _keep_attributed(tests, adm, (day, day), (adm_start, adm_end), on, max_stay_days)


def first_rx(attributed: DataFrame, start: str = "ab_start_date") -> DataFrame:
    """Earliest prescription start per admission."""
    return attributed.groupBy(*KEY).agg(F.min(start).alias("min_ab_start"))


def first_test_dates(attributed_tests: DataFrame) -> DataFrame:
    """Per admission the day of the first test of each material, in one pass."""
    return attributed_tests.groupBy(*KEY).agg(
        *(
            F.min(F.when(F.col("material") == m, F.col("test_date"))).alias(f"first_{m}")
            for m in MATERIALS
        )
    )


def days_to_first_test(
    attributed_tests: DataFrame, first: DataFrame, material: str
) -> DataFrame:
    """Days from the first prescription to the first test; negative if tested before.

    Tests are reduced to one day per admission before they meet the first
    prescription. Admissions without prescription or test drop out.
    """
    tests = (
        attributed_tests.filter(F.col("material") == check_material(material))
        .groupBy(*KEY)
        .agg(F.min("test_date").alias("_first_test"))
    )
    return tests.join(first, KEY).select(
        *KEY, F.datediff("_first_test", "min_ab_start").alias(TIMING_COLUMN[material])
    )


def with_first_flag(attributed: DataFrame, start: str = "ab_start_date") -> DataFrame:
    """Add ``ab_first``: started on the admission's earliest prescription day."""
    return (
        attributed.join(first_rx(attributed, start), KEY, "left")
        .withColumn("ab_first", F.col(start) == F.col("min_ab_start"))
        .drop("min_ab_start")
    )


def admission_dose(rx: DataFrame) -> DataFrame:
    """Sum of the doses per admission, 0 where none is known."""
    return rx.groupBy(*KEY).agg(
        F.coalesce(F.sum("ddd_per_prescription"), F.lit(0.0)).alias("ddd_total")
    )


def with_admission_dose(rx: DataFrame) -> DataFrame:
    """Add the admission's dose sum to every prescription."""
    return rx.join(admission_dose(rx), KEY, "left")
