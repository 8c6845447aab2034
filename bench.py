"""Time the queries: one JSON line with seconds per query, each measured after one warm-up run.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the threads
(default 8), ``BENCH_QUERIES`` a comma list of queries, or ``all``. ``enrich_and_save``
is the time to attribute, enrich and save all tables, ``cohort_and_save`` to select the
initial cohort and save its grains, ``attribute_and_keep`` to write the
attributed tables and facts in buckets of the admission (a part of the first, done again);
the queries start from what these wrote, or from the given tables. ``first_run`` holds the
times of the warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402

from checks.bindings import Tables, tables  # noqa: E402
from checks.queries import QUERIES, run  # noqa: E402

HEADLINE = [
    "contain_join",
    "point_join",
    "join_agent",
    "first_course",
    "days_to_first_test",
    "ddd_total",
    "first_isolate",
    "join_adm_on_rx",
    "join_adm_on_tests",
    "f_course_days",
    "f_min_patients",
    "f_tests_taken",
    "admission_total",
    "distinct_admissions",
    "subspecialty_table",
    "dose_density",
    "dose_per_admission",
    "dose_timeseries",
    "diagnostic_vs_average",
    "isolate_frequency",
    "sir_portions",
    "co_resistance",
    "resistance_timeseries",
    "los_density",
    "los_summary",
    "km_curve",
    "logrank_test",
    "run_chart",
]


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def step_seconds(given: Tables, step: str) -> float:
    begin = time.perf_counter()
    getattr(given, step)
    return round(time.perf_counter() - begin, 3)


# Steps whose results the queries start from.
STEPS = {"enrich_and_save": "saved", "attribute_and_keep": "attributed", "cohort_and_save": "cohort"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if names == "all" else [n for n in names.split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wardlens-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    given = tables(spark, sf_dir)
    cold = {name: step_seconds(given, step) for name, step in STEPS.items()}
    cold.update({name: seconds(spark, name, sf_dir) for name in chosen})
    fresh = Tables(spark, sf_dir)
    warm = {name: step_seconds(fresh, step) for name, step in STEPS.items()}
    warm.update({name: seconds(spark, name, sf_dir) for name in chosen})
    print(
        json.dumps(
            {
                "metric": "total seconds, warm: enriching and saving the tables, then each query",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": cold,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
