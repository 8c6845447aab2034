"""Care-pattern analytics on Spark: admissions, antimicrobial use and microbiology."""

from wardlens.plans.cohort import KNOWN, Cohort, CohortSpec, build_cohort, cohort_tests
from wardlens.plans.enrich import Enriched, enrich
from wardlens.session import configure

__all__ = [
    "KNOWN",
    "Cohort",
    "CohortSpec",
    "Enriched",
    "build_cohort",
    "cohort_tests",
    "configure",
    "enrich",
]
