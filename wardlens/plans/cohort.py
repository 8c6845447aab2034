"""Cohorts: a declarative selection of prescriptions and the grains built on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import in_range, in_set
from wardlens.operators.counts import (
    admission_grain,
    admission_total,
    selector_ranges,
    selector_values,
)
from wardlens.operators.derive import with_diagnostic
from wardlens.plans.enrich import Enriched
from wardlens.schema import KEY
from wardlens.sources.buckets import write_bucketed

Range = tuple[int | None, int | None]

# Tasks that rows of one group may spread over in a join.
GROUP_PIECES = 64
# Groups that a filter compares each row with.
MAX_GROUPS = 1_000
# Accepts any value but null.
KNOWN = "known"


@dataclass(frozen=True)
class CohortSpec:
    """What to select; a field left at its default selects everything.

    Sets are sequences of values (list None to accept nulls) or ``KNOWN``;
    ranges are closed and may be open on either end as ``(2, None)``, or ``KNOWN``.
    """

    routes: Sequence | str | None = None
    first_only: bool = False
    ab_timing: Range | None = None
    agents: Sequence | str | None = None
    ab_days: Range | None = None
    course_days: Range | None = None
    origins: Sequence | str | None = None
    years: Range | str | None = None
    specialties: Sequence | str | None = None
    exclude_sub: Sequence = ()
    include_sub: Sequence = ()
    age: Range | str | None = None
    genders: Sequence | str | None = None
    min_n: int = 0
    # As for ``min_size``: None where more sub-specialties than that are expected.
    max_groups: int | None = MAX_GROUPS
    diagnostic: tuple[str, int, int] = field(default=("blood", -1, 1))

    @classmethod
    def initial(cls, **changes) -> CohortSpec:
        """The selection a user starts from.

        Known route, agent and origin, known year and age (the whole of a closed range),
        start in the stay. An unknown gender or specialty is one of the choices, so its rows
        stay.
        """
        start = {"routes": KNOWN, "agents": KNOWN, "origins": KNOWN, "years": KNOWN, "age": KNOWN}
        start["ab_timing"] = (0, None)
        return cls(**{**start, **changes})

    def predicates(self) -> list[Column]:
        sets = {
            "ab_route": self.routes,
            "ab_type": self.agents,
            "adm_route": self.origins,
            "specialty": self.specialties,
            "gender": self.genders,
        }
        ranges = {
            "ab_timing": self.ab_timing,
            "ab_days": self.ab_days,
            "ab_days_all": self.course_days,
            "year": self.years,
            "age": self.age,
        }
        chosen = [
            F.col(c).isNotNull() if isinstance(v, str) and v == KNOWN else in_set(c, v)
            for c, v in sets.items()
            if v is not None
        ]
        known = [c for c, v in ranges.items() if isinstance(v, str) and v == KNOWN]
        chosen += [F.col(c).isNotNull() for c in known]
        chosen += [
            p for c, v in ranges.items() if v and c not in known and (p := in_range(c, *v)) is not None
        ]
        if self.first_only:
            chosen.append(F.col("ab_first"))
        if self.exclude_sub:
            chosen.append(~in_set("sub_specialty", self.exclude_sub))
        if self.include_sub:
            chosen.append(in_set("sub_specialty", self.include_sub))
        return chosen


def min_size(
    cohort: DataFrame, n: int, by: str = "sub_specialty", max_groups: int | None = MAX_GROUPS
) -> DataFrame:
    """Keep the groups with at least ``n`` distinct admissions; nulls are a group.

    The groups are a subquery of the filter: nothing runs before the result does, and no
    row of the cohort moves. More than ``max_groups`` groups raise when the plan runs. For
    a column of that many values give None: the groups are joined then, any number of
    them, spread over the admissions, so that a large group does not meet in one task.
    """
    admissions = cohort.select(F.col(by).alias("_group"), *KEY).distinct()
    sizes = admissions.groupBy("_group").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") >= int(n)).select("_group")
    if max_groups is not None:
        # A struct is never null, so the group of nulls is found like any other.
        found = large.limit(max_groups + 1).agg(F.collect_list(F.struct("_group"))).scalar()
        message = F.raise_error(F.lit(f"more than {max_groups} groups of {by}; give max_groups=None to join them"))
        member = F.array_contains(found, F.struct(F.col(by).alias("_group")))
        return cohort.filter(F.when(F.size(found) > max_groups, message).otherwise(member))
    salt = F.pmod(F.xxhash64(*KEY), F.lit(GROUP_PIECES))
    pieces = F.sequence(F.lit(0).cast("long"), F.lit(GROUP_PIECES - 1).cast("long"))
    s = large.select("_group", F.explode(pieces).alias("_piece")).alias("s")
    c = cohort.withColumn("_piece", salt).alias("c")
    same = F.col(f"c.{by}").eqNullSafe(F.col("s._group")) & (F.col("c._piece") == F.col("s._piece"))
    return c.join(s, same, "left_semi").drop("_piece")


def build_cohort(rx: DataFrame, spec: CohortSpec) -> DataFrame:
    """The prescriptions that meet every condition of the spec, with ``check`` added."""
    cohort = rx
    for predicate in spec.predicates():
        cohort = cohort.filter(predicate)
    cohort = with_diagnostic(cohort, *spec.diagnostic)
    return min_size(cohort, spec.min_n, max_groups=spec.max_groups) if spec.min_n > 0 else cohort


def cohort_tests(tests: DataFrame, cohort: DataFrame, taken_only: bool = True) -> DataFrame:
    """Tests of the cohort's admissions with their ``check``, each test once.

    Only tests of admissions marked ``Taken`` unless told otherwise.
    """
    members = cohort.select(*KEY, "check")
    if taken_only:
        members = members.filter(F.col("check") == "Taken")
    return tests.join(members.distinct(), KEY)


@dataclass(frozen=True)
class Cohort:
    """A cohort and its grains; nothing runs until a view is asked for."""

    prescriptions: DataFrame
    source_tests: DataFrame | None = None
    # Written by ``save``: one row per admission, and all tests of the cohort.
    saved_admissions: DataFrame | None = None
    saved_tests: DataFrame | None = None

    @classmethod
    def of(
        cls, rx: DataFrame, tests: DataFrame | None = None, spec: CohortSpec | None = None
    ) -> Cohort:
        return cls(build_cohort(rx, spec or CohortSpec.initial()), tests)

    def admissions(self, *columns: str) -> DataFrame:
        """One row per admission, with all columns or the named ones."""
        if self.saved_admissions is not None:
            return self.saved_admissions.select(*dict.fromkeys([*KEY, *columns])) if columns else self.saved_admissions
        return admission_grain(self.prescriptions, list(columns) or None)

    def tests(self, taken_only: bool = True) -> DataFrame:
        if self.source_tests is None:
            raise ValueError("this cohort was made without tests")
        if self.saved_tests is not None:
            kept = self.saved_tests
            return kept.filter(F.col("check") == "Taken") if taken_only else kept
        return cohort_tests(self.source_tests, self.prescriptions, taken_only)

    def total(self) -> DataFrame:
        return admission_total(self.prescriptions)

    def save(self, path: str, mode: str = "errorifexists") -> Cohort:
        """Write prescriptions, admissions and tests of the cohort once, for all its views.

        The selection runs once and each grain is built once; a view then reads the columns
        it needs of the grain it works on. All three are in buckets of the admission key:
        of tables that ``save_enriched`` wrote in this session no row moves.
        """

        def kept(table: DataFrame, name: str) -> DataFrame:
            return write_bucketed(table, f"{path}/{name}", KEY, mode=mode)

        prescriptions = kept(self.prescriptions, "prescriptions")
        saved = Cohort(prescriptions, self.source_tests)
        tests = None if self.source_tests is None else kept(saved.tests(taken_only=False), "tests")
        return Cohort(prescriptions, self.source_tests, kept(saved.admissions(), "admissions"), tests)

    def cache(self) -> Cohort:
        """Keep the prescriptions for several views; spills to disk where memory is short."""
        return Cohort(self.prescriptions.persist(), self.source_tests)

    def unpersist(self) -> None:
        self.prescriptions.unpersist()


def selector_domains(enriched: Enriched) -> tuple[DataFrame, DataFrame]:
    """What a user can choose from: ranges of the numbers, values of the texts."""
    rx, adm = enriched.prescriptions, enriched.admissions
    ranges = selector_ranges(rx, ["ab_timing", "ab_days_all", "year"]).unionByName(
        selector_ranges(adm, ["age", "LOS", "bc_timing", "uc_timing"])
    )
    values = selector_values(rx, ["ab_route", "ab_type", "ab_group"]).unionByName(
        selector_values(adm, ["gender", "specialty", "sub_specialty", "adm_route"])
    )
    return ranges, values
