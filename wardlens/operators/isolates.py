"""First isolates, their frequency, susceptibility and co-resistance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import in_set, percent_text, period_label
from wardlens.operators.runchart import run_chart
from wardlens.schema import SIR, as_list, check_by, check_material

EPISODE_DAYS = 365
# Identical copies of a test are counted as one row and written out again in
# pieces of this many, which spread over the tasks.
COPIES_PER_PIECE = 4096
PERIOD_KIND = {"yearmonth_test": "month", "yearquarter_test": "quarter"}


def _episode_starts(days: Column, episode_days: int) -> Column:
    """Of sorted days, those more than an episode after the last one kept."""
    fresh = lambda last, d: last.isNull() | (F.datediff(d, last) > episode_days)
    return F.aggregate(
        days,
        F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept")),
        lambda acc, d: F.when(
            fresh(acc["last"], d),
            F.struct(d.alias("last"), F.concat(acc["kept"], F.array(d)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def episode_starts(
    tests: DataFrame,
    by_material: bool = False,
    episode_days: int = EPISODE_DAYS,
    patient: str = "id",
    organism: str = "mo",
    day: str = "test_date",
) -> DataFrame:
    """Per patient and organism the sorted days on which an episode begins, as ``_starts``.

    Only days travel, each once from a task: a patient and organism has at most as many
    as the calendar.
    """
    group = [patient, organism] + (["material"] if by_material else [])
    dated = tests.select(*group, F.col(day).cast("date").alias("_date")).dropna()
    days = dated.groupBy(*group).agg(F.sort_array(F.collect_set("_date")).alias("_days"))
    return days.select(*group, _episode_starts(F.col("_days"), episode_days).alias("_starts"))


def first_isolate(
    tests: DataFrame,
    by_material: bool = False,
    episode_days: int = EPISODE_DAYS,
    patient: str = "id",
    organism: str = "mo",
    day: str = "test_date",
) -> DataFrame:
    """Add ``first_isolate``: true once per patient, organism and episode.

    An episode lasts ``episode_days`` from its first isolate; the next isolate
    after it opens a new one. Of several on that day the first is the smallest by
    test number and then by the other columns in order; of identical copies of a
    test one is first. Tests without organism are never first. Whole rows meet the
    first days once; only those of first days are compared and counted.
    """
    columns = tests.columns
    group = [patient, organism] + (["material"] if by_material else [])
    known = F.lit(True)
    for c in (*group, day):
        known = known & F.col(c).isNotNull()
    others = [c for c in columns if c not in (*group, day)]
    order = sorted(others, key=lambda c: c != "test_number")
    starts = episode_starts(tests, by_material, episode_days, patient, organism, day)
    marked = (
        tests.filter(known)
        .join(starts, group)
        .select(*columns, F.array_contains("_starts", F.col(day)).alias("_hit"))
    )
    hits = marked.filter("_hit").select(*columns)
    firsts = hits.groupBy(*group, day).agg(F.min(F.struct(*order)).alias("_row"))
    size = F.lit(COPIES_PER_PIECE)
    last_piece = F.floor((F.col("_copies") - 1) / size)
    counted = (
        hits.groupBy(*columns)
        .agg(F.count("*").alias("_copies"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last_piece)))
        .withColumn("_copies", F.least(size.cast("long"), F.col("_copies") - F.col("_piece") * size))
    )
    t, f = counted.alias("t"), firsts.alias("f")
    # Structs compare as equal where the same fields are null. The piece is part
    # of the struct and so of the shuffle key: copies spread, the first piece
    # alone meets the first isolate.
    whole = F.struct(*(F.col(f"t.{c}") for c in order), F.col("t._piece"))
    first = F.struct(
        *(F.col(f"f._row.{c}") for c in order), F.lit(0).cast("long").alias("_piece")
    )
    on = [F.col(f"t.{c}") == F.col(f"f.{c}") for c in (*group, day)] + [whole == first]
    flagged = (
        t.join(f, on, "left")
        .select("t.*", F.col("f._row").isNotNull().alias("_first"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(*columns, (F.col("_first") & (F.col("_copy") == 1)).alias("first_isolate"))
    )
    never = F.lit(False).alias("first_isolate")
    later = marked.filter("not _hit").select(*columns, never)
    rest = tests.filter(~known).select(*columns, never)
    return flagged.unionByName(later).unionByName(rest)


def first_isolates(
    tests: DataFrame, material: str, organisms: Sequence[str] | None = None
) -> DataFrame:
    """The first isolates of one material, of all or of the named organisms."""
    if organisms is not None and not as_list(organisms):
        raise ValueError("choose at least one organism")
    chosen = tests.filter(
        F.col("first_isolate") & (F.col("material") == check_material(material))
    )
    return chosen if organisms is None else chosen.filter(in_set("fullname", as_list(organisms)))


def isolate_frequency(
    isolates: DataFrame, by: str | Sequence[str] | None = None, top: int | None = None
) -> DataFrame:
    """Isolates per organism and group, most frequent first; ``top`` counts over all groups."""
    keys = ["fullname"] + [c for c in check_by(by) if c != "fullname"]
    counts = isolates.groupBy(*keys).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), *keys)
    return ordered if top is None else ordered.limit(top)


def _need_agents(agents: str | Sequence[str]) -> list[str]:
    chosen = as_list(agents)
    if not chosen:
        raise ValueError("choose at least one agent")
    return chosen


def sir_counts(
    isolates: DataFrame,
    agents: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    combine_si: bool = False,
) -> DataFrame:
    """Isolates per group, agent and interpretation; interpretations not seen count 0.

    With ``combine_si`` the interpretations are ``SI`` and ``R``. Counting is
    one aggregation of the wide rows; only its result is turned to long form.
    """
    keys, agents = check_by(by), _need_agents(agents)
    kinds = (("SI", ("S", "I")), ("R", ("R",))) if combine_si else tuple((s, (s,)) for s in SIR)
    counted = isolates.groupBy(*keys).agg(
        *(F.count_if(F.col(a).isin(*members)).alias(f"{a}:{kind}") for a in agents for kind, members in kinds)
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(a).alias("agent"),
                F.lit(kind).alias("interpretation"),
                F.col(f"`{a}:{kind}`").alias("value"),
            )
            for a in agents
            for kind, _ in kinds
        )
    )
    return counted.select(*keys, F.inline(rows))


def sir_portions(
    isolates: DataFrame,
    agents: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    minimum: int = 30,
    combine_si: bool = True,
) -> DataFrame:
    """Share of each interpretation among the tested; null below ``minimum`` tested."""
    keys, agents = check_by(by), _need_agents(agents)
    kinds = (("SI", ("S", "I")), ("R", ("R",))) if combine_si else tuple((s, (s,)) for s in SIR)
    counted = isolates.groupBy(*keys).agg(
        *(F.count(F.when(F.col(a).isin(*SIR), 1)).alias(f"{a}:n") for a in agents),
        *(F.count_if(F.col(a).isin(*members)).alias(f"{a}:{kind}") for a in agents for kind, members in kinds),
    )
    tested = {a: F.col(f"`{a}:n`") for a in agents}
    rows = F.array(
        *(
            F.struct(
                F.lit(a).alias("agent"),
                F.lit(kind).alias("interpretation"),
                F.when(tested[a] >= minimum, F.try_divide(F.col(f"`{a}:{kind}`"), tested[a])).alias("value"),
            )
            for a in agents
            for kind, _ in kinds
        )
    )
    return counted.select(*keys, F.inline(rows))


def co_resistance(
    isolates: DataFrame,
    agents: Sequence[str],
    by: str | Sequence[str] | None = None,
    proportion: bool = False,
    minimum: int = 30,
) -> DataFrame:
    """Isolates resistant to all chosen agents among those tested for all of them.

    Gives ``n_tested`` and ``value``: the count, or the share, which is null
    below ``minimum`` tested.
    """
    keys, agents = check_by(by), _need_agents(agents)
    tested = resistant = F.lit(True)
    for a in agents:
        tested = tested & in_set(a, SIR)
        resistant = resistant & in_set(a, ["R"])
    counted = isolates.groupBy(*keys).agg(
        F.count_if(tested).alias("n_tested"), F.count_if(resistant).alias("value")
    )
    if not proportion:
        return counted
    share = F.try_divide("value", "n_tested")
    return counted.withColumn("value", F.when(F.col("n_tested") >= minimum, share))


def resistance_timeseries(
    isolates: DataFrame, agents: Sequence[str], period: str = "yearmonth_test"
) -> DataFrame:
    """Run chart per interpretation of the S, I, R counts, or of the co-resistant count."""
    agents = _need_agents(agents)
    check_by(period, ("year", "yearmonth_test", "yearquarter_test"))
    if len(agents) == 1:
        counts = sir_counts(isolates, agents, period)
    else:
        counts = co_resistance(isolates, agents, period).withColumn("interpretation", F.lit("R"))
    return run_chart(counts, x=period, y="value", facet="interpretation")


def resistance_table(
    isolates: DataFrame,
    agents: Sequence[str],
    by: str | Sequence[str],
    calc: str = "count",
    label: str | None = None,
    minimum: int = 30,
    as_text: bool = False,
    isolate: str | None = None,
) -> DataFrame:
    """One row per group, one column per interpretation.

    ``isolate`` names the organisms chosen in a column of that name, left out where the
    groups are organisms.

    One agent gives ``SI`` and ``R``; several give ``R``, the isolates
    resistant to all of them. ``label`` is the agent text shown, see
    ``agent_label``. ``as_text`` writes portions as percentages and months and
    quarters by name.
    """
    if calc not in ("count", "portion"):
        raise ValueError("calc must be 'count' or 'portion'")
    keys, agents = check_by(by), _need_agents(agents)
    text = F.lit(label or " & ".join(agents)).alias("agent")
    if len(agents) > 1:
        kinds = ["R"]
        table = co_resistance(isolates, agents, keys, calc == "portion", minimum)
        table = table.withColumnRenamed("value", "R")
    else:
        kinds = ["SI", "R"]
        long = (
            sir_counts(isolates, agents, keys, combine_si=True)
            if calc == "count"
            else sir_portions(isolates, agents, keys, minimum, combine_si=True)
        )
        table = long.groupBy(*keys).pivot("interpretation", kinds).agg(F.first("value"))
    if as_text:
        named = {k: period_label(k, PERIOD_KIND[k]) for k in keys if k in PERIOD_KIND}
        if calc == "portion":
            named.update({k: percent_text(F.col(k) * 100.0) for k in kinds})
        table = table.withColumns(named) if named else table
    named = [F.lit(isolate).alias("isolate")] if isolate and "fullname" not in keys else []
    return table.select(*keys, *named, text, *kinds)
