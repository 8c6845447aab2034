"""Joins with dimension tables and the lookups built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions import in_set
from wardlens.schema import as_list


def checked_dim(dim: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """The dimension, a row for each key, without rows that match nothing.

    A repeated key would multiply the rows it joins. It is one row here, and reading any
    other column of it raises when the plan runs; nothing runs before. Grouping uses the
    exchange that a join by the key needs anyway, and lets the optimizer drop the join
    where no column of the dimension is used. Rows with a null key only count where
    nulls match.
    """
    keys = as_list(on)
    used = dim if null_safe else dim.dropna(subset=keys)
    others = [c for c in used.columns if c not in keys]
    message = F.raise_error(F.lit(f"dimension key {keys} is not unique"))
    grouped = used.groupBy(*keys).agg(F.count("*").alias("__rows"), *(F.first(c).alias(c) for c in others))
    return grouped.select(*keys, *(F.when(F.col("__rows") > 1, message).otherwise(F.col(c)).alias(c) for c in others))


def with_dim(
    df: DataFrame, dim: DataFrame, on: str | Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Left join on the dimension key; rows without a match keep nulls.

    A null key matches nothing, or with ``null_safe`` the null key of the
    dimension. Adaptive execution broadcasts a dimension of few bytes and splits hot
    keys of a larger one.
    """
    keys = as_list(on)
    checked = checked_dim(dim, keys, null_safe)
    if not null_safe:
        return df.join(checked, on=keys, how="left")
    d, r = df.alias("d"), checked.alias("r")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return d.join(r, same, "left").select("d.*", *(f"r.{c}" for c in dim.columns if c not in keys))


def normalize_code(
    df: DataFrame,
    col: str,
    aliases: DataFrame,
    alias: str = "alias",
    code: str = "code",
    keep_unknown: bool = True,
) -> DataFrame:
    """Replace free or outdated codes by the canonical code of an alias table.

    Case and outer blanks do not matter. Codes the table does not list stay as
    they are, or become null with ``keep_unknown=False``.
    """
    lookup = aliases.select(
        F.upper(F.trim(F.col(alias))).alias("_alias"), F.col(code).alias("_code")
    ).distinct()
    found = df.withColumn("_alias", F.upper(F.trim(F.col(col))))
    found = with_dim(found, lookup, "_alias")
    value = F.coalesce("_code", col) if keep_unknown else F.col("_code")
    return found.withColumn(col, value).drop("_alias", "_code").select(*df.columns)


def agents_in_groups(dim: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The agents that belong to the chosen groups; none chosen gives none."""
    return dim.filter(in_set("ab_group", groups)).select("ab_type", "ab_group").distinct()


def with_agent_name(df: DataFrame, names: DataFrame, agent: str = "agent") -> DataFrame:
    """Add the display name of each agent column; the code itself where it has none."""
    lookup = names.select(F.col("agent").alias(agent), F.col("agent_name"))
    return with_dim(df, lookup, agent).withColumn(
        "agent_name", F.coalesce("agent_name", agent)
    )


def agent_label(agents: Sequence[str], names: DataFrame) -> DataFrame:
    """One row ``label``: the display names in the order chosen, joined with `` & ``."""
    chosen = F.array(*(F.lit(a) for a in agents))
    parts = names.filter(in_set("agent", agents)).agg(
        F.sort_array(
            F.collect_set(F.struct(F.array_position(chosen, F.col("agent")), "agent_name"))
        ).alias("parts")
    )
    return parts.select(F.array_join("parts.agent_name", " & ").alias("label"))
