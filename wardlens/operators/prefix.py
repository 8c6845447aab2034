"""Running sums over ordered rows.

Groups are a window each. Rows of no group would all be sorted in one task: there the order
column is cut into pieces, each a window of its own, and a second window runs over one row
for each piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values of a whole-number or date column in a piece.
PIECE_VALUES = 1024
# Leading characters of a text that share a piece: the year of a period label.
PIECE_CHARS = 4
PIECE = "_piece"


def piece(df: DataFrame, at: str) -> Column:
    """A number, date or text that ascends with the column and is shared by near values."""
    kind = df.schema[at].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(at) / PIECE_VALUES)
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(at) / PIECE_VALUES)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(at).cast("date")
    if isinstance(kind, T.StringType):
        return F.substring(at, 1, PIECE_CHARS)
    return F.col(at)


def with_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    forward: dict[str, str] | None = None,
    backward: dict[str, str] | None = None,
) -> DataFrame:
    """Add sums of columns over the rows up to a value of ``at``, or from it on.

    ``forward`` and ``backward`` name the column to sum for each new one. Rows of equal
    ``at`` count together. Null values of a summed column count as nothing; ``at`` must
    not be null.
    """
    forward, backward = forward or {}, backward or {}
    if keys:
        over = Window.partitionBy(*keys)
        return df.select(
            "*",
            *(F.sum(c).over(over.orderBy(at)).alias(out) for out, c in forward.items()),
            *(F.sum(c).over(over.orderBy(F.desc(at))).alias(out) for out, c in backward.items()),
        )
    cut = df.withColumn(PIECE, piece(df, at))
    inside, over = Window.partitionBy(PIECE), Window.partitionBy()
    ends = Window.unboundedPreceding
    sums = cut.groupBy(PIECE).agg(*(F.sum(c).alias(f"_sum_{out}") for out, c in {**forward, **backward}.items()))
    starts = sums.select(
        PIECE,
        *(F.sum(f"_sum_{out}").over(over.orderBy(PIECE).rowsBetween(ends, -1)).alias(f"_from_{out}") for out in forward),
        *(F.sum(f"_sum_{out}").over(over.orderBy(F.desc(PIECE)).rowsBetween(ends, -1)).alias(f"_from_{out}") for out in backward),
    )

    def added(out: str, column: str, order: Column) -> Column:
        start, own = F.col(f"_from_{out}"), F.sum(column).over(inside.orderBy(order))
        return F.coalesce(start + own, start, own).alias(out)

    return cut.join(starts, PIECE).select(
        *df.columns,
        *(added(out, c, F.asc(at)) for out, c in forward.items()),
        *(added(out, c, F.desc(at)) for out, c in backward.items()),
    )
