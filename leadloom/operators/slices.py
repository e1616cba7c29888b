"""Ordered per-key computations that do not put a hot key into one task.

A window over one key runs in one task. When a key may hold a large share of
all rows, the key is cut along its order into *slices* at quantiles of the
``position`` column, so no (key, slice) group can hold more than about one
n-th of the table. The window runs inside the slice. What a slice needs from
the slices before it comes as one extra row that sorts first in its group, so
the table itself is shuffled once and joined with nothing.

``position`` is a BIGINT or DOUBLE column that never decreases along the
order. Rows that tie on it stay together, so it should be close to unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.session import parallelism

_SLICE, _MARK = "__slice", "__mark"


def slice_bounds(df: DataFrame, position: str, pieces: int) -> list[float]:
    """At most ``pieces - 1`` quantile borders; one pass over one column."""
    shares = [i / pieces for i in range(1, pieces)]
    row = df.select(F.percentile_approx(position, shares, 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def _slice_of(position: Column, bounds: Sequence[float]) -> Column:
    """Number of borders at or below ``position``: a binary search in one constant array; a null position counts as last.

    Every step doubles what is known of the number, from its highest bit on, so
    8,000 borders take 13 steps.
    """
    if not bounds:
        return F.lit(0)
    kind = "bigint" if all(isinstance(b, int) for b in bounds) else "double"
    borders = F.split(F.lit(",".join(map(repr, bounds))), ",").cast(f"array<{kind}>")  # one literal, however many
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) <= position, at + step).otherwise(at))
    return F.when(position.isNull(), len(bounds)).otherwise(found)


def _sliced(df: DataFrame, position: str, pieces: int | None, bounds: Sequence[float] | None) -> DataFrame:
    if bounds is None:
        bounds = slice_bounds(df, position, pieces or parallelism(df.sparkSession))
    return df.withColumn(_SLICE, _slice_of(F.col(position), bounds))


def _with_carry(df: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows (mark 1) plus one carrying row per key and slice (mark 0)."""
    return df.withColumn(_MARK, F.lit(1)).unionByName(
        carried.withColumn(_MARK, F.lit(0)), allowMissingColumns=True)


def running_total(df: DataFrame, value: str | Column, order: Sequence[str], position: str, out: str,
                  keys: Sequence[str] = (), pieces: int | None = None,
                  bounds: Sequence[float] | None = None) -> DataFrame:
    """Sum of ``value`` over the rows *before* this one in (keys, order)."""
    df = _sliced(df, position, pieces, bounds).withColumn(
        "__value", F.col(value) if isinstance(value, str) else value)
    totals = df.groupBy(*keys, _SLICE).agg(F.sum("__value").alias("__total"))
    # At most one row per key and slice, so this window stays small.
    across = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _SLICE, F.sum("__total").over(across).alias("__value"))
    within = Window.partitionBy(*keys, _SLICE).orderBy(_MARK, *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = _with_carry(df, carried).withColumn(
        out, F.coalesce(F.sum("__value").over(within), F.lit(0).cast("bigint")))
    return summed.where(F.col(_MARK) == 1).drop(_SLICE, _MARK, "__value")


def number_rows(df: DataFrame, order: Sequence[str], position: str, out: str, keys: Sequence[str] = (),
                pieces: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """1-based row number along (keys, order)."""
    before = running_total(df, F.lit(1).cast("bigint"), order, position, out, keys, pieces, bounds)
    return before.withColumn(out, F.col(out) + 1)


def previous_value(df: DataFrame, value: Column, order: Sequence[str], position: str, out: str,
                   keys: Sequence[str], pieces: int | None = None,
                   bounds: Sequence[float] | None = None) -> DataFrame:
    """``value`` of the row before this one in (keys, order); NULL for the first."""
    df = _sliced(df, position, pieces, bounds).withColumn("__value", F.struct(value.alias("v")))
    last = df.groupBy(*keys, _SLICE).agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    carried = last.select(*keys, _SLICE, F.lag("__last").over(across).alias("__value"))
    within = Window.partitionBy(*keys, _SLICE).orderBy(_MARK, *order)
    lagged = _with_carry(df, carried).withColumn(out, F.lag("__value").over(within)["v"])
    return lagged.where(F.col(_MARK) == 1).drop(_SLICE, _MARK, "__value")
