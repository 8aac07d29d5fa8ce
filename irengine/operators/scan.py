"""Exact running totals that no single task has to compute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES = 256


def bounds(df: DataFrame, order: str, pieces: int = PIECES) -> list:
    """At most ``pieces`` - 1 cut points that part the values of ``order`` evenly; they steer work, never results."""
    q = [i / pieces for i in range(1, pieces)]
    cuts = df.agg(F.percentile_approx(order, q, 1000).alias("q")).first().q
    return sorted(set(cuts or []))


def piece_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts lie below the value, by halving; 0 for a null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def running_total(df: DataFrame, order: str, values: dict[str, Column], keys: tuple[str, ...] = (), pieces: int = PIECES) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum over all earlier rows (by ``order``, within ``keys``).

    Rows that are equal in ``order`` and ``keys`` don't see each other. Totals of pieces
    (keys x at most ``pieces`` ranges of ``order``) are summed first, then rows within
    their piece, so that a hot key or an empty key list is shared by many tasks.
    """
    cuts = bounds(df, order, pieces)
    dealt = df.withColumn("__piece", piece_of(F.col(order), cuts))
    totals = dealt.groupBy(*keys, "__piece").agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "__piece", *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__piece").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*keys, "__piece", order)
    # null-safe: rows of a null key have totals, too
    right = base.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__piece").alias("__right"), *[f"__base_{n}" for n in values])
    met = F.col("__piece") == F.col("__right")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = dealt.join(right, met)
    added = {n: F.col(f"__base_{n}") + F.sum(v).over(inside) - F.sum(v).over(same) for n, v in values.items()}
    return out.select(*df.columns, *[c.alias(n) for n, c in added.items()])
