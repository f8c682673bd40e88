"""Running sums that survive a hot key.

A window over one key sorts all its rows in one task. `running_sums` cuts each key's order into buckets first, and the
buckets into coarser ones, as often as the caller says: sums per bucket, running totals of buckets inside a coarser one,
and so on up to one window over a key's coarsest buckets. Every window is small and there are many; the result equals
that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], *buckets: Column) -> DataFrame:
    """df and, for each of `values`, its running sum over `keys` in `order`.

    `buckets` go from fine to coarse. None may decrease along the order, and rows of one bucket share all coarser ones.
    """
    names, levels = list(values), [f"_bucket{i}" for i in range(len(buckets))]
    rows = df.withColumns({f"_v_{n}": v for n, v in values.items()} | dict(zip(levels, buckets, strict=True)))
    sums = rows.groupBy(*keys, *levels).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names))
    before = _before(sums, keys, levels, names)
    inside = Window.partitionBy(*keys, levels[0]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in names}).join(before, [*keys, levels[0]])
    return rows.select(*df.columns, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in names))


def _before(sums: DataFrame, keys: list[str], levels: list[str], names: list[str]) -> DataFrame:
    """Per key and bucket of the finest level, the sums of all buckets before it."""
    fine, coarse = levels[0], levels[1:2]
    earlier = Window.partitionBy(*keys, *coarse).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    own = sums.select(*keys, fine, *coarse, *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names))
    if not coarse:
        return own
    up = sums.groupBy(*keys, *levels[1:]).agg(*(F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names))
    far = _before(up, keys, levels[1:], names).withColumnsRenamed({f"_b_{n}": f"_f_{n}" for n in names})
    return own.join(far, [*keys, *coarse]).select(*keys, fine, *((F.col(f"_b_{n}") + F.col(f"_f_{n}")).alias(f"_b_{n}") for n in names))
