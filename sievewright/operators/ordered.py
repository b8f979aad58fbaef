"""Running sums and ranks over a whole table in order, without a task that sees it all.

Rows are range-partitioned by the full order and written once, so that the
ranges stand; a range's totals give the sums before it, and a window inside
each range does the rest.  Only rows equal in all of the order can not part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.sources.scratch import written

RANGE = "_range"


def ranged(rows: DataFrame, by: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, the number of their range in the order (by, order), from a table in the shared folder.

    ``ranges`` is how many there are at most; the session's shuffle partitions if
    not given.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *[F.col(c) if isinstance(c, str) else c for c in order]]
    return written(rows.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()), "ranged")


def offsets(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows (by, _range, <name>_before, <name>_all): of each sum, what earlier ranges of the group hold, and all of them.

    As long as the groups plus the ranges, as a range's end is all that two
    groups or two ranges share.
    """
    totals = rows.groupBy(*by, RANGE).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    before = w.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = [x for name in sums for x in (F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before"), F.sum(name).over(w).alias(f"{name}_all"))]
    return totals.select(*by, RANGE, *parts)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right of equal keys, nulls equal."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def running(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], ranges: int | None = None, totals: bool = False) -> DataFrame:
    """Adds a column for each of ``sums``: the sum of the group's rows up to and with this one in the order.

    With ``totals`` also <name>_all, the group's whole sum.  Rows that are equal
    in all of the order are taken in any order.
    """
    d = ranged(rows, by, order, ranges)
    w = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumns({f"_i_{name}": F.sum(c).over(w) for name, c in sums.items()})
    out = same_keys(inside, offsets(d, by, sums), [*by, RANGE])
    out = out.withColumns({name: F.col(f"{name}_before") + F.col(f"_i_{name}") for name in sums})
    return out.drop(RANGE, *[f"_i_{n}" for n in sums], *[f"{n}_before" for n in sums], *([] if totals else [f"{n}_all" for n in sums]))


def ranked(rows: DataFrame, order: list[Column | str], by: list[str] = (), name: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds each row's place from 1 in the order, over the whole table or within groups of any size."""
    return running(rows, list(by), order, {name: F.lit(1).cast("long")}, ranges)
