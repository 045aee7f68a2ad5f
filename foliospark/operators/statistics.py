"""Order statistics per group as window and two-level aggregate plans, for groups of any size.

Nothing gathers a group: a k-th value is a map-side limited window, a percentile counts the
values near it, a rank counts distinct values. Null values are left out; null groups are groups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 200
#: Percentile sketches: their accuracy, and the rows from which a group is cut down by them first.
ACCURACY, SMALL_GROUP = 10_000, 100_000


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left", key: Column | None = None) -> DataFrame:
    """left with right's other columns; right has a row a group (and a _key equal to `key`, if given). Null groups meet."""
    names = {b: f"_by{k}" for k, b in enumerate(by)}
    right = right.withColumnsRenamed(names)
    same = [F.col(f"`{b}`").eqNullSafe(F.col(n)) for b, n in names.items()] + ([] if key is None else [key == F.col("_key")])
    if not same:
        return left.join(F.broadcast(right), how="left", on=F.lit(True))  # one row
    return left.join(right, reduce(and_, same), how).drop(*names.values(), "_key")


def kth(df: DataFrame, value: str, k: int, by: Sequence[str] = (), largest: bool = True, name: str = "kth") -> DataFrame:
    """The k-th largest (or smallest) value of each group; groups of fewer values are absent.

    Each task sends k rows a group at most; without groups it is a distributed top-k.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias(name))
    order = F.col(name).desc() if largest else F.col(name).asc()
    if not by:
        edge = F.min(name) if largest else F.max(name)
        return rows.orderBy(order).limit(k).groupBy().agg(F.count(name).alias("_n"), edge.alias(name)).where(F.col("_n") == k).select(name)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_k") == k).drop("_k")


def rank_of(value: Column, by: Sequence[str], ascending: bool = False) -> Column:
    """1 + the number of values strictly beyond this one in its group."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value.asc() if ascending else value.desc()))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts not above the value, by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(cuts))


def quantile_cuts(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Values that cut the column into about equal parts."""
    return sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.5 / buckets)))


def counts_before(counts: DataFrame, by: Sequence[str], value: str, count: str, ascending: bool = True, name: str = "before") -> DataFrame:
    """counts with the sum of `count` over the group's rows of lesser (greater) value, which are distinct.

    Without groups the table is cut at quantiles, whose sums carry over, so that no task sees it all.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if by:
        return counts.withColumn(name, F.coalesce(F.sum(count).over(upto.partitionBy(*by)), F.lit(0)))
    cuts = quantile_cuts(counts, value)
    cut = counts.withColumn("_b", bucket_of(F.col(value), cuts))
    sums = cut.groupBy("_b").agg(F.sum(count).alias("_s"))
    every = Window.orderBy(F.col("_b").asc() if ascending else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    base = sums.select("_b", F.coalesce(F.sum("_s").over(every), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(count).over(upto.partitionBy("_b")), F.lit(0))
    return cut.join(F.broadcast(base), "_b").withColumn(name, F.col("_base") + within).drop("_b", "_base")


def ranks(df: DataFrame, value: str, by: Sequence[str] = (), ascending: bool = False, name: str = "rank") -> DataFrame:
    """by, value, rank: one row a distinct value, 1 + the number of rows of the group strictly beyond it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts_before(counts, by, value, "_n", ascending, name).select(*by, value, (F.col(name) + 1).alias(name))


def mode_first(df: DataFrame, value: str, order: str | None, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """The commonest value of each group, the earliest in order (the least without) among ties; null if none repeats."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order or value).alias("_first"))
    best = F.min_by(F.struct("_n", F.col(value).alias("v")), F.struct(-F.col("_n"), F.col("_first")))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, F.when(F.col("_b._n") > 1, F.col("_b.v")).alias(name))


def mean_deviation(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "deviation") -> DataFrame:
    """The mean distance from the mean of each group, in two aggregates."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    far = joined(rows, rows.groupBy(*by).agg(F.avg("_v").alias("_m")), by)
    return far.groupBy(*by).agg(F.avg(F.abs(F.col("_v") - F.col("_m"))).alias(name))


def at_positions(df: DataFrame, value: str, by: Sequence[str], wanted: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """by and, under each name, the value at a position (0-based, ascending) of each group, exactly.

    wanted: the position as a share of the rows, and as a function of their number, at most two
    rows apart. A sketch brackets each position in groups over SMALL_GROUP; only values inside a
    bracket are counted one by one, the rest in one sum a gap, so a group of n rows leaves about
    6 n / ACCURACY distinct values a position to sort.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    shares = sorted({s for s, _ in wanted.values()})
    edges = [F.lit(min(1.0, max(0.0, s + side * 3 / ACCURACY))) for s in shares for side in (-1, 1)]
    stats = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*edges), ACCURACY).alias("_e"))
    near = joined(rows, stats, by)
    small, v = F.col("_n") <= SMALL_GROUP, F.col("_v")
    inside = reduce(or_, [v.between(F.get("_e", F.lit(2 * k)), F.get("_e", F.lit(2 * k + 1))) for k in range(len(shares))], small)
    gap = reduce(lambda a, b: a + b, [(F.get("_e", F.lit(2 * k)) <= v).cast("int") for k in range(len(shares))])
    counted = near.groupBy(*by, F.when(inside, v).alias("_x"), F.when(~inside, gap).alias("_gap")).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.first("_n").alias("_n"))
    placed = counts_before(counted, by, "_low", "_c", name="_start")
    found = {}
    for name, (_, place) in wanted.items():
        at = place(F.col("_n"))
        found[name] = F.max(F.when((F.col("_start") <= at) & (at < F.col("_start") + F.col("_c")), F.col("_x")))
    return placed.groupBy(*by).agg(*[c.alias(k) for k, c in found.items()])


def percentiles(df: DataFrame, value: str, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """by and the exact inclusive percentiles, linearly interpolated, of each group with a value."""
    wanted = {}
    for name, p in shares.items():
        wanted[f"{name}_low"] = p, lambda n, p=p: F.floor(p * (n - 1))
        wanted[f"{name}_high"] = p, lambda n, p=p: F.least(F.floor(p * (n - 1)) + 1, n - 1)
    found = at_positions(df, value, by, wanted)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    both = joined(found, counts, by)
    out = []
    for name, p in shares.items():
        place = p * (F.col("_n") - 1)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return both.select(*by, *out)


def group_stats(df: DataFrame, by: Sequence[str], **columns: Column) -> DataFrame:
    """df with per-group aggregates: combined map-side, then joined back."""
    return joined(df, df.groupBy(*by).agg(*[c.alias(k) for k, c in columns.items()]), by)
