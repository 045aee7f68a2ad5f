"""Lookups as joins: exact and wildcard VLOOKUP, approximate (as-of) VLOOKUP, MATCH and INDEX."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.criteria import wildcard_match
from .statistics import bucket_of, quantile_cuts

TABLE_ROWS = 4096  # of an approximate lookup's table in one bucket
FEW_BUCKETS = 64  # of a table that is sent to every task
LOOKUPS = 1 << 20  # rows that look up in one copy of a bucket


def normal_key(df: DataFrame, column: str) -> Column:
    """Text compares without case; numbers as doubles."""
    kind = df.schema[column].dataType
    return F.lower(column) if isinstance(kind, T.StringType) else F.col(column).cast("double") if isinstance(kind, T.NumericType) else F.col(column)


def vlookup_exact(left: DataFrame, key: str, table: DataFrame, table_key: str, values: Sequence[str], order: str | None = None) -> DataFrame:
    """left with `values` of the table's first row (in `order`) with an equal key; null where there is none."""
    rows = table.withColumn("_key", normal_key(table, table_key)).where("_key is not null")
    first = F.min_by(F.struct(*values), F.col(order)) if order else F.first(F.struct(*values))
    firsts = rows.groupBy("_key").agg(first.alias("_hit"))
    return left.withColumn("_key", normal_key(left, key)).join(firsts, "_key", "left").select(*[F.col(c) for c in left.columns], *[F.col(f"_hit.{v}").alias(v) for v in values])


def match_wildcard(table: DataFrame, column: str, pattern: str, order: str) -> DataFrame:
    """One row: the least position in `order` whose text matches a pattern with * and ?."""
    return table.agg(F.min(F.when(wildcard_match(F.col(column), pattern), F.col(order))).alias("position"))


def vlookup_approximate(left: DataFrame, key: str, table: DataFrame, table_key: str, values: Sequence[str], buckets: int | None = None) -> DataFrame:
    """left with `values` of the table's row with the greatest key not above its own (the last of equals).

    The table's rows become spans, each from its key to the next, cut at the keys' quantiles into
    buckets of about TABLE_ROWS rows that carry in the last row before them. A row finds its span
    by binary search in its bucket's sorted keys. A table of at most FEW_BUCKETS is sent to every
    task; else this is an equi-join on the bucket, of which there is a copy for every LOOKUPS rows
    counted in it, so no task has all of a crowded one. Null keys find nothing.
    Keys must be numeric and the table's in ascending order, as approximate lookups require.
    """
    keyed = table.select(F.col(table_key).cast("double").alias("_key"), F.struct(*values).alias("_hit")).where("_key is not null")
    lasts = keyed.groupBy("_key").agg(F.max(F.struct("_hit"))["_hit"].alias("_hit")) if all(isinstance(f.dataType, T.AtomicType) for f in table.select(*values).schema) else keyed.groupBy("_key").agg(F.last("_hit").alias("_hit"))
    few = False  # a number of buckets that is given says nothing of their size
    if buckets is None:
        buckets = max(1, -(-lasts.count() // TABLE_ROWS))
        few = buckets <= FEW_BUCKETS
    cuts = quantile_cuts(lasts, "_key", buckets) if buckets > 1 else []
    sorted_keys = lasts.groupBy(bucket_of(F.col("_key"), cuts).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_key", "_hit"))).alias("_rows"))
    every = table.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_b")).join(sorted_keys, "_b", "left")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    carried = every.select("_b", F.last(F.element_at("_rows", -1), ignorenulls=True).over(before).alias("_in"), "_rows")
    one = carried.select("_b", F.col("_in._hit").alias("_in"), F.transform("_rows", lambda r: r["_key"]).alias("_keys"), F.transform("_rows", lambda r: r["_hit"]).alias("_hits"))
    x = F.col(key).cast("double")
    probe = left.withColumn("_b", F.when(x.isNotNull(), bucket_of(x, cuts)))
    n = F.coalesce(F.size("_keys"), F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    none = F.struct(F.lit(0).alias("low"), n.alias("high"))
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    halved = lambda s: F.when(s["low"] >= s["high"], s).when(F.get("_keys", middle(s)) <= x, F.struct((middle(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle(s).alias("high")))
    place = F.aggregate(steps, none, lambda s, _: halved(s))["low"]
    if few:
        met = probe.join(F.broadcast(one), "_b", "left")
    else:
        counted = {r["_b"]: r["count"] for r in probe.groupBy("_b").count().collect()}  # one row a bucket
        copies = F.get(F.lit([-(-counted.get(b, 1) // LOOKUPS) for b in range(len(cuts) + 1)]), F.col("_b"))
        copied = one.withColumn("_c", F.explode(F.sequence(F.lit(0), copies - 1)))
        met = probe.withColumn("_c", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), copies).cast("int")).join(copied, ["_b", "_c"], "left")
    found = met.withColumn("_at", place)
    hit = F.when(F.col("_at") > 0, F.get("_hits", F.col("_at") - 1)).otherwise(F.col("_in"))
    return found.withColumn("_found", F.when(x.isNotNull(), hit)).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_found.{v}").alias(v) for v in values])


def index_at(table: DataFrame, order: str, position: int, columns: Sequence[str]) -> DataFrame:
    """The row at a 1-based position."""
    return table.where(F.col(order) == position).select(*columns)
