"""Streaming extension: the aggregate formulas over event-time windows, and first-report losses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import Context
from ..plans.compile import Compiler, Plan, aggregated, result_columns
from ..plans.syntax import parse


def windowed_formulas(events: DataFrame, time: str, width: str, formulas: Mapping[str, str], by: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """One row per window and group with a column per formula; events later than `late` are left out.

    Only decomposable formulas suit an unbounded stream: the state holds partial aggregates.
    """
    plan = Plan(streaming=True)
    compiler = Compiler(events.schema, plan, Context())
    columns = [c for name, f in formulas.items() for c in result_columns(compiler.scalar(parse(f)), name, False)]
    span = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = aggregated(events.withWatermark(time, late), plan, [span.alias("window"), *by])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *columns)


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Session windows per key with their number of events."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_losses(losses: DataFrame, time: str, keep: str = "1 hour") -> DataFrame:
    """Each (severity, feature, detail) once within the watermark."""
    return losses.withWatermark(time, keep).dropDuplicatesWithinWatermark(["severity", "feature", "detail"])
