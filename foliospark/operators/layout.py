"""Layout reconstruction from positioned text runs: lines, words, paragraphs, columns, running heads.

Runs have doc_id, page, run_idx, x, y, end_x, font_size and text; y grows downwards. Every
window is partitioned by document and page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_DRIFT, WORD_GAP, STEP_GAP, TAB_GAP, PARAGRAPH_GAP = 0.5, 0.25, 0.12, 2.5, 1.5
HEAD_SHARE, HEAD_DRIFT = 0.6, 4.0
_PAGE = ("doc_id", "page")


def cluster_lines(runs: DataFrame) -> DataFrame:
    """runs with line: a run starts a new line when its baseline leaves the line's first by over half its size.

    The test is against the cluster's start, which no fixed window frame can express, so each
    page (a bounded group) is read once in order.
    """
    schema = T.StructType([*runs.drop("line").schema.fields, T.StructField("line", T.IntegerType())])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "run_idx"], kind="stable")
        lines, start, n = [], None, -1
        for y, size in zip(pdf["y"], pdf["font_size"], strict=True):
            if start is None or abs(y - start) > max(1.0, LINE_DRIFT * size):
                start, n = y, n + 1
            lines.append(n)
        return pdf.assign(line=pd.array(lines, dtype="int32"))

    return runs.groupBy(*_PAGE).applyInPandas(assign, schema)


def lines_by_gap(runs: DataFrame) -> DataFrame:
    """runs with line by gaps between neighbours; equal to cluster_lines where baselines do not creep."""
    w = Window.partitionBy(*_PAGE).orderBy("y", "x", "run_idx")
    new = (F.col("y") - F.lag("y").over(w)) > F.greatest(F.lit(1.0), LINE_DRIFT * F.col("font_size"))
    return runs.withColumn("line", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))


def stepped_pages(runs: DataFrame) -> DataFrame:
    """Pages that step between words: at least eight runs, under one in twenty with white space."""
    spaced = F.avg(F.col("text").rlike(r"\s").cast("double"))
    return runs.groupBy(*_PAGE).agg(((F.count("*") >= 8) & (spaced < 0.05)).alias("stepped"))


def line_texts(runs: DataFrame) -> DataFrame:
    """One row per line: x, y, end_x, font_size, text with blanks and tabs from the gaps between runs."""
    with_pages = runs.join(stepped_pages(runs), list(_PAGE))
    w = Window.partitionBy(*_PAGE, "line").orderBy("x", "run_idx")
    right = F.max("end_x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("x") - right) / F.col("font_size")
    mark = F.when(gap >= TAB_GAP, "\t").when(gap >= F.when(F.col("stepped"), STEP_GAP).otherwise(WORD_GAP), " ").otherwise("")
    pieces = with_pages.withColumn("_piece", F.concat(F.coalesce(mark, F.lit("")), F.col("text")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x", "run_idx", "_piece"))), lambda s: s["_piece"])
    return pieces.groupBy(*_PAGE, "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("end_x").alias("end_x"), F.max("font_size").alias("font_size"), F.array_join(texts, "").alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines with paragraph: a new one after a wide gap, a tab, or a line that stopped over a quarter short."""
    w = Window.partitionBy(*_PAGE).orderBy("line")
    page = Window.partitionBy(*_PAGE)
    left, right = F.min("x").over(page), F.max("end_x").over(page)
    short = (right - F.lag("end_x").over(w)) > 0.25 * (right - left)
    wide = (F.col("y") - F.lag("y").over(w)) > PARAGRAPH_GAP * F.col("font_size")
    new = F.coalesce(wide | short | F.col("text").contains("\t"), F.lit(False))
    return lines.withColumn("_new", new).withColumn("paragraph", F.sum(F.col("_new").cast("int")).over(w)).drop("_new")


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def median_font(runs: DataFrame) -> DataFrame:
    """(doc_id, median_font), the upper median over a document, by counts so that no list is gathered."""
    counts = runs.groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("font_size")
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    placed = counts.withColumns({"upto": F.sum("n").over(w), "half": F.floor(total / 2)})
    return placed.where("upto > half").groupBy("doc_id").agg(F.min("font_size").alias("median_font"))


def running_heads(lines: DataFrame, at_top: bool = True) -> DataFrame:
    """(doc_id, y, share, numbered): first (last) lines at one height on most pages of a document."""
    w = Window.partitionBy(*_PAGE).orderBy(F.col("y").asc() if at_top else F.col("y").desc(), "x")
    edge = lines.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    pages = edge.withColumns({"_n": F.count("*").over(Window.partitionBy("doc_id")), "_y": F.percentile("y", F.lit(0.5)).over(Window.partitionBy("doc_id"))})
    near = pages.where(F.abs(F.col("y") - F.col("_y")) <= HEAD_DRIFT)
    out = near.groupBy("doc_id").agg(F.round(F.first("_y"), 6).alias("y"), (F.count("*") / F.first("_n")).alias("share"), (F.countDistinct("text") > 1).alias("numbered"), F.first("_n").alias("pages"))
    return out.where((F.col("share") >= HEAD_SHARE) & (F.col("pages") > 1)).drop("pages")


def gutters(runs: DataFrame, ems: float = 3.0) -> DataFrame:
    """(doc_id, page, left, right): vertical bands no run touches, at least `ems` wide, between runs."""
    w = Window.partitionBy(*_PAGE).orderBy("x", "end_x")
    reach = F.max("end_x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = runs.withColumn("_reach", reach)
    return gaps.where(F.col("x") - F.col("_reach") >= ems * F.col("font_size")).select(*_PAGE, F.col("_reach").alias("left"), F.col("x").alias("right"))


def links_over_runs(runs: DataFrame, links: DataFrame) -> DataFrame:
    """runs with href of a link rectangle that holds the run's middle; an equi-join by page, then a range test."""
    boxes = links.select(*_PAGE, "x0", "y0", "x1", "y1", "href")
    mid = (F.col("x") + F.col("end_x")) / 2
    hits = runs.join(boxes, list(_PAGE)).where(mid.between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    first = hits.groupBy(*_PAGE, "run_idx").agg(F.min("href").alias("href"))
    return runs.join(first, [*_PAGE, "run_idx"], "left")


def greedy_breaks(widths: Iterator[float], measure: float, space: float) -> list[int]:
    """Indexes of the words that start a line, filling each line as far as it goes."""
    out, used = [], 0.0
    for k, w in enumerate(widths):
        if k and used + space + w <= measure:
            used += space + w
        else:
            out.append(k)
            used = w
    return out


def best_breaks(widths: list[float], measure: float, space: float) -> list[int]:
    """Line starts of least total squared slack over all lines but the last."""
    n = len(widths)
    best = [0.0] + [float("inf")] * n
    back = [0] * (n + 1)
    for end in range(1, n + 1):
        used = -space
        for start in range(end - 1, -1, -1):
            used += space + widths[start]
            if used > measure and start < end - 1:
                break
            slack = 0.0 if end == n else max(0.0, measure - used) ** 2 + (1e6 * (used - measure) if used > measure else 0.0)
            if best[start] + slack < best[end]:
                best[end], back[end] = best[start] + slack, start
    out, k = [], n
    while k:
        k = back[k]
        out.append(k)
    return out[::-1]


# --- columns, tables and reading order ------------------------------------------------------

ROW_DRIFT, VOTES, VOTE_STEP, MERGE_STEP, STOP_DRIFT = 0.6, 12, 4.0, 1.5, 10.0


def rows_at(runs: DataFrame, ems: float = ROW_DRIFT) -> DataFrame:
    """runs with row: a gap of over `ems` font sizes between neighbouring baselines starts a new one."""
    w = Window.partitionBy(*_PAGE).orderBy("y", "x", "run_idx")
    new = (F.col("y") - F.lag("y").over(w)) > ems * F.col("font_size")
    return runs.withColumn("row", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))


def voted_gutters(lines_of_runs: DataFrame, step: float = VOTE_STEP, votes: int = VOTES) -> DataFrame:
    """(doc_id, page, left, right): places where lines part, by votes.

    runs with line. A sampled x splits a line if it lies in a gap between its runs, else it crosses
    it where the line reaches that far; a gutter is x that splits `votes` lines or more and is
    crossed by fewer than it splits, and samples within 1.5 steps of one another are one gutter.
    Gaps and lines count by their two ends, summed by place before a page's places are run through.
    """
    w = Window.partitionBy(*_PAGE, "line").orderBy("x", "run_idx")
    reach = F.max("end_x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines_of_runs.withColumn("_reach", reach)
    low, high = lambda c: F.ceil(c / step), lambda c: F.floor(c / step)
    gaps = marked.where(F.col("_reach") < F.col("x")).select(*_PAGE, low(F.col("_reach")).alias("a"), high(F.col("x")).alias("b"), F.lit(1).alias("s"), F.lit(0).alias("e"))
    reached = marked.groupBy(*_PAGE, "line").agg(low(F.min("x")).alias("a"), high(F.max("end_x")).alias("b")).select(*_PAGE, "a", "b", F.lit(0).alias("s"), F.lit(1).alias("e"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("s"), F.col("e")), F.struct(F.col("b").alias("k"), (-F.col("s")).alias("s"), (-F.col("e")).alias("e"))))
    events = gaps.union(reached).where("b > a").select(*_PAGE, ends.alias("v")).groupBy(*_PAGE, F.col("v.k").alias("k")).agg(F.sum("v.s").alias("s"), F.sum("v.e").alias("e"))
    page = Window.partitionBy(*_PAGE).orderBy("k")
    counted = events.select(*_PAGE, "k", (F.lead("k").over(page) - 1).alias("to"), F.sum("s").over(page).alias("s"), F.sum("e").over(page).alias("e"))
    good = counted.where((F.col("s") >= votes) & (F.col("e") - F.col("s") < F.col("s")) & F.col("to").isNotNull())
    new = F.coalesce(F.col("k") - F.lag("to").over(page) > MERGE_STEP, F.lit(True))
    islands = good.withColumn("_new", new).withColumn("_g", F.sum(F.col("_new").cast("int")).over(page))
    return islands.groupBy(*_PAGE, "_g").agg((F.min("k") * step).alias("left"), (F.max("to") * step).alias("right")).drop("_g")


def tabbed_rows(lines: DataFrame) -> DataFrame:
    """lines with table: the number of a run of two or more lines with the same number (two or more) of tab stops, each near the first line's.

    lines: doc_id, page, line, font_size, stops (the x of each stop). Nearness is to the run's
    first line, which no fixed window frame can express, so each page is read once in order.
    """
    schema = T.StructType([*lines.drop("table").schema.fields, T.StructField("table", T.IntegerType())])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line", kind="stable")
        found: list[int | None] = [None] * len(pdf)
        stops, sizes = [list(s) if s is not None else [] for s in pdf["stops"]], pdf["font_size"].tolist()
        k = n = 0
        while k < len(found):
            end = k + 1
            near = max(sizes[k], STOP_DRIFT)
            while end < len(found) and len(stops[k]) >= 2 and len(stops[end]) == len(stops[k]) and all(abs(a - b) <= near for a, b in zip(stops[k], stops[end], strict=True)):
                end += 1
            if end - k >= 2:
                found[k:end] = [n] * (end - k)
                n += 1
            k = end
        return pdf.assign(table=pd.array(found, dtype="Int32"))

    return lines.groupBy(*_PAGE).applyInPandas(mark, schema)


def reading_kind(pages: DataFrame) -> DataFrame:
    """(doc_id, reading): positional where the upper median page has over a mark a line, else flow.

    pages: doc_id, page, marks (drawn rules, pictures, boxes), lines.
    """
    ratio = F.col("marks") / F.greatest(F.col("lines"), F.lit(1))
    counts = pages.withColumn("_r", ratio.cast("double")).groupBy("doc_id", "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("doc_id").orderBy("_r")
    placed = counts.withColumns({"_upto": F.sum("_n").over(w), "_half": F.floor(F.sum("_n").over(Window.partitionBy("doc_id")) / 2)})
    return placed.where("_upto > _half").groupBy("doc_id").agg(F.when(F.min("_r") > 1, "positional").otherwise("flow").alias("reading"))


def in_reading_order(blocks: DataFrame, gutters_: DataFrame) -> DataFrame:
    """blocks with place: columns from left to right, each from top to bottom. blocks: doc_id, page, x, y."""
    cuts = gutters_.groupBy(*_PAGE).agg(F.array_sort(F.collect_list((F.col("left") + F.col("right")) / 2)).alias("_cuts"))
    column = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col("x")))
    w = Window.partitionBy("doc_id").orderBy("page", "_column", "y", "x")
    return blocks.join(cuts, list(_PAGE), "left").withColumn("_column", column).withColumn("place", F.row_number().over(w)).drop("_cuts", "_column")


def page_numbers(rows: DataFrame, limit: float, by: tuple[str, ...] = ("sheet",), repeat: float = 0.0, scale: float = 1.0) -> DataFrame:
    """by, row, page: rows filled greedily into pages of `limit`, titles of height `repeat` first on each after the first.

    rows: by, row, height, break_before. A row taller than a page has one to itself. The fill
    depends on all rows before, so each sheet is read once in order.
    """
    schema = T.StructType([*[rows.schema[b] for b in by], rows.schema["row"], T.StructField("page", T.IntegerType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        page, used, out = 0, 0.0, []
        for height, cut in zip(pdf["height"].tolist(), pdf["break_before"].tolist(), strict=True):
            h = height * scale
            if out and (cut or used + h > limit + 1e-9):
                page, used = page + 1, repeat * scale
            used += h
            out.append(page)
        return pdf[[*by, "row"]].assign(page=pd.array(out, dtype="int32"))

    return rows.groupBy(*by).applyInPandas(fill, schema)


def drawn_rules(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """runs with underlined and struck: whether a thin drawn rule runs under, or through, most of a run.

    rules: doc_id, page, x0, x1, y. Under is up to a fifth of the size below the baseline,
    through a fifth to a half above it. An equi-join by page, then a range test.
    """
    near = runs.join(rules.select(*_PAGE, F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("y").alias("_y")), list(_PAGE))
    cover = F.least("end_x", "_b") - F.greatest("x", "_a")
    off = (F.col("_y") - F.col("y")) / F.col("font_size")
    hits = near.where(cover >= 0.5 * (F.col("end_x") - F.col("x"))).groupBy(*_PAGE, "run_idx").agg(F.bool_or(off.between(0, 0.2)).alias("underlined"), F.bool_or(off.between(-0.5, -0.2)).alias("struck"))
    return runs.join(hits, [*_PAGE, "run_idx"], "left").select(*runs.columns, F.coalesce("underlined", F.lit(False)).alias("underlined"), F.coalesce("struck", F.lit(False)).alias("struck"))


def aligned(lines: DataFrame, least: int = 2, drift: float = 2.0) -> DataFrame:
    """(doc_id, page, paragraph, alignment): by which edges or middles of a paragraph's lines agree; left where nothing else holds."""
    spread = lambda c: F.max(c) - F.min(c)
    stats = lines.groupBy(*_PAGE, "paragraph").agg(F.count("*").alias("_n"), spread(F.col("x")).alias("_l"), spread(F.col("end_x")).alias("_r"), spread((F.col("x") + F.col("end_x")) / 2).alias("_m"))
    kind = F.when(F.col("_n") < least, "left").when((F.col("_l") <= drift) & (F.col("_r") <= drift), "justify").when(F.col("_l") <= drift, "left").when(F.col("_m") <= drift, "center").when(F.col("_r") <= drift, "right").otherwise("left")
    return stats.select(*_PAGE, "paragraph", kind.alias("alignment"))
