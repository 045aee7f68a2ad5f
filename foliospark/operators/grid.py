"""Sparse grids: cells, addresses, areas, merges, used ranges, banding, shared strings, slicers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import parse_cell

MAX_COLUMNS, MAX_ROWS, MAX_CELLS = 16384, 50000, 1_000_000
ROW_BUCKET = 1024


def column_letters(col: Column) -> Column:
    """0-based column numbers to letters (up to three), in closed form."""
    n = col.cast("int") + 1
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter((n - 1) % 26)
    two = letter((F.floor((n - 1) / 26) - 1) % 26)
    three = letter((F.floor((n - 27) / 676) - 1) % 26)
    return F.concat(F.when(n > 702, three).otherwise(""), F.when(n > 26, two).otherwise(""), one)


def cell_address(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))


def address_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^\$?[A-Za-z]{1,3}\$?(\d+)$", 1).try_cast("int") - 1


def address_column(ref: Column) -> Column:
    letters = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?\d+$", 1))
    n = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(letters != "", n - 1)


def parse_area(text: str) -> tuple[int, int, int, int] | None:
    """The box (r0, c0, r1, c1) around a comma list of areas; qualifiers and $ are dropped."""
    boxes = []
    for part in text.split(","):
        ends = part.rsplit("!", 1)[-1].strip().split(":")
        try:
            cells = [parse_cell(e) for e in ends]
        except ValueError:
            return None
        boxes += [(c[0], c[1]) for c in cells]
    rows, cols = [r for r, _ in boxes], [c for _, c in boxes]
    return min(rows), min(cols), max(rows), max(cols)


def in_area(row: Column, col: Column, area: tuple[int, int, int, int]) -> Column:
    return row.between(area[0], area[2]) & col.between(area[1], area[3])


def to_cells(df: DataFrame, row: Column, columns: Sequence[str] | None = None, sheet: Column | None = None) -> DataFrame:
    """A table as sparse cells (sheet, row, col, kind, num, str, bool); null values have no cell."""
    columns = list(columns or df.columns)
    items = []
    for k, c in enumerate(columns):
        kind, x = df.schema[c].dataType, F.col(c)
        is_num, is_bool = isinstance(kind, T.NumericType), isinstance(kind, T.BooleanType)
        items.append(F.struct(
            F.lit(k).alias("col"), F.lit("num" if is_num else "bool" if is_bool else "str").alias("kind"),
            (x.cast("double") if is_num else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if is_num or is_bool else x.cast("string")).alias("str"),
            (x if is_bool else F.lit(None).cast("boolean")).alias("bool"), x.isNotNull().alias("full"),
        ))
    long = df.select((sheet if sheet is not None else F.lit(0)).alias("sheet"), row.cast("int").alias("row"), F.explode(F.array(*items)).alias("c"))
    return long.where("c.full").select("sheet", "row", "c.col", "c.kind", "c.num", "c.str", "c.bool")


def used_range(cells: DataFrame) -> DataFrame:
    """Per sheet the last row and column with content, and the number of cells."""
    full = (F.col("kind") != "str") | (F.coalesce(F.col("str"), F.lit("")) != "")
    return cells.where(full).groupBy("sheet").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"), F.count("*").alias("n_cells"))


def over_limit(cells: DataFrame) -> DataFrame:
    """Losses: sheets that exceed the grid's limits in columns, rows or cells."""
    size = used_range(cells).withColumns({"cols": F.col("last_col") + 1, "rows": F.col("last_row") + 1})
    found = F.array(
        F.when(F.col("cols") > MAX_COLUMNS, F.concat(F.lit("columns "), "cols")),
        F.when(F.col("rows") > MAX_ROWS, F.concat(F.lit("rows "), "rows")),
        F.when(F.col("cols").cast("bigint") * F.col("rows") > MAX_CELLS, F.concat(F.lit("cells "), (F.col("cols").cast("bigint") * F.col("rows")).cast("string"))),
    )
    return size.select("sheet", F.explode(F.array_compact(found)).alias("detail")).select("sheet", F.lit("dropped").alias("severity"), F.lit("sheet.grid").alias("feature"), "detail")


def range_join(cells: DataFrame, ranges: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """cells with `values` of the first range (in `order`) of their sheet that covers them; null if none does.

    ranges: sheet, r0, c0, r1, c1 inclusive. Both sides meet by blocks of rows, so this is an
    equi-join on (sheet, block); a range is repeated once for each block it spans.
    """
    blocks = F.sequence(F.floor(F.col("r0") / ROW_BUCKET), F.floor(F.col("r1") / ROW_BUCKET))
    spread = ranges.select("sheet", "r0", "c0", "r1", "c1", F.struct(F.col(order).alias("_o"), *values).alias("_v"), F.explode(blocks).alias("_b"))
    keyed = cells.withColumns({"_b": F.floor(F.col("row") / ROW_BUCKET), "_id": F.struct("sheet", "row", "col")})
    hits = (
        keyed.select("sheet", "row", "col", "_b")
        .join(spread, ["sheet", "_b"])
        .where("row between r0 and r1 and col between c0 and c1")
        .groupBy("sheet", "row", "col")
        .agg(F.min("_v").alias("_v"))
    )
    return cells.join(hits, ["sheet", "row", "col"], "left").select(*cells.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def without_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells that are not covered by a merge, except at its origin."""
    marked = range_join(cells, merges.withColumns({"m_row": F.col("r0"), "m_col": F.col("c0")}), ["m_row", "m_col"], "r0")
    return marked.where("m_row is null or (row = m_row and col = m_col)").drop("m_row", "m_col")


def decode_shared(cells: DataFrame, index: str, strings: DataFrame, name: str = "text") -> DataFrame:
    """cells with their shared string; an index outside the dictionary is empty text.

    The dictionary grows with the workbook, so the join is left to adaptive execution.
    """
    words = strings.select(F.col("idx").alias("_idx"), F.col("text").alias(name))
    out = cells.join(words, cells[index] == F.col("_idx"), "left").drop("_idx")
    return out.withColumn(name, F.when(F.col(index).isNotNull(), F.coalesce(name, F.lit(""))))


def band(order: Column, by: Sequence[str], header_rows: int = 1, size: int = 1) -> Column:
    """0 or 1 for alternating bands of `size` rows after the header; null in the header."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1 - header_rows
    return F.when(n >= 0, F.floor(n / size) % 2).cast("int")


def slicer_items(df: DataFrame, label: str, order: str, by: Sequence[str] = (), limit: int = 256) -> DataFrame:
    """The first `limit` distinct labels of each group in order of appearance (the limit is the slicer's)."""
    firsts = df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(*by, label).agg(F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("first", label))
    return firsts.withColumn("item", place).where(F.col("item") <= limit).select(*by, "item", label)


def column_bands(widths: Sequence[float], room: float, breaks: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Column runs (first, last) filled greedily to a page's width; breaks start a new run."""
    bands, start, used = [], 0, 0.0
    for k, w in enumerate(widths):
        if k > start and (used + w > room or k in breaks):
            bands.append((start, k - 1))
            start, used = k, 0.0
        used += w
    return [*bands, (start, len(widths) - 1)] if len(widths) else []


def lerp_colour(a: str, b: str, f: Column) -> Column:
    from .conditional import colour_text

    return colour_text([F.lit(float(int(a[k : k + 2], 16))) + (int(b[k : k + 2], 16) - int(a[k : k + 2], 16)) * f for k in (0, 2, 4)])


def nice_scale(low: Column, high: Column, ticks: int = 6) -> Column:
    """Struct (min, max, step) of a rounded axis with five per cent of headroom."""
    lo, top = F.least(low, high), F.greatest(low, high)
    hi = F.when(lo == top, lo + 1).otherwise(top)
    raw = (hi - lo) / max(1, ticks - 1)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    f = raw / unit
    step = F.when(f < 1.5, 1.0).when(f < 3, 2.0).when(f < 7, 5.0).otherwise(10.0) * unit
    room = F.when(hi > 0, hi * 1.05).otherwise(hi)
    return F.struct((F.floor(lo / step) * step).alias("min"), (F.ceil(room / step) * step).alias("max"), step.alias("step"))


#: The parts of a table style, weakest first.
STYLE_PARTS = ("wholeTable", "band1Vert", "band2Vert", "band1Horz", "band2Horz", "lastCol", "firstCol", "lastRow", "firstRow", "nwCell", "neCell", "swCell", "seCell")


def table_parts(row: Column, col: Column, rows: Column, cols: Column, header: bool = True, totals: bool = False, first: bool = False, last: bool = False, row_bands: bool = True, column_bands_: bool = False, size: int = 1) -> Column:
    """The style parts that apply to a cell of a table (0-based place), weakest first."""
    top, end = (1 if header else 0), rows - (1 if totals else 0)
    body = (row >= top) & (row < end)
    side = (1 if first else 0)
    on = {
        "wholeTable": F.lit(True), "band1Vert": body & (F.floor((col - side) / size) % 2 == 0) & F.lit(column_bands_) & (col >= side), "band2Vert": body & (F.floor((col - side) / size) % 2 == 1) & F.lit(column_bands_) & (col >= side),
        "band1Horz": body & (F.floor((row - top) / size) % 2 == 0) & F.lit(row_bands), "band2Horz": body & (F.floor((row - top) / size) % 2 == 1) & F.lit(row_bands), "lastCol": (col == cols - 1) & F.lit(last), "firstCol": (col == 0) & F.lit(first),
        "lastRow": (row == rows - 1) & F.lit(totals), "firstRow": (row == 0) & F.lit(header), "nwCell": (row == 0) & (col == 0) & F.lit(header and first), "neCell": (row == 0) & (col == cols - 1) & F.lit(header and last), "swCell": (row == rows - 1) & (col == 0) & F.lit(totals and first), "seCell": (row == rows - 1) & (col == cols - 1) & F.lit(totals and last),
    }
    return F.array_compact(F.array(*[F.when(on[p], p) for p in STYLE_PARTS]))


def styled(parts: Column, style: dict[str, dict[str, str]], prop: str) -> Column:
    """One property of a table style for a cell: that of its strongest part that sets it."""
    out = F.lit(None).cast("string")
    for part in STYLE_PARTS:
        if prop in style.get(part, {}):
            out = F.when(F.array_contains(parts, part), style[part][prop]).otherwise(out)
    return out


SPARK_POINTS = 1000


def spark_series(cells: DataFrame, hosts: DataFrame) -> DataFrame:
    """hosts with points: the numbers of each host's area row by row, null for a gap, at most 1000.

    hosts: sheet, host, r0, c0, r1, c1. Places are expanded and meet the cells in an equi-join.
    """
    area = hosts.withColumn("_w", F.col("c1") - F.col("c0") + 1).withColumn("_n", F.least((F.col("r1") - F.col("r0") + 1) * F.col("_w"), F.lit(SPARK_POINTS)))
    places = area.select("sheet", "host", "r0", "c0", "_w", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    at = places.select("sheet", "host", "_k", (F.col("r0") + F.floor(F.col("_k") / F.col("_w"))).cast("int").alias("row"), (F.col("c0") + F.col("_k") % F.col("_w")).cast("int").alias("col"))
    met = at.join(cells.where("kind = 'num'").select("sheet", "row", "col", "num"), ["sheet", "row", "col"], "left")
    points = met.groupBy("sheet", "host").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "num"))), lambda p: p["num"]).alias("points"))
    return hosts.join(points, ["sheet", "host"])


def spark_extent(points: Column) -> Column:
    """low and span of a series; a flat one has span 1, one without a number none."""
    low, high = F.array_min(F.array_compact(points)), F.array_max(F.array_compact(points))
    return F.struct(low.alias("low"), F.when(high > low, high - low).when(low.isNotNull(), 1.0).alias("span"))


def table_slicer_items(slicers: DataFrame, tables: DataFrame, filters: DataFrame, cells: DataFrame, limit: int = 256) -> DataFrame:
    """sheet, slicer, item, label, selected: the distinct values of each slicer's table column, first seen first.

    slicers: slicer, table_id, column (0-based in the table). tables, filters: as the workbook
    facets have them. A column without a filter has every item selected.
    """
    held = slicers.join(tables.select("sheet", F.col("id").alias("table_id"), "r0", "c0", "r1", "header_rows", "totals_rows"), "table_id")
    held = held.join(filters.select("sheet", "table_id", "column", F.transform("vals", F.lower).alias("_vals")), ["sheet", "table_id", "column"], "left")
    held = held.withColumn("col", F.col("c0") + F.col("column"))
    body = cells.join(held, ["sheet", "col"]).where((F.col("row") >= F.col("r0") + F.col("header_rows")) & (F.col("row") <= F.col("r1") - F.col("totals_rows")) & (F.col("text") != ""))
    firsts = body.groupBy("sheet", "slicer", F.col("text").alias("label")).agg(F.min("row").alias("_first"), F.first("_vals").alias("_vals"))
    w = Window.partitionBy("sheet", "slicer").orderBy("_first", "label")
    out = firsts.withColumn("item", F.row_number().over(w)).where(F.col("item") <= limit)
    return out.select("sheet", "slicer", "item", "label", (F.col("_vals").isNull() | F.array_contains("_vals", F.lower("label"))).alias("selected"))
