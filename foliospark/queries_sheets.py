"""Queries for workbooks written and read back, sheet operators, references and document layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import document, grid, layout, sheets
from .plans.compile import with_references
from .registry import register, table
from .sources import office


def _workbooks(spark, sf_dir) -> DataFrame:
    """(path, content): a workbook a nation of its suppliers, written from cells with number formats."""
    s = table(spark, sf_dir, "supplier")
    one = lambda col, kind, num, text, flag, code: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), num.cast("double").alias("num"), text.alias("str"), flag.alias("bool"), F.lit(code).cast("string").alias("num_fmt"))
    none, no_text, no_flag = F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    cells = F.array(
        one(0, "str", none, F.col("s_name"), no_flag, None), one(1, "num", F.col("s_acctbal"), no_text, no_flag, "#,##0.00;(#,##0.00)"), one(2, "num", F.col("s_suppkey") + 34700, no_text, no_flag, "yyyy-mm-dd"), one(3, "bool", none, no_text, F.col("s_acctbal") > 0, None), one(4, "num", F.col("s_suppkey"), no_text, no_flag, None),
    )
    rows = s.select(F.col("s_nationkey").cast("string").alias("path"), F.lit(0).alias("sheet"), F.lit("suppliers").alias("sheet_name"), F.col("s_suppkey").cast("int").alias("row"), F.explode(cells).alias("c"))
    return office.to_files(rows.select("path", "sheet", "sheet_name", "row", "c.*"), "path", "xlsx")


_MONEY = "CASE WHEN s_acctbal < 0 THEN '(' || format('{:,.2f}', -s_acctbal) || ')' ELSE format('{:,.2f}', s_acctbal) END"


@register(f"""SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(s_suppkey AS INTEGER) AS row, k AS col, CASE k WHEN 0 THEN s_name WHEN 1 THEN {_MONEY} WHEN 2 THEN strftime(DATE '1995-01-01' + CAST(s_suppkey AS INTEGER), '%Y-%m-%d') WHEN 3 THEN CASE WHEN s_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END ELSE CAST(s_suppkey AS VARCHAR) END AS text FROM supplier, (VALUES (0), (1), (2), (3), (4)) v(k)""")
def x_cell_text(spark, sf_dir):
    """Workbooks are written, read back once, and each cell is shown in its style's number format."""
    parsed = office.parse(_workbooks(spark, sf_dir), "xlsx")
    cells, styles, book = (office.facet(parsed, "xlsx", name) for name in ("cells", "styles", "sheets"))
    return sheets.cell_text(cells, styles, book).select("path", "row", "col", "text")


@register("""SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(s_suppkey AS INTEGER) AS row, 1 AS col, s_acctbal AS num, '#,##0.00;(#,##0.00)' AS num_fmt, FALSE AS bold, 'Calibri' AS font, 11e0 AS size FROM supplier""")
def x_styles(spark, sf_dir):
    parsed = office.parse(_workbooks(spark, sf_dir), "xlsx")
    cells, styles = office.facet(parsed, "xlsx", "cells").where("col = 1"), office.facet(parsed, "xlsx", "styles")
    return cells.join(styles.withColumnRenamed("idx", "style"), ["path", "style"]).select("path", "row", "col", "num", "num_fmt", "bold", "font", "size")


@register("""SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, CASE WHEN role = 'user' THEN 'Heading1' END AS style, regexp_replace(text, '[\x00-\x08]', '', 'g') AS text FROM conversations""")
def x_paragraphs(spark, sf_dir):
    """A document a conversation is written and read back."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "Heading1").alias("style"), "text")
    parsed = office.parse(office.to_files(turns, "path", "docx"), "docx")
    return office.facet(parsed, "docx", "rows").select("path", "seq", "style", "text")


@register("""SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, 1 AS level, text FROM conversations QUALIFY role = 'user'""")
def x_outline(spark, sf_dir):
    """The outline of written and reread documents whose users' turns are headings."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "Heading1").alias("style"), "text")
    return office.outline(office.facet(office.parse(office.to_files(turns, "path", "docx"), "docx"), "docx", "rows"))


_PLAIN = "regexp_replace(text, '[^ -~]', '?', 'g')"


@register(f"""SELECT conv_id AS doc_id, CAST(k // 52 AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, left({_PLAIN}, 40) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) WHERE trim(line) <> '' GROUP BY ALL""")
def x_pdf_lines(spark, sf_dir):
    """A PDF a conversation is written, 52 lines a page, and its lines are made out again from the runs."""
    shown = F.substring(F.regexp_replace("text", "[^ -~]", "?"), 1, 40)  # the width of a line, so that none is wrapped
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), shown.alias("text"))
    runs = office.facet(office.parse(office.to_files(turns, "path", "pdf"), "pdf"), "pdf", "rows")
    lines = layout.line_texts(layout.cluster_lines(runs.withColumn("doc_id", F.col("path").cast("bigint")).drop("path").where("trim(text) <> ''")))
    whole = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.select("doc_id", "page", "text")


# --- sheet operators ------------------------------------------------------------------------


def _part_cells(spark, sf_dir) -> DataFrame:
    """A sheet a brand, a row a part: its number, name, size and price."""
    p = table(spark, sf_dir, "part")
    cells = grid.to_cells(p.select("p_partkey", "p_name", "p_size", "p_retailprice", "p_brand"), F.col("p_partkey"), ["p_name", "p_size", "p_retailprice"], F.col("p_brand"))
    return cells.withColumns({"err": F.lit(None).cast("string"), "text": F.when(F.col("kind") == "str", F.col("str")).otherwise(F.regexp_replace(F.col("num").cast("string"), r"\.0$", ""))})


_KEYS = "p_brand AS sheet, CAST(p_partkey AS INTEGER) AS row"


@register(f"""SELECT {_KEYS}, k AS col FROM part, (VALUES (0), (2)) v(k) WHERE p_partkey % 3 <> 0""")
def s_visible(spark, sf_dir):
    """Every third row and the second column are hidden."""
    cells = _part_cells(spark, sf_dir)
    rows = cells.where("row % 3 = 0").select("sheet", "row").distinct().withColumn("hidden", F.lit(True))
    columns = cells.select("sheet").distinct().select("sheet", F.lit(1).alias("c0"), F.lit(1).alias("c1"), F.lit(True).alias("hidden"))
    return sheets.visible(cells, rows, columns, ["sheet"]).select("sheet", "row", "col")


@register(f"""SELECT {_KEYS}, k AS col, p_partkey < 5 AS is_title FROM part, (VALUES (0), (1), (2)) v(k) WHERE p_brand <> 'Brand#11' OR (p_partkey BETWEEN 2 AND 119 AND k < 2)""")
def s_print_area(spark, sf_dir):
    """One brand's sheet has a print area; all repeat their first rows."""
    cells = _part_cells(spark, sf_dir)
    books = cells.select("sheet").distinct()
    areas = books.where("sheet = 'Brand#11'").select(F.lit(sheets.PRINT_AREA).alias("name"), "sheet", F.lit("'Brand#11'!$A$3:$B$40,'Brand#11'!$A$60:$A$120").alias("value"))
    titles = books.select(F.lit(sheets.PRINT_TITLES).alias("name"), "sheet", F.lit("x!$1:$5").alias("value"))
    names = areas.union(titles)
    shown = sheets.clipped(cells, sheets.print_areas(names, []), ["sheet"])
    return sheets.title_rows(shown, names, []).select("sheet", "row", "col", "is_title")


@register("""WITH w AS (SELECT p_brand, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY 1) SELECT g.p_brand AS sheet, count(*) AS n_rows, 3 * count(*) FILTER (WHERE p.p_partkey IS NULL) AS n_blank FROM (SELECT p_brand, unnest(range(a, b + 1)) AS r FROM w) g LEFT JOIN part p ON p.p_brand = g.p_brand AND p.p_partkey = r GROUP BY 1""")
def s_dense(spark, sf_dir):
    """Each sheet's used window with its gaps filled in."""
    windows = sheets.dense(_part_cells(spark, sf_dir), "text", ["sheet"])
    return windows.groupBy("sheet").agg(F.count("*").alias("n_rows"), F.sum(F.size(F.filter("values", F.isnull))).cast("bigint").alias("n_blank"))


@register(f"""SELECT {_KEYS}, p_partkey <= f OR p_size IN (1, 7, 14, 21) AS passes FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part)""")
def s_filtered(spark, sf_dir):
    """A value filter on the sizes of each sheet's used range."""
    cells = _part_cells(spark, sf_dir)
    areas = cells.groupBy("sheet").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    filters = areas.select("sheet", F.lit(1).alias("column"), F.array(*map(F.lit, ("1", "7", "14", "21"))).alias("vals"), F.lit(False).alias("blank"))
    return sheets.filtered(cells, filters, areas, by=["sheet"]).where("col = 0").select("sheet", "row", "passes")


@register(f"""SELECT {_KEYS}, k AS col, CASE k WHEN 0 THEN length(p_name) <= 14 WHEN 1 THEN p_size BETWEEN 5 AND 30 ELSE p_retailprice > 950 END AS valid FROM part, (VALUES (0), (1), (2)) v(k)""")
def s_validated(spark, sf_dir):
    """A rule a column, over all rows that its sheet has."""
    rule = "kind string, operator string, formula1 string, formula2 string, allow_blank boolean, c0 int, seq int"
    rules = spark.createDataFrame([("textLength", "lessThanOrEqual", "14", None, False, 0, 0), ("whole", "between", "30", "5", False, 1, 1), ("decimal", "greaterThan", "950", None, False, 2, 2)], rule)
    cells = _part_cells(spark, sf_dir)
    windows = cells.groupBy("sheet").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    return sheets.validated(cells, windows.join(F.broadcast(rules)).withColumn("c1", F.col("c0")), by=[]).select("sheet", "row", "col", "valid")


@register(f"""SELECT {_KEYS}, p_size * 2e0 AS twice, CASE WHEN p_partkey > 0 THEN coalesce(p_size > lag_size, p_size > 0) END AS over, p_retailprice - first_price AS gap, lag_size IS NULL AND p_partkey > 0 AS alone FROM (SELECT p.*, q.p_size AS lag_size, f.p_retailprice AS first_price FROM part p LEFT JOIN part q ON q.p_brand = p.p_brand AND q.p_partkey = p.p_partkey - 1 JOIN (SELECT p_retailprice FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#11')) f ON TRUE)""")
def s_references(spark, sf_dir):
    """Formulas written for one row of a sheet and moved to every other; one reads another sheet."""
    cells = _part_cells(spark, sf_dir)
    keys = [r[0] for r in cells.select("sheet").distinct().orderBy("sheet").collect()]  # 25 brands
    number = F.array_position(F.array(*map(F.lit, keys)), F.col("sheet")).cast("int") - 1
    first = cells.where("sheet = 'Brand#11'").agg(F.min("row")).first()[0]
    indexed = cells.withColumns({"brand": F.col("sheet"), "sheet": number})
    targets = indexed.where("col = 0").select("sheet", "row", "col", "brand")
    formulas = {"twice": "B2*2", "over": "B2>B1", "gap": f"C2-'Brand#11'!C${first + 1}", "alone": "ISBLANK(B1)"}
    out = with_references(targets, indexed, formulas, "A2", {k: i for i, k in enumerate(keys)})
    return out.select(F.col("brand").alias("sheet"), "row", "twice", "over", F.round("gap", 6).alias("gap"), "alone")


@register("""SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'sheet' ELSE 'other' END AS sheet, CAST(s_suppkey AS INTEGER) AS row, 0 AS col FROM supplier UNION ALL SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'sheet' ELSE 'other' END, s_suppkey, 1 FROM supplier WHERE s_suppkey NOT BETWEEN 10 AND 20""")
def s_without_merged(spark, sf_dir):
    """Rows 10 to 20 have their first two cells merged."""
    s = table(spark, sf_dir, "supplier").withColumn("sheet", F.when(F.col("s_nationkey") % 2 == 0, "sheet").otherwise("other"))
    cells = grid.to_cells(s, F.col("s_suppkey"), ["s_name", "s_acctbal"], F.col("sheet"))
    merges = cells.where("row between 10 and 20").select("sheet", F.col("row").alias("r0"), F.lit(0).alias("c0"), F.col("row").alias("r1"), F.lit(1).alias("c1")).distinct()
    return grid.without_merged(cells, merges).select("sheet", "row", "col")


@register("""SELECT n_nationkey, 'Page ' || n_nationkey || ' of 25' AS "left", n_name AS center, '&x' AS "right" FROM nation""")
def d_header_footer(spark, sf_dir):
    parts = document.header_footer('&L&"Arial"&12Page &P of &N&C&A&R&&x', F.col("n_nationkey"), F.lit(25), F.col("n_name"), F.lit("f"))
    return table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(name) for name, c in parts.items()])


@register("""SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '<h1>' ELSE '<p>' END || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || CASE WHEN turn = 0 THEN '</h1>' ELSE '</p>' END, chr(10) ORDER BY turn) AS html FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def d_html(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").withColumns({"kind": F.when(F.col("turn") == 0, "heading").otherwise("paragraph"), "level": F.lit(1)})
    return document.html(blocks, ["conv_id"], "turn")


@register("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 WHEN p_partkey % 4 = 0 THEN TRUE WHEN p_partkey % 4 = 1 THEN TRUE ELSE NULL END AS bold, CASE WHEN p_size % 5 = 0 THEN 9e0 WHEN p_partkey % 4 = 1 THEN 14e0 WHEN p_partkey % 4 IN (0, 2) THEN 11e0 END AS size FROM part""")
def d_cascade(spark, sf_dir):
    """Direct formatting over a style, over what it is based on."""
    styles = spark.createDataFrame([("0", "2", True, None), ("1", "0", None, 14.0), ("2", None, None, 11.0)], "style_id string, based_on string, bold boolean, size double")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 < 3, (F.col("p_partkey") % 4).cast("string")).alias("style_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0).alias("bold"), F.when(F.col("p_size") % 5 == 0, 9.0).alias("size"))
    return document.cascade(p, styles, ["bold", "size"]).select("p_partkey", "bold", "size")


@register("""SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY f) AS INTEGER) AS number, role FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL)""")
def d_note_numbers(spark, sf_dir):
    """Notes are numbered as they are first referred to: here, roles by their first turn."""
    turns = table(spark, sf_dir, "conversations")
    refs = turns.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("note_ref"), F.col("turn").alias("seq"))
    found = document.note_numbers(refs, refs.select("doc_id", "note_ref").distinct())
    return found.select(F.col("doc_id").alias("conv_id"), F.col("number").cast("int").alias("number"), F.col("note_ref").alias("role"))
