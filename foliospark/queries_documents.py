"""Queries for tables and lists of documents, rule formats, table styles, sparklines and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import conditional as cf
from .operators import document, grid, layout
from .registry import register, table


def _runs(spark, sf_dir) -> DataFrame:
    from .queries import _runs as runs

    return runs(spark, sf_dir)


# --- documents ------------------------------------------------------------------------------


@register("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE CAST(users > 0 AS INTEGER) END AS nesting, CASE WHEN role = 'user' THEN CAST(users AS INTEGER) END AS number FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS users FROM conversations)""")
def d_list_items(spark, sf_dir):
    """Users' turns are numbered items, the others bullets below them."""
    turns = table(spark, sf_dir, "conversations").withColumns({"level": F.when(F.col("role") == "user", 0).otherwise(1), "marker": F.when(F.col("role") == "user", "a.").otherwise("•")})
    return document.list_items(turns, ["conv_id"], "turn").select("conv_id", "turn", "nesting", F.col("number").cast("int").alias("number"))


@register(r"""SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(n_name, '_', '\_') || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def d_markdown_tables(spark, sf_dir):
    """A table a region, with some empty cells."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumn("row", F.row_number().over(w))
    key = F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_nationkey").cast("string"))
    cells = rows.select("n_regionkey", "row", F.posexplode(F.array("n_name", key)).alias("col", "text"))
    head = rows.select("n_regionkey").distinct().select("n_regionkey", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("name"), F.lit("key"))).alias("col", "text"))
    return document.markdown_tables(head.union(cells), ["n_regionkey"])


@register("""SELECT n_regionkey, '<table>' || chr(10) || string_agg('<tr>' || CASE WHEN k = 1 THEN '<' || t || CASE WHEN n > 1 THEN ' rowspan="' || n || '"' ELSE '' END || '>' || n_regionkey || ' &amp; co</' || t || '>' ELSE '' END || '<' || t || '>' || n_name || '</' || t || '></tr>', chr(10) ORDER BY n_nationkey) || chr(10) || '</table>' AS html
  FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY n_regionkey) AS n, CASE WHEN row_number() OVER w = 1 THEN 'th' ELSE 'td' END AS t FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) GROUP BY n_regionkey""")
def d_html_tables(spark, sf_dir):
    """A table a region, whose first column is one merged cell."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumn("row", F.row_number().over(w) - 1)
    merged = F.struct(F.lit(0).alias("col"), F.concat("n_regionkey", F.lit(" & co")).alias("text"), F.when(F.col("row") == 0, "restart").otherwise("continue").alias("vmerge"))
    plain = F.struct(F.lit(1).alias("col"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("vmerge"))
    cells = rows.select("n_regionkey", "row", F.explode(F.array(merged, plain)).alias("c")).select("n_regionkey", "row", "c.*", F.lit(1).alias("span"))
    return document.html_tables(cells, ["n_regionkey"])


@register("""SELECT n_regionkey, CAST(max(n) AS BIGINT) AS columns FROM (SELECT n_regionkey, n_nationkey // 4 AS r, sum(n_nationkey % 3 + 1) AS n FROM nation GROUP BY ALL) GROUP BY n_regionkey""")
def d_grid_columns(spark, sf_dir):
    n = F.col("n_nationkey")
    return document.grid_columns(table(spark, sf_dir, "nation").select("n_regionkey", F.floor(n / 4).alias("row"), (n % 3 + 1).alias("span")), ["n_regionkey"]).select("n_regionkey", F.col("columns").cast("bigint").alias("columns"))


@register("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part WHERE p_partkey % 3 = 0""")
def d_bookmarks(spark, sf_dir):
    """Bookmarks that a link names: every third."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" / "), "p_type").alias("name"))
    links = p.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("name")).alias("anchor"))
    return document.used_bookmarks(p, links).select(F.col("doc_id").alias("p_partkey"), "slug")


@register("""SELECT CAST(n_nationkey AS INTEGER) AS sheet, name, CASE WHEN name = 'rate' AND n_nationkey % 2 = 0 THEN 'own ' || n_nationkey WHEN name = 'rate' THEN 'all' ELSE 'x' END AS value FROM nation, (VALUES ('rate'), ('other')) v(name)""")
def s_names(spark, sf_dir):
    """A sheet's own name beats the workbook's."""
    tabs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet"))
    own = tabs.where("sheet % 2 = 0").select(F.lit("Rate").alias("name"), "sheet", F.concat(F.lit("own "), "sheet").alias("value"))
    common = spark.createDataFrame([("rate", None, "all"), ("OTHER", None, "x")], "name string, sheet int, value string")
    return document.resolved_names(own.union(common), tabs, [])


# --- formats and styles ---------------------------------------------------------------------


@register("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'FF0000' WHEN NOT o_totalprice > 300000 AND o_orderstatus = 'F' THEN '00FF00' END AS fill, CASE WHEN o_totalprice > 300000 THEN NULL WHEN o_orderstatus = 'F' THEN 'italic' WHEN o_orderstatus = 'O' THEN 'bold' END AS font FROM orders""")
def cf_merged_format(spark, sf_dir):
    """Properties come from the first rule that sets them; the first rule stops the rest."""
    rules = [
        (1, cf.cell_is(F.col("o_totalprice"), "greaterThan", 300000), {"fill": "FF0000"}, True),
        (3, cf.cell_is(F.col("o_orderstatus"), "equal", "o"), {"font": "bold"}, False),
        (2, cf.cell_is(F.col("o_orderstatus"), "equal", "f"), {"fill": "00FF00", "font": "italic"}, False),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", cf.merged_format(rules, ["fill", "font"])).select("o_orderkey", "format.*")


@register("""SELECT n_nationkey, 'wholeTable' || CASE WHEN n_nationkey BETWEEN 1 AND 23 THEN CASE WHEN n_nationkey % 2 = 1 THEN ',band1Horz' ELSE ',band2Horz' END ELSE '' END || CASE WHEN n_regionkey = 0 THEN ',firstCol' ELSE '' END || CASE WHEN n_nationkey = 24 THEN ',lastRow' WHEN n_nationkey = 0 THEN ',firstRow' ELSE '' END || CASE WHEN n_regionkey = 0 AND n_nationkey = 0 THEN ',nwCell' WHEN n_regionkey = 0 AND n_nationkey = 24 THEN ',swCell' ELSE '' END AS parts,
  CASE WHEN n_nationkey IN (0, 24) THEN 'dark' WHEN n_regionkey = 0 THEN 'bold' WHEN n_nationkey % 2 = 1 THEN 'grey' ELSE 'white' END AS fill FROM nation""")
def g_table_style(spark, sf_dir):
    parts = grid.table_parts(F.col("n_nationkey"), F.col("n_regionkey"), F.lit(25), F.lit(5), totals=True, first=True)
    style = {"wholeTable": {"fill": "white"}, "band1Horz": {"fill": "grey"}, "firstCol": {"fill": "bold"}, "firstRow": {"fill": "dark"}, "lastRow": {"fill": "dark"}}
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(parts, ",").alias("parts"), grid.styled(parts, style, "fill").alias("fill"))


@register("""SELECT s_nationkey AS sheet, string_agg(CASE WHEN s_suppkey = k THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE '-' END, ',' ORDER BY k) AS points FROM (SELECT s_nationkey, k FROM (SELECT DISTINCT s_nationkey FROM supplier) h, range(0, 40) r(k)) g LEFT JOIN (SELECT s_nationkey AS n, s_suppkey, s_acctbal FROM supplier) s ON n = s_nationkey AND s_suppkey = k GROUP BY 1""")
def g_sparklines(spark, sf_dir):
    """Series of rows 0 to 39 with gaps where a sheet has no supplier."""
    s = table(spark, sf_dir, "supplier")
    cells = grid.to_cells(s.select("s_suppkey", "s_nationkey", F.floor("s_acctbal").cast("double").alias("v")), F.col("s_suppkey"), ["v"], F.col("s_nationkey"))
    hosts = cells.select("sheet").distinct().select("sheet", F.lit("h").alias("host"), F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(39).alias("r1"), F.lit(0).alias("c1"))
    text = F.array_join(F.transform("points", lambda p: F.coalesce(p.cast("bigint").cast("string"), F.lit("-"))), ",")
    return grid.spark_series(cells, hosts).select("sheet", text.alias("points"))


@register("""SELECT p_brand AS sheet, CAST(k AS INTEGER) AS item, label, label IN ('1', '7', '14') AS selected FROM (SELECT p_brand, label, row_number() OVER (PARTITION BY p_brand ORDER BY f, label) AS k FROM (SELECT p_brand, CAST(p_size AS VARCHAR) AS label, min(p_partkey) AS f FROM part GROUP BY ALL)) WHERE k <= 256""")
def g_slicers(spark, sf_dir):
    """The sizes of each brand's table, as its slicer shows them."""
    from .queries_sheets import _part_cells

    cells = _part_cells(spark, sf_dir)
    books = cells.groupBy("sheet").agg(F.max("row").alias("r1"))
    tables = books.select("sheet", F.lit(1).alias("id"), F.lit(0).alias("r0"), F.lit(0).alias("c0"), "r1", F.lit(0).alias("header_rows"), F.lit(0).alias("totals_rows"))
    filters = books.select("sheet", F.lit(1).alias("table_id"), F.lit(1).alias("column"), F.array(*map(F.lit, ("1", "7", "14"))).alias("vals"))
    slicers = spark.createDataFrame([("size", 1, 1)], "slicer string, table_id int, column int")
    return grid.table_slicer_items(slicers, tables, filters, cells).select("sheet", "item", "label", "selected")


# --- layout ---------------------------------------------------------------------------------

_LINES = "SELECT doc_id, n - 1 AS n, len(string_split(l, ' ')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@register(f"""SELECT doc_id, CAST(n // 40 AS INTEGER) AS page, 40e0 * k + 32 AS "left", 40e0 * k + 36 AS "right" FROM (SELECT doc_id, n, unnest(range(0, words - 1)) AS k FROM ({_LINES})) GROUP BY ALL HAVING count(*) >= 12""")
def l_voted_gutters(spark, sf_dir):
    """Words stand at steps of 40 points, 30 wide; a gap is a gutter where twelve lines of a page have it."""
    runs = layout.lines_by_gap(_runs(spark, sf_dir))
    return layout.voted_gutters(runs)


@register(f"""SELECT doc_id, CAST(n // 40 AS INTEGER) AS page, count(DISTINCT n) AS rows FROM ({_LINES}) GROUP BY ALL""")
def l_rows(spark, sf_dir):
    return layout.rows_at(_runs(spark, sf_dir)).groupBy("doc_id", "page").agg(F.countDistinct("row").alias("rows"))


@register(f"""SELECT doc_id, CAST(n // 40 AS INTEGER) AS page, CAST(sum(least(words, 2)) FILTER (WHERE n % 3 = 0) AS BIGINT) AS underlined, CAST(0 AS BIGINT) AS struck FROM ({_LINES}) GROUP BY ALL""")
def l_drawn_rules(spark, sf_dir):
    """Every third line has a rule just under its first two words."""
    runs = _runs(spark, sf_dir)
    rules = runs.where((F.floor(F.col("run_idx") / 10000) % 3 == 0) & (F.col("run_idx") % 10000 == 0)).select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(70.0).alias("x1"), (F.col("y") + 1).alias("y"))
    found = layout.drawn_rules(runs, rules)
    return found.groupBy("doc_id", "page").agg(F.nullif(F.count_if("underlined"), F.lit(0)).alias("underlined"), F.count_if("struck").alias("struck"))


@register("""SELECT conv_id AS doc_id, CASE WHEN r > 1 THEN 'positional' ELSE 'flow' END AS reading FROM (SELECT conv_id, marks / greatest(n, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY marks / greatest(n, 1)) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS c FROM (SELECT conv_id, length(text) % 7 AS marks, turn % 3 AS n FROM conversations)) WHERE k = c // 2""")
def l_reading_kind(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (F.length("text") % 7).alias("marks"), (F.col("turn") % 3).alias("lines"))
    return layout.reading_kind(pages)


@register("""SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey > 1, n_nationkey) AS place FROM nation""")
def l_reading_order(spark, sf_dir):
    """Two columns, parted after the second region."""
    blocks = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), (F.col("n_regionkey") * 100.0).alias("x"), F.col("n_nationkey").cast("double").alias("y"), "n_nationkey")
    cuts = spark.createDataFrame([(1, 0, 140.0, 160.0)], "doc_id int, page int, left double, right double")
    return layout.in_reading_order(blocks, cuts).select("n_nationkey", F.col("place").cast("bigint").alias("place"))


@register("""SELECT conv_id AS doc_id, 5e0 AS y, 1e0 AS share, TRUE AS numbered FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def l_running_heads(spark, sf_dir):
    """Each turn is a page with a numbered head at one height."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.explode(F.array(F.struct(F.lit(5.0).alias("y"), F.concat(F.lit("Page "), "turn").alias("text")), F.struct(F.lit(50.0).alias("y"), F.col("text")))).alias("l")).select("doc_id", "page", F.lit(0.0).alias("x"), "l.*")
    return layout.running_heads(lines)


@register("""SELECT n_nationkey, 1 + CAST(count(*) FILTER (WHERE n_nationkey % 4 = 3) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) - 1 AS paragraph FROM nation""")
def l_paragraphs(spark, sf_dir):
    """Every fourth line stops short, so the next begins a paragraph."""
    n = F.col("n_nationkey")
    lines = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), n.alias("line"), F.lit(0.0).alias("x"), (n * 12.0).alias("y"), F.when(n % 4 == 3, 40.0).otherwise(200.0).alias("end_x"), F.lit(10.0).alias("font_size"), F.col("n_name").alias("text"))
    return layout.paragraphs(lines).select(F.col("line").alias("n_nationkey"), F.col("paragraph").cast("bigint").alias("paragraph"))


@register("""SELECT s_suppkey AS doc_id, 50e0 AS "left", 100e0 + s_nationkey AS "right" FROM supplier""")
def l_gutters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    box = lambda k, x, end: F.struct(F.lit(k).alias("run_idx"), x.cast("double").alias("x"), end.cast("double").alias("end_x"))
    runs = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("page"), F.explode(F.array(box(0, F.lit(0), F.lit(50)), box(1, F.col("s_nationkey") + 100, F.lit(300)), box(2, F.lit(10), F.lit(40)))).alias("r"), F.lit(10.0).alias("font_size")).select("doc_id", "page", "r.*", "font_size")
    return layout.gutters(runs).select("doc_id", "left", "right")


@register("""SELECT n_regionkey AS paragraph, CASE n_regionkey % 4 WHEN 0 THEN 'justify' WHEN 1 THEN 'left' WHEN 2 THEN 'center' ELSE 'right' END AS alignment FROM nation GROUP BY 1""")
def l_aligned(spark, sf_dir):
    kind, n = F.col("n_regionkey") % 4, F.col("n_nationkey") * 5.0
    x = F.when(kind.isin(0, 1), 0.0).otherwise(n)
    end = F.when(kind.isin(0, 3), 400.0).when(kind == 1, 400.0 - n).otherwise(400.0 - n)
    lines = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("n_regionkey").alias("paragraph"), x.alias("x"), end.alias("end_x"))
    return layout.aligned(lines).select("paragraph", "alignment")
