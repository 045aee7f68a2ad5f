import pytest
from pyspark.sql import functions as F

from foliospark.functions import numfmt
from foliospark.functions import text as tx
from foliospark.operators import conditional as cf
from foliospark.operators import document, grid, layout, lookup, statistics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("x", "code", "want"),
    [
        (1234.567, "#,##0.00", "1,234.57"), (-5.0, "#,##0;(#,##0)", "(5)"), (0.256, "0%", "26%"), (12345.0, "0.00E+00", "1.23E+04"), (1.25, "# ?/?", "1 1/4"), (45352.75, "yyyy-mm-dd hh:mm", "2024-03-01 18:00"),
        (0.5, "h:mm AM/PM", "12:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (1234567.0, '0.0,,"M"', "1.2M"), (5.0, "000", "005"), (0.1, "#.##", ".1"), (-3.5, "0.0", "-3.5"), (1.005, "0.00", "1.01"),
        (45352.0, "d-mmm-yy", "1-Mar-24"), (150.0, '[>100]"big";"small"', "big"), (0.0, '0;-0;"zero"', "zero"), (45352.5123456, "mm:ss.0", "17:46.7"), (45352.0, "dddd", "Friday"), ("abc", '0;0;0;"<"@">"', "<abc>"), (None, "0", None),
    ],
)
def test_number_formats(x, code, want):
    assert numfmt.format_value(x, code) == want


def test_number_format_column(spark):
    df = spark.createDataFrame([(1.5,), (None,), (-2.25,)], "x double").coalesce(1)
    assert [r.v for r in df.select(numfmt.number_format(F.col("x"), "0.0;(0.0)").alias("v")).collect()] == ["1.5", None, "(2.3)"]
    assert numfmt.colour("#,##0;[Red](#,##0)", -1) == "FF0000" and numfmt.colour("0", 1) is None


def test_colours_and_bars(spark):
    df = spark.createDataFrame([(-10.0,), (0.0,), (5.0,), (30.0,), (None,)], "v double")
    shades = {r.v: r.color for r in cf.color_scale(df, "v", [cf.Stop("num", 0), cf.Stop("percent", 50), cf.Stop("max")], ["FF0000", "FFFF00", "00FF00"]).collect()}
    assert shades[-10.0] == "FF0000" and shades[30.0] == "00FF00" and shades[None] is None and shades[5.0] == "FF8000"
    bars = {r.v: (r.bar_fraction, r.bar_start, r.bar_color) for r in cf.data_bar(df, "v", cf.Stop("min"), cf.Stop("max"), "0000FF").collect()}
    assert bars[30.0] == (0.75, 0.25, "0000FF")
    assert bars[-10.0] == (0.25, 0.0, "FF0000") and bars[None] == (None, None, None)
    icons = {r.v: r.icon for r in cf.icon_set(df, "v", [cf.Stop("percent", 0), cf.Stop("percent", 33), cf.Stop("percent", 67)], reverse=True).collect()}
    assert icons == {-10.0: 2, 0.0: 2, 5.0: 1, 30.0: 0, None: None}


def test_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 9.0), ("b", None)], "k string, v double")
    top = cf.top_n(df, "v", 2, ["k"]).where("in_top").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in top} == {"a": 3, "b": 1}
    assert cf.top_n(df, "v", 1, ["k"], percent=True).where("in_top and k = 'a'").count() == 1
    assert cf.above_average(df, "v", ["k"], equal=True).where("matches and k = 'a'").count() == 3
    assert cf.duplicates(df, cf.typed_key(F.col("v"), True), ["k"]).where("matches").count() == 2
    assert cf.duplicates(df, cf.typed_key(F.col("v"), True), ["k"], unique=True).where("matches").count() == 3
    assert cf.expression_rule(df, "=v>AVERAGE(v)", ["k"]).where("matches").count() == 1
    empty = df.limit(0)
    for out in (cf.top_n(empty, "v", 2, ["k"]), cf.above_average(empty, "v"), cf.duplicates(empty, F.col("k")), cf.data_bar(empty, "v", cf.Stop("min"), cf.Stop("max"), "0000FF")):
        assert out.collect() == []


@pytest.mark.parametrize(("period", "days"), [("today", {0}), ("yesterday", {-1}), ("tomorrow", {1}), ("last7Days", set(range(-6, 1))), ("thisWeek", set(range(-4, 3))), ("lastWeek", set(range(-11, -4))), ("nextWeek", set(range(3, 10))), ("thisMonth", set(range(-14, 16)) & set(range(-12, 13)))])
def test_time_periods(spark, period, days):
    now = 34865.7  # Thursday, 1995-06-15
    df = spark.range(-12, 13).withColumn("s", F.col("id") + 34865.25)
    assert {r.id for r in df.where(cf.time_period(F.col("s"), period, now)).collect()} == days & set(range(-12, 13))


def test_grid(spark):
    df = spark.createDataFrame([(0, "x", 1.5, None), (1, None, 2.5, True)], "r int, t string, n double, b boolean")
    cells = grid.to_cells(df, F.col("r"), ["t", "n", "b"])
    assert {(c.row, c.col, c.kind) for c in cells.collect()} == {(0, 0, "str"), (0, 1, "num"), (1, 1, "num"), (1, 2, "bool")}
    assert tuple(grid.used_range(cells).first()) == (0, 1, 2, 4)
    assert [one(spark, grid.column_letters(F.lit(n))) for n in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert one(spark, grid.address_column(F.lit("$XFD$7"))) == 16383 and one(spark, grid.address_row(F.lit("$XFD$7"))) == 6
    assert grid.parse_area("S!$A$1:B2,D5") == (0, 0, 4, 3) and grid.parse_area("x") is None
    ranges = spark.createDataFrame([(0, 0, 0, 5000, 1, "p", 2), (0, 0, 0, 0, 0, "q", 1)], "sheet int, r0 int, c0 int, r1 int, c1 int, label string, ord int")
    hits = {(r.row, r.col): r.label for r in grid.range_join(cells, ranges, ["label"], "ord").collect()}
    assert hits == {(0, 0): "q", (0, 1): "p", (1, 1): "p", (1, 2): None}
    merges = spark.createDataFrame([(0, 0, 1, 1, 2)], "sheet int, r0 int, c0 int, r1 int, c1 int")
    assert {(r.row, r.col) for r in grid.without_merged(cells, merges).collect()} == {(0, 0), (0, 1)}
    assert grid.column_bands([10, 10, 10, 10], 25, {3}) == [(0, 1), (2, 2), (3, 3)]
    big = spark.createDataFrame([(0, 60000, 20000, "num", 1.0, None)], "sheet int, row int, col int, kind string, num double, str string")
    assert grid.over_limit(big).count() == 3
    axis = one(spark, grid.nice_scale(F.lit(0.0), F.lit(12.0)))
    assert (axis["min"], axis["max"], axis["step"]) == (0.0, 14.0, 2.0)


def test_lookups(spark):
    table = spark.createDataFrame([(1.0, "one"), (5.0, "five"), (9.0, "nine")], "k double, v string")
    left = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 8.9), (3, 99.0), (4, None)], "i int, x double")
    for buckets in (2, 200):
        got = {r.i: r.v for r in lookup.vlookup_approximate(left, "x", table, "k", ["v"], buckets).collect()}
        assert got == {0: None, 1: "one", 2: "five", 3: "nine", 4: None}
    words = spark.createDataFrame([("A", 1, 2), ("a", 2, 1), ("b", 3, 3)], "w string, n int, pos int")
    found = lookup.vlookup_exact(spark.createDataFrame([("a",), ("z",), (None,)], "q string"), "q", words, "w", ["n"], "pos").collect()
    assert {r.q: r.n for r in found} == {"a": 2, "z": None, None: None}
    assert lookup.match_wildcard(words, "w", "?", "pos").first().position == 1
    assert lookup.vlookup_approximate(left, "x", table.limit(0), "k", ["v"]).where("v is null").count() == 5


def test_statistics(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", 1.0, 4), ("b", 2.0, 5), ("b", None, 6)], "k string, v double, o int")
    assert {r.k: r["mode"] for r in statistics.mode_first(df, "v", "o", ["k"]).collect()} == {"a": 3.0, "b": None}
    assert {r.k: r.kth for r in statistics.kth(df, "v", 3, ["k"]).collect()} == {"a": 1.0}
    assert statistics.kth(df, "v", 3).first().kth == 2.0 and statistics.kth(df, "v", 1, largest=False).first().kth == 1.0
    assert statistics.kth(df, "v", 9).collect() == []


@pytest.mark.parametrize(("style", "n", "want"), [("decimal", 7, "7"), ("decimalZero", 7, "07"), ("upperLetter", 28, "AB"), ("lowerRoman", 1994, "mcmxciv"), ("ordinal", 113, "113th"), ("ordinal", 22, "22nd"), ("chicago", 6, "††"), ("decimalEnclosedCircle", 20, "⑳"), ("upperRoman", 0, ""), ("ideographZodiac", 12, "亥"), ("none", 3, "")])
def test_counters(spark, style, n, want):
    assert one(spark, document.counter(style, F.lit(n))) == want


def test_numbering_and_assembly(spark):
    items = spark.createDataFrame([(1, k, "l", lvl) for k, lvl in enumerate([0, 1, 1, 0, 1, 2, 1])], "doc_id long, seq int, num_id string, ilvl int")
    got = [list(r.counters) for r in document.number_lists(items).orderBy("seq").collect()]
    assert got == [[1], [1, 1], [1, 2], [2], [2, 1], [2, 1, 1], [2, 2]]
    marker = document.level_marker("%1.%2)", ["upperRoman", "lowerLetter"], F.array(F.lit(4), F.lit(3)))
    assert one(spark, marker) == "IV.c)"
    blocks = spark.createDataFrame([(1, 2, "p", "a*b", 0), (1, 1, "heading", "T", 2), (1, 3, "item", "x", 1), (1, 4, "p", "1. no", 0), (1, 5, "p", None, 0)], "d long, seq int, kind string, text string, level int")
    assert document.markdown(blocks, ["d"], "seq").first().markdown == "## T\n\na\\*b\n\n  - x\n\n1\\. no"
    assert document.html(blocks.where("seq < 3"), ["d"], "seq").first().html == "<h2>T</h2>\n<p>a*b</p>"
    losses = spark.createDataFrame([(1, "dropped", "f", "x")] * 3, "doc_id long, severity string, feature string, detail string")
    assert document.distinct_losses(losses).first().times == 3
    with pytest.raises(Exception, match="loss: dropped f x"):
        document.strict(losses).collect()
    assert document.strict(losses.limit(0)).collect() == []
    styles = spark.createDataFrame([("h1", "base", True, None), ("base", "h1", False, 12.0)], "style_id string, based_on string, bold boolean, size double")
    rows = spark.createDataFrame([(1, "h1", None, None), (2, None, None, 9.0)], "i int, style_id string, bold boolean, size double")
    assert [tuple(r) for r in document.cascade(rows, styles, ["bold", "size"]).orderBy("i").collect()] == [(1, "h1", True, 12.0), (2, None, None, 9.0)]
    parts = document.header_footer('&L&"Arial"&12Page &P of &N&C&A&R&&x', F.lit(2), F.lit(9), F.lit("S"), F.lit("f"))
    assert {k: one(spark, v) for k, v in parts.items()} == {"left": "Page 2 of 9", "center": "S", "right": "&x"}
    refs = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "gone", 4)], "doc_id long, note_ref string, seq int")
    notes = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, note_ref string")
    assert {r.note_ref: r.number for r in document.note_numbers(refs, notes).collect()} == {"b": 1, "a": 2}


def test_text(spark):
    assert one(spark, tx.scripts(F.lit("abc 漢字 かな שלום"))) == ["hebrew", "jp"]
    assert one(spark, tx.has_rtl(F.lit("abc"))) is False and one(spark, tx.has_rtl(F.lit("سلام"))) is True
    assert one(spark, tx.cjk_pieces(F.lit("ab漢字cd"))) == ["ab", "漢", "字", "cd"]
    assert one(spark, tx.cjk_break_between(F.lit("漢"), F.lit("。"))) is False and one(spark, tx.cjk_break_between(F.lit("漢"), F.lit("a"))) is True
    assert [one(spark, tx.safe_link(F.lit(u))) for u in (" HTTP://x ", "javascript:1", "a/b")] == ["HTTP://x", None, None]
    assert one(spark, tx.heading_level(F.lit(None).cast("int"), F.lit("Heading 9"))) == 6
    assert one(spark, tx.is_blank(F.lit(" ​ "))) is True
    assert one(spark, tx.decode_xstring(F.lit("a_x000A_b_x005F_x0041_"))) == "a\nb_x0041_"
    assert one(spark, tx.join_hyphenated(F.array(F.lit("a­"), F.lit("b"), F.lit("c-"), F.lit("d"), F.lit("e")))) == "ab c-d e"
    h = tx.Hyphenator(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"], ["ta-ble"])
    assert h.hyphenate("hyphenation", "-") == "hy-phen-ation" and h.hyphenate("table", "-") == "ta-ble"
    df = spark.createDataFrame([("hyphenation",), (None,)], "w string")
    assert [r.v for r in df.coalesce(1).select(h.udf("-")("w").alias("v")).collect()] == ["hy-phen-ation", None]


def test_layout(spark):
    def run(i, x, y, text, size=10.0, page=0):
        return (1, page, i, float(x), float(y), float(x + 5 * len(text)), size, text)

    runs = spark.createDataFrame([run(0, 0, 0, "Hello"), run(1, 28, 1, "world"), run(2, 100, 0, "tab"), run(3, 0, 12, "next"), run(4, 0, 60, "far", 20.0)], "doc_id long, page int, run_idx int, x double, y double, end_x double, font_size double, text string").repartition(3)
    lines = layout.line_texts(layout.cluster_lines(runs)).orderBy("line").collect()
    assert [r.text for r in lines] == ["Hello world\ttab", "next", "far"]
    gap = layout.lines_by_gap(runs).select("run_idx", "line").orderBy("run_idx").collect()
    assert [r.line for r in gap] == [0, 0, 0, 1, 2]
    paras = layout.paragraphs(layout.line_texts(layout.cluster_lines(runs))).orderBy("line").collect()
    assert [r.paragraph for r in paras] == [1, 1, 2]
    assert layout.median_font(runs).first().median_font == 10.0
    pages = spark.createDataFrame([run(0, 0, 5, f"Page {p}", page=p) for p in range(4)] + [run(1, 0, 50, "body", page=p) for p in range(4)], runs.schema)
    head = layout.running_heads(layout.line_texts(layout.cluster_lines(pages))).first()
    assert (head.y, head.share, head.numbered) == (5.0, 1.0, True)
    assert layout.gutters(runs).collect()[0].left == 53.0
    links = spark.createDataFrame([(1, 0, 0.0, -1.0, 30.0, 5.0, "http://x")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, href string")
    assert {r.run_idx: r.href for r in layout.links_over_runs(runs, links).collect()}[0] == "http://x"
    assert layout.greedy_breaks([3, 3, 3], 7, 1) == [0, 2] and layout.best_breaks([3, 2, 2, 5], 6, 1) == [0, 1, 3]


def test_tables_of_tab_stops(spark):
    rows = [(1, 0, 0, 10.0, [50.0, 100.0]), (1, 0, 1, 10.0, [55.0, 95.0]), (1, 0, 2, 10.0, [59.0, 109.0]), (1, 0, 3, 10.0, [62.0, 100.0]), (1, 0, 4, 10.0, []), (1, 0, 5, 10.0, [40.0]), (1, 0, 6, 10.0, [40.0])]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, font_size double, stops array<double>")
    assert [r.table for r in layout.tabbed_rows(lines).orderBy("line").collect()] == [0, 0, 0, None, None, None, None]


def test_pages_are_filled_greedily(spark):
    rows = [(0, k, h, cut) for k, (h, cut) in enumerate([(40.0, False), (40.0, False), (30.0, False), (10.0, True), (500.0, False), (5.0, False)])]
    sheet = spark.createDataFrame(rows, "sheet int, row int, height double, break_before boolean")
    pages = lambda **k: [r.page for r in layout.page_numbers(sheet, 100.0, **k).orderBy("row").collect()]
    assert pages() == [0, 0, 1, 2, 3, 4] and pages(scale=0.5) == [0, 0, 0, 1, 2, 3] and pages(repeat=70.0) == [0, 0, 1, 2, 3, 4]
    assert layout.page_numbers(sheet.limit(0), 100.0).collect() == []


def test_notes_lists_and_spans(spark):
    notes = spark.createDataFrame([(1, "a", " x\n y* "), (1, "b", "z")], "doc_id long, note_ref string, text string")
    numbers = spark.createDataFrame([(1, "a", 2)], "doc_id long, note_ref string, number int")
    assert [r.line for r in document.note_definitions(notes, numbers).collect()] == ["[^fn2]: x y\\*"]
    blocks = spark.createDataFrame([(1, 1, 0, "1.", "one"), (1, 2, 2, "-", "deep"), (1, 3, 1, "a)", "mid"), (1, 4, 2, "-", "under mid"), (1, 5, None, None, "break"), (1, 6, 0, "7.", "seven")], "d int, seq int, level int, marker string, text string")
    items = document.list_items(blocks, ["d"], "seq")
    assert [(r.nesting, r.number) for r in items.orderBy("seq").collect()] == [(0, 1), (1, None), (1, 1), (2, None), (0, 7)]
    assert document.markdown_items(items, ["d"], "seq").first().markdown == "1. one\n  - deep\n  1. mid\n    - under mid\n7. seven"
    cells = spark.createDataFrame([(0, 0, "restart"), (1, 0, "continue"), (2, 0, "continue"), (3, 0, None), (4, 0, "restart"), (6, 0, "continue"), (0, 1, None)], "row int, col int, vmerge string").withColumn("t", F.lit(1))
    assert {(r.row, r.col): r.row_span for r in document.row_spans(cells, ["t"]).collect()} == {(0, 0): 3, (1, 0): 1, (2, 0): 1, (3, 0): 1, (4, 0): 1, (6, 0): 1, (0, 1): 1}
    assert one(spark, document.slug(F.lit("  Ünï & Co. 2! "))) == "ünï-co-2" and one(spark, document.slug(F.lit("!!"))) == "bookmark"
    spark_row = spark.range(1).select(grid.spark_extent(F.array(F.lit(2.0), F.lit(None), F.lit(2.0))).alias("a"), grid.spark_extent(F.array(F.lit(None).cast("double"))).alias("b")).first()
    assert (spark_row.a.low, spark_row.a.span, spark_row.b.span) == (2.0, 1.0, None)
