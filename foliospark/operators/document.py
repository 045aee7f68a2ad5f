"""Document structure: counters and numbering, notes, outlines, markdown and HTML assembly, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_markdown, guard_block_start

#: The marks of the chicago style, and roman numerals by place.
CHICAGO = ("*", "†", "‡", "§")
_ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
)


def roman(n: Column) -> Column:
    digit = lambda place, table: F.get(F.array(*map(F.lit, table)), (F.floor(n / place) % 10).cast("int"))
    return F.when(n > 0, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, _ROMAN[2]), digit(10, _ROMAN[1]), digit(1, _ROMAN[0]))).otherwise("")


def letters(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA."""
    from .grid import column_letters

    return F.when(n > 0, column_letters(n - 1)).otherwise("")


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def counter(style: str, n: Column) -> Column:
    """A list counter's text; styles without a zero give empty text for it."""
    digits = n.cast("string")
    forms = {
        "decimal": lambda: digits,
        "decimalZero": lambda: F.when(n < 10, F.concat(F.lit("0"), digits)).otherwise(digits),
        "decimalFullWidth": lambda: F.translate(digits, "0123456789", "０１２３４５６７８９"),
        "ordinal": lambda: ordinal(n),
        "upperLetter": lambda: letters(n),
        "lowerLetter": lambda: F.lower(letters(n)),
        "upperRoman": lambda: roman(n),
        "lowerRoman": lambda: F.lower(roman(n)),
        "ideographDigital": lambda: F.translate(digits, "0123456789", "〇一二三四五六七八九"),
        "ideographTraditional": lambda: F.when(n < 1, "").when(n <= 10, F.substring(F.lit("甲乙丙丁戊己庚辛壬癸"), n.cast("int"), F.lit(1))).otherwise(digits),
        "ideographZodiac": lambda: F.when(n < 1, "").when(n <= 12, F.substring(F.lit("子丑寅卯辰巳午未申酉戌亥"), n.cast("int"), F.lit(1))).otherwise(digits),
        "decimalEnclosedCircle": lambda: F.when(n.between(1, 20), F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"), n.cast("int"), F.lit(1))).otherwise(digits),
        "chicago": lambda: F.when(n < 1, "").otherwise(F.repeat(F.get(F.array(*map(F.lit, CHICAGO)), ((n - 1) % 4).cast("int")), (F.floor((n - 1) / 4) + 1).cast("int"))),
    }
    return F.when(n >= 0, forms[style]()).otherwise("") if style in forms else F.lit("")


def number_lists(blocks: DataFrame, starts: dict[int, int] | None = None) -> DataFrame:
    """blocks(doc_id, seq, num_id, ilvl) with counters: the current count of every level up to its own.

    A level restarts when a shallower item comes after its last use, so the count is the number
    of items of this level since the last shallower item: windows over (doc, list) only.
    """
    listed = Window.partitionBy("doc_id", "num_id").orderBy("seq")
    starts = starts or {}
    out = blocks
    for level in range(9):
        shallower = F.sum((F.col("ilvl") < level).cast("int")).over(listed.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"_e{level}", shallower)
        part = Window.partitionBy("doc_id", "num_id", f"_e{level}").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_n{level}", F.sum((F.col("ilvl") == level).cast("int")).over(part) + (starts.get(level, 1) - 1))
    counts = F.array(*[F.greatest(F.col(f"_n{k}"), F.lit(starts.get(k, 1))) for k in range(9)])
    return out.withColumn("counters", F.when(F.col("num_id").isNotNull(), F.slice(counts, F.lit(1), F.col("ilvl") + 1))).select(*blocks.columns, "counters")


def level_marker(template: str, styles: Sequence[str], counters: Column) -> Column:
    """A marker such as %1.%2) from the counters of its levels."""
    parts: list[Column] = []
    k = 0
    while k < len(template):
        if template[k] == "%" and template[k + 1 : k + 2].isdigit():
            level = int(template[k + 1]) - 1
            parts.append(F.coalesce(counter(styles[level], F.get(counters, F.lit(level))), F.lit("")))
            k += 2
        else:
            parts.append(F.lit(template[k]))
            k += 1
    return F.concat(*parts)


def note_numbers(references: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, note_ref, number): notes that exist, in order of first reference."""
    known = references.join(notes.select("doc_id", "note_ref").distinct(), ["doc_id", "note_ref"], "left_semi")
    first = known.groupBy("doc_id", "note_ref").agg(F.min("seq").alias("first"))
    return first.select("doc_id", "note_ref", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "note_ref")).alias("number"))


def markdown(blocks: DataFrame, by: Sequence[str], order: str, kind: str = "kind", text: str = "text", level: str = "level") -> DataFrame:
    """One markdown text per group from ordered blocks: heading, item, quote, code or paragraph."""
    body = escape_markdown(F.col(text))
    line = (
        F.when(F.col(kind) == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.least(F.col(level), F.lit(6)), F.lit(1))), F.lit(" "), body))
        .when(F.col(kind) == "item", F.concat(F.repeat(F.lit("  "), F.greatest(F.col(level), F.lit(0))), F.lit("- "), body))
        .when(F.col(kind) == "quote", F.concat(F.lit("> "), body))
        .when(F.col(kind) == "code", F.concat(F.lit("```\n"), F.col(text), F.lit("\n```")))
        .otherwise(guard_block_start(body))
    )
    rows = blocks.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*by, F.struct(F.col(order), line.alias("line")).alias("b"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n\n").alias("markdown"))


def html(blocks: DataFrame, by: Sequence[str], order: str, kind: str = "kind", text: str = "text", level: str = "level") -> DataFrame:
    """One HTML body per group from ordered blocks."""
    body = escape_html(F.col(text))
    tag = F.when(F.col(kind) == "heading", F.concat(F.lit("h"), F.greatest(F.least(F.col(level), F.lit(6)), F.lit(1)).cast("string"))).when(F.col(kind) == "item", "li").when(F.col(kind) == "quote", "blockquote").when(F.col(kind) == "code", "pre").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
    rows = blocks.where(F.col(text).isNotNull()).select(*by, F.struct(F.col(order), line.alias("line")).alias("b"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n").alias("html"))


def distinct_losses(losses: DataFrame) -> DataFrame:
    """One row per (doc_id, severity, feature, detail), with how often it was reported."""
    return losses.groupBy("doc_id", "severity", "feature", "detail").agg(F.count("*").alias("times"))


def strict(losses: DataFrame) -> DataFrame:
    """Fails the query on the first loss."""
    return losses.select(F.raise_error(F.concat_ws(" ", F.lit("loss:"), "severity", "feature", "detail")).alias("never"))


def cascade(rows: DataFrame, styles: DataFrame, properties: Sequence[str], depth: int = 12) -> DataFrame:
    """Direct properties, else those of the style, else of the styles it is based on, nearest first.

    styles: style_id, based_on and properties. The chain is followed at most `depth` links, so
    a cycle ends; each link is a join with the small style table.
    """
    out = rows.withColumn("_next", F.col("style_id"))
    for _ in range(depth):
        link = styles.select(F.col("style_id").alias("_sid"), F.col("based_on").alias("_up"), *[F.col(p).alias(f"_s_{p}") for p in properties])
        out = out.join(link, out["_next"] == link["_sid"], "left")
        out = out.select(*[c for c in rows.columns if c not in properties], *[F.coalesce(p, f"_s_{p}").alias(p) for p in properties], F.col("_up").alias("_next"))
    return out.drop("_next").select(rows.columns)


def header_footer(text: str, page: Column, pages: Column, sheet: Column, file: Column) -> dict[str, Column]:
    """The left, centre and right parts of a header string with &P, &N, &A, &F and && filled in; formats are dropped."""
    import re

    parts = {"L": "", "C": "", "R": ""}
    at = "C"
    for token in re.findall(r'&[LCR]|&"[^"]*"|&\d+|&K[0-9A-Fa-f]{6}|&[A-Za-z&]|[^&]+', text):
        if token in ("&L", "&C", "&R"):
            at = token[1]
        else:
            parts[at] += "" if re.fullmatch(r'&"[^"]*"|&\d+|&K[0-9A-Fa-f]{6}|&[BIUSEXY]', token) else token
    fields = {"&P": page.cast("string"), "&N": pages.cast("string"), "&A": sheet, "&F": file, "&&": F.lit("&")}
    return {{"L": "left", "C": "center", "R": "right"}[k]: F.concat(F.lit(""), *[fields[t] if t in fields else F.lit("" if t.startswith("&") else t) for t in re.findall(r"&[A-Za-z&]|[^&]+", v)]) for k, v in parts.items()}



# --- tables, nested lists, anchors ----------------------------------------------------------


def grid_columns(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and columns: the widest row of each table, by the sum of its cells' spans."""
    rows = cells.groupBy(*by, "row").agg(F.sum(F.coalesce("span", F.lit(1))).alias("_n"))
    return rows.groupBy(*by).agg(F.max("_n").alias("columns"))


def row_spans(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """cells with row_span: 1 and the unbroken run of cells below that continue a vertical merge.

    cells: by, row, col (where the cell starts) and vmerge: restart, continue or null.
    """
    column = Window.partitionBy(*by, "col").orderBy("row")
    starts = F.coalesce(F.col("vmerge") != "continue", F.lit(True)) | (F.col("row") != F.lag("row").over(column) + 1)
    marked = cells.withColumn("_g", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(column))
    group = Window.partitionBy(*by, "col", "_g")
    first = Window.partitionBy(*by, "col", "_g").orderBy("row")
    held = F.first(F.coalesce(F.col("vmerge") == "restart", F.lit(False))).over(first)
    span = F.when((F.row_number().over(first) == 1) & held, F.count("*").over(group)).otherwise(1)
    return marked.withColumn("row_span", span.cast("int")).drop("_g")


def markdown_tables(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One GFM table per group: its first row as head, cells escaped, short rows filled, trailing empty rows and columns left out.

    cells: by, row, col, text and, if there, span; a cell that spans columns leaves the ones it covers empty.
    """
    full = cells.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    size = full.groupBy(*by).agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    body = F.regexp_replace(escape_markdown(F.trim("text")), r"\s*\n\s*", "<br>")
    held = full.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", body.alias("t")))).alias("_m"))
    rows = size.select(*by, "_cols", F.explode(F.sequence(F.lit(0), F.col("_rows"))).alias("row")).join(held, [*by, "row"], "left")
    line = lambda items: F.concat(F.lit("| "), F.array_join(items, " | "), F.lit(" |"))
    places = F.sequence(F.lit(0), F.col("_cols"))
    texts = F.transform(places, lambda c: F.coalesce(F.try_element_at(F.coalesce("_m", F.expr("cast(map() as map<int,string>)")), c), F.lit("")))
    rule = line(F.transform(places, lambda c: F.lit("---")))
    lines = rows.select(*by, F.struct("row", F.when(F.col("row") == 0, F.concat(line(texts), F.lit("\n"), rule)).otherwise(line(texts)).alias("l")).alias("b"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["l"]), "\n").alias("markdown"))


def html_tables(cells: DataFrame, by: Sequence[str], header_rows: int = 1) -> DataFrame:
    """One HTML table per group; spans become colspan and rowspan, continued cells go.

    cells: by, row, col, text, span, vmerge (the last two may be missing).
    """
    missing = {c: F.lit(None).cast(t) for c, t in (("span", "int"), ("vmerge", "string")) if c not in cells.columns}
    spanned = row_spans(cells.withColumns(missing) if missing else cells, by).where(F.coalesce(F.col("vmerge") != "continue", F.lit(True)))
    tag = F.when(F.col("row") < header_rows, "th").otherwise("td")
    extra = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, extra("colspan", F.coalesce("span", F.lit(1))), extra("rowspan", F.col("row_span")), F.lit(">"), F.replace(escape_html(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br/>")), F.lit("</"), tag, F.lit(">"))
    rows = spanned.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))), lambda x: x["c"]), "").alias("_c"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.concat(F.lit("<tr>"), F.col("_c"), F.lit("</tr>")).alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit("<table>\n"), lines, F.lit("\n</table>")).alias("html"))


def list_items(blocks: DataFrame, by: Sequence[str], order: str, level: str = "level", marker: str = "marker") -> DataFrame:
    """Items with nesting and number: markdown's indent by how many shallower items enclose one, and its ordinal.

    A run of items is broken by any other block (null level). An item's number is its marker's
    digits, else its count among the siblings since the last shallower item; bullets have none.
    """
    along = Window.partitionBy(*by).orderBy(order)
    listed = blocks.withColumn("_run", F.sum(F.col(level).isNull().cast("int")).over(along)).where(F.col(level).isNotNull())
    run = Window.partitionBy(*by, "_run").orderBy(order)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    out = listed
    for k in range(9):  # an item of level k starts a new part for all deeper ones
        out = out.withColumn(f"_s{k}", F.sum((F.col(level) < k).cast("int")).over(upto))
    part = F.element_at(F.array(*[F.col(f"_s{k}") for k in range(9)]), F.least(F.col(level), F.lit(8)) + 1)
    out = out.withColumn("_part", part)
    sibling = Window.partitionBy(*by, "_run", level, "_part").orderBy(order)
    enclosing = [F.when(F.col(level) > k, (F.max(F.when(F.col(level) == k, F.col(order))).over(upto) > F.coalesce(F.max(F.when(F.col(level) < k, F.col(order))).over(upto), F.lit(-1))).cast("int")).otherwise(0) for k in range(9)]
    nesting = sum((F.coalesce(e, F.lit(0)) for e in enclosing), F.lit(0))
    digits = F.regexp_extract(marker, r"(\d+)", 1)
    ordered = F.col(marker).rlike(r"[0-9A-Za-z]")
    number = F.when(ordered, F.when(digits != "", digits.cast("int")).otherwise(F.row_number().over(sibling)))
    return out.withColumns({"nesting": nesting, "number": number}).select(*blocks.columns, "nesting", "number")


def markdown_items(items: DataFrame, by: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """One markdown list per group from list_items()."""
    bullet = F.when(F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    line = F.concat(F.repeat(F.lit("  "), F.col("nesting")), bullet, escape_markdown(F.col(text)))
    return items.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda b: b["l"]), "\n").alias("markdown"))


def note_definitions(notes: DataFrame, numbers: DataFrame, prefix: str = "fn") -> DataFrame:
    """doc_id, number, line: the definitions of the notes that are referred to, in order of their numbers."""
    both = numbers.join(notes.select("doc_id", "note_ref", "text"), ["doc_id", "note_ref"])
    return both.select("doc_id", "number", F.concat(F.lit(f"[^{prefix}"), F.col("number").cast("string"), F.lit("]: "), escape_markdown(F.regexp_replace(F.trim("text"), r"\s*\n\s*", " "))).alias("line"))


def slug(name: Column) -> Column:
    """A bookmark's name as an anchor: lower-case letters and digits with hyphens between."""
    made = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "bookmark").otherwise(made)


def used_bookmarks(bookmarks: DataFrame, links: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The bookmarks (by, name) that some link's anchor names, with their slug."""
    wanted = links.where("anchor is not null").select(*by, F.col("anchor").alias("name")).distinct()
    return bookmarks.join(wanted, [*by, "name"], "left_semi").withColumn("slug", slug(F.col("name")))


def resolved_names(names: DataFrame, sheets: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """by, sheet, name, value: what each name means on each sheet; a sheet's own beats the workbook's."""
    own = names.where("sheet is not null").select(*by, "sheet", F.lower("name").alias("name"), "value")
    common = names.where("sheet is null").select(*by, F.lower("name").alias("name"), "value")
    everywhere = sheets.select(*by, "sheet").join(common, list(by)) if by else sheets.select("sheet").join(F.broadcast(common), how="cross")
    rest = everywhere.join(own.select(*by, "sheet", "name"), [*by, "sheet", "name"], "left_anti")
    return own.unionByName(rest)
