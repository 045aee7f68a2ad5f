import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import document, sheets
from foliospark.sources import office
from foliospark.streaming import windows

CELLS = [
    {"sheet": 0, "sheet_name": "A & B", "row": 0, "col": 0, "kind": "str", "str": "x < y  "},
    {"sheet": 0, "sheet_name": "A & B", "row": 4, "col": 27, "kind": "num", "num": 0.1},
    {"sheet": 0, "sheet_name": "A & B", "row": 4, "col": 28, "kind": "bool", "bool": True},
    {"sheet": 1, "sheet_name": "two", "row": 1, "col": 1, "kind": "err", "err": "#N/A"},
]


def test_xlsx_round_trip_is_a_fixpoint():
    data = office.write_xlsx(CELLS)
    assert office.sniff(data) == "xlsx"
    cells, losses = office.xlsx_cells(data)
    got = [{k: c[k] for k in want} for c, want in zip(cells, CELLS, strict=True)]
    assert got == CELLS and losses == []
    assert office.write_xlsx(cells) == data


def _xlsx(sheet, shared="", names="s"):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns:r="u"><sheets><sheet name="{names}" r:id="r1"/><sheet name="gone" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/sharedStrings.xml"/></Relationships>',
        "xl/worksheets/a.xml": f"<worksheet>{sheet}</worksheet>",
        "xl/sharedStrings.xml": f"<sst>{shared}</sst>",
    }
    return office._zip(parts)


def test_xlsx_dialects():
    data = _xlsx(
        '<sheetData><row><c t="s"><v>0</v></c><c t="s"><v>7</v></c><c r="D1"><v>1.5</v></c><c><v>oops</v></c></row><row r="9"><c t="b"><v>1</v></c><c t="str"><f>A1</f><v>a_x000A_b</v></c><c s="3"/></row></sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells>',
        "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>",
    )
    cells, losses = office.xlsx_cells(data)
    assert [(c["row"], c["col"], c["kind"], c["str"] or c["num"] or c["bool"]) for c in cells] == [(0, 0, "str", "rich"), (0, 1, "str", None), (0, 3, "num", 1.5), (8, 0, "bool", True), (8, 1, "str", "a\nb")]
    assert cells[-1]["formula"] == "A1"
    assert [(x["feature"], x["detail"]) for x in losses] == [("cell.value", "E1"), ("sheet", "gone")]
    assert office.xlsx_merges(data) == [{"sheet": 0, "r0": 1, "c0": 1, "r1": 2, "c1": 2}]


STYLED = {
    "xl/workbook.xml": '<workbook xmlns:r="u"><workbookPr date1904="1"/><sheets><sheet name="one" r:id="r1"/><sheet name="two" state="hidden" r:id="r4"/></sheets><definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">one!$A$1:$B$9</definedName><definedName name="rate">one!$C$1</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="styles.xml"/><Relationship Id="r3" Target="theme/theme1.xml"/><Relationship Id="r4" Target="worksheets/b.xml"/></Relationships>',
    "xl/theme/theme1.xml": '<t><e><clrScheme><dk1><sysClr val="x" lastClr="000000"/></dk1><lt1><sysClr lastClr="FFFFFF"/></lt1><accent1><srgbClr val="4472c4"/></accent1></clrScheme></e></t>',
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0.0&quot; kg&quot;"/></numFmts><fonts><font><sz val="11"/><name val="Arial"/></font><font><b/><i val="0"/><u/><color theme="4"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFEE00"/></patternFill></fill></fills><borders><border/><border><top style="thin"/><left style="none"/></border></borders><cellXfs><xf/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment horizontal="right" wrapText="1"/></xf><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/a.xml": '<worksheet xmlns:r="u"><sheetViews><sheetView><pane state="frozen" topLeftCell="B2"/></sheetView></sheetViews><cols><col min="2" max="3" width="9.5" hidden="1" style="2"/></cols><sheetData><row r="1" ht="20" customHeight="1"><c r="A1" s="1"><v>2.25</v></c><c r="B1" s="2"><v>1</v></c></row><row r="3" hidden="1" s="1" customFormat="1"><c r="A3" t="b"><v>1</v></c></row></sheetData><autoFilter ref="A1:B9"><filterColumn colId="1"><filters blank="1"><filter val="x"/></filters></filterColumn></autoFilter><dataValidations><dataValidation type="list" allowBlank="1" sqref="A1:A2 D4"><formula1>"p,q"</formula1></dataValidation></dataValidations><conditionalFormatting sqref="A1:B2"><cfRule type="cellIs" operator="greaterThan" priority="2" dxfId="0"><formula>5</formula></cfRule></conditionalFormatting><hyperlinks><hyperlink ref="A1" r:id="r1" tooltip="tip"/></hyperlinks></worksheet>',
    "xl/worksheets/_rels/a.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x/" TargetMode="External"/><Relationship Id="r2" Target="../tables/table1.xml"/><Relationship Id="r3" Target="../comments1.xml"/><Relationship Id="r4" Target="../threadedComments/threadedComment1.xml"/><Relationship Id="r5" Target="../slicers/slicer1.xml"/><Relationship Id="r6" Target="../pivotTables/pivotTable1.xml"/><Relationship Id="r7" Target="../drawings/drawing1.xml"/></Relationships>',
    "xl/worksheets/b.xml": "<worksheet/>",
    "xl/tables/table1.xml": '<table id="7" name="T" displayName="T" ref="A1:B3" totalsRowCount="1"><autoFilter ref="A1:B2"><filterColumn colId="0"><filters><filter val="2.25"/></filters></filterColumn></autoFilter><tableColumns><tableColumn name="a_x000A_b"/><tableColumn name="c"/></tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>',
    "xl/comments1.xml": '<comments><authors><author>Ann</author></authors><commentList><comment ref="A1" authorId="0"><text><t>old</t></text></comment><comment ref="B2" authorId="0"><text><r><t>no</t></r><r><t>te</t></r></text></comment></commentList></comments>',
    "xl/threadedComments/threadedComment1.xml": '<ThreadedComments><threadedComment ref="A1" personId="p" id="1"><text>first</text></threadedComment><threadedComment ref="A1" personId="p" id="2" parentId="1" done="1"><text>reply</text></threadedComment></ThreadedComments>',
    "xl/persons/person.xml": '<personList><person displayName="Bob" id="p"/></personList>',
    "xl/slicers/slicer1.xml": '<slicers><slicer name="S" cache="C" caption="Sizes"/></slicers>',
    "xl/slicerCaches/slicerCache1.xml": '<slicerCacheDefinition name="C" sourceName="c"><extLst><ext><tableSlicerCache tableId="7" column="2"/></ext></extLst></slicerCacheDefinition>',
    "xl/pivotTables/pivotTable1.xml": '<pivotTableDefinition name="P" cacheId="3"><location ref="D1:F9" firstDataRow="1" firstDataCol="1"/><rowFields><field x="0"/></rowFields><colFields><field x="-2"/></colFields><dataFields><dataField name="Sum of v"/></dataFields></pivotTableDefinition>',
    "xl/drawings/drawing1.xml": '<d><twoCellAnchor><from><col>1</col><row>2</row></from><to><col>3</col><row>4</row></to><pic xmlns:r="u"><nvPicPr><cNvPr name="Pic"/></nvPicPr><blip r:embed="r1"/></pic></twoCellAnchor></d>',
    "xl/drawings/_rels/drawing1.xml.rels": '<Relationships><Relationship Id="r1" Target="../media/a.png"/></Relationships>',
    "docProps/core.xml": "<cp><title> T </title><creator>me</creator><subject/></cp>",
}


def test_workbook_facets(spark):
    files = spark.createDataFrame([("a", office._zip(STYLED)), ("bad", b"nothing")], "path string, content binary")
    parsed = office.parse(files, "xlsx").cache()
    get = {name: office.facet(parsed, "xlsx", name).where("path = 'a'") for name in ("cells", "styles", "sheets", "names", "rows", "columns", "validations", "rules", "links", "tables", "filters", "comments", "properties", "slicers", "pivots", "drawings")}
    assert [tuple(r)[1:] for r in get["slicers"].collect()] == [(0, "S", "Sizes", "C", "c", 7, 2)]
    pivot = get["pivots"].first()
    assert (pivot.name, pivot.cache, pivot.r0, pivot.c1, pivot.row_fields, pivot.column_fields, pivot.data) == ("P", 3, 0, 5, [0], [-2], ["Sum of v"])
    assert [tuple(r)[1:] for r in get["drawings"].collect()] == [(0, 0, "pic", "Pic", "xl/media/a.png", 2, 1, 4, 3)]
    style = get["styles"].where("idx = 1").first()
    assert (style.num_fmt, style.bold, style.italic, style.underline, style.color, style.fill, style.border_top, style.border_left, style.horizontal, style.wrap) == ('0.0" kg"', True, False, True, "4472C4", "FFEE00", "thin", None, "right", True)
    assert [(r.sheet, r.state, r.freeze, r.auto_filter, r.date1904) for r in get["sheets"].orderBy("sheet").collect()] == [(0, "visible", "B2", "A1:B9", True), (1, "hidden", None, None, True)]
    texts = {(r.row, r.col): r.text for r in sheets.cell_text(get["cells"], get["styles"], get["sheets"]).collect()}
    assert texts == {(0, 0): "2.3 kg", (0, 1): "1/2/1904", (2, 0): "TRUE"}
    assert [r.sheet for r in sheets.shown_sheets(get["sheets"], get["cells"]).collect()] == [0]
    shown = sheets.visible(sheets.clipped(get["cells"], sheets.print_areas(get["names"])), get["rows"], get["columns"]).collect()
    assert [(r.row, r.col) for r in shown] == [(0, 0)]
    assert [(r.seq, r.kind, r.formula1, r.r0, r.c0, r.r1) for r in get["validations"].orderBy("r0").collect()] == [(0, "list", '"p,q"', 0, 0, 1), (0, "list", '"p,q"', 3, 3, 3)]
    assert get["rules"].first().formulas == ["5"] and get["links"].first().target == "http://x/"
    t = get["tables"].first()
    assert (t.id, t.name, t.r1, t.c1, t.totals_rows, t.row_stripes, t.columns) == (7, "T", 2, 1, 1, True, ["a\nb", "c"])
    assert sorted((r.table_id or 0, r.column, r.vals, r.blank) for r in get["filters"].collect()) == [(0, 1, ["x"], True), (7, 0, ["2.25"], False)]
    threads = sheets.thread_of(get["comments"]).orderBy("seq").collect()
    assert [(r.author, r.text, r.thread, r.place, r.done) for r in threads] == [("Bob", "first", "1", 1, False), ("Bob", "reply", "1", 2, True), ("Ann", "note", "#2", 1, False)]
    assert {r.name: r.value for r in get["properties"].collect()} == {"title": "T", "creator": "me"}
    blank = get["cells"].limit(0).union(spark.createDataFrame([("a", 0, "one", False, 2, 1, "str", None, "x", None, None, None, None), ("a", 0, "one", False, 8, 2, "str", None, "x", None, None, None, None), ("a", 0, "one", False, 8, 5, "str", None, "x", None, None, None, None)], get["cells"].schema))
    assert [r.style for r in sheets.with_default_style(blank, get["rows"], get["columns"]).orderBy("row", "col").collect()] == [1, 2, 0]
    assert office.facet(parsed, "xlsx", "losses").where("path = 'bad'").count() == 1


def test_sheet_operators(spark):
    cells = spark.createDataFrame([(0, r, c, "str", None, t, t) for r, c, t in [(0, 0, "name"), (0, 1, "v"), (1, 0, "a"), (1, 1, "x"), (2, 0, "b"), (4, 0, "C"), (4, 1, "Y"), (9, 0, "out")]], "sheet int, row int, col int, kind string, num double, str string, text string")
    areas = spark.createDataFrame([(0, 0, 0, 4, 1)], "sheet int, r0 int, c0 int, r1 int, c1 int")
    filters = spark.createDataFrame([(0, 1, ["X"], True)], "sheet int, column int, vals array<string>, blank boolean")
    passes = {(r.row): r.passes for r in sheets.filtered(cells, filters, areas, by=["sheet"]).where("col = 0").collect()}
    assert passes == {0: True, 1: True, 2: True, 4: False, 9: True}
    window = {r.row: r["values"] for r in sheets.dense(cells, "text", ["sheet"], max_rows=5).collect()}
    assert window == {0: ["name", "v"], 1: ["a", "x"], 2: ["b", None], 3: [None, None], 4: ["C", "Y"]}
    rules = spark.createDataFrame([("list", "between", '"a, b"', None, True, 0, 0, 9, 0, 0)], "kind string, operator string, formula1 string, formula2 string, allow_blank boolean, r0 int, c0 int, r1 int, c1 int, seq int").withColumn("sheet", F.lit(0))
    valid = {(r.row, r.col): r.valid for r in sheets.validated(cells, rules, by=[]).collect()}
    assert valid[1, 0] is True and valid[4, 0] is False and valid[0, 1] is None
    assert [(r.row, r.texts) for r in sheets.projected(cells, ["sheet"]).orderBy("row").collect()][:2] == [(0, ["name", "v"]), (1, ["a", "x"])]


def test_docx():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Head</w:t></w:r></w:p>'
        "<w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
        '<w:tbl><w:tr><w:tc><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>cell</w:t><w:drawing/></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    data = office._zip({"word/document.xml": f'<w:document xmlns:w="u"><w:body>{body}</w:body></w:document>'})
    blocks, losses = office.docx_blocks(data)
    assert [b["text"] for b in blocks] == ["Head", "a\tnewlink", "cell"]
    assert blocks[0]["bold"] and blocks[0]["style"] == "Heading2" and blocks[2]["cell"] == "/0,0" and (blocks[2]["num_id"], blocks[2]["ilvl"]) == ("5", 1)
    assert losses == [{"severity": "dropped", "feature": "images", "detail": "drawing"}]
    again, _ = office.docx_blocks(office.write_docx(blocks))
    assert [b["text"].replace("\t", "") for b in again] == ["Head", "anewlink", "cell"]


WORD = {
    "word/document.xml": '<w:document xmlns:w="u" xmlns:r="v"><w:body><w:p><w:bookmarkStart w:name="here"/><w:r><w:rPr><w:b/><w:sz w:val="28"/><w:color w:val="ff0000"/><w:rStyle w:val="Strong"/></w:rPr><w:t>bold</w:t></w:r><w:commentRangeStart w:id="4"/><w:hyperlink r:id="r1"><w:r><w:t>out</w:t></w:r></w:hyperlink><w:commentRangeEnd w:id="4"/><w:hyperlink w:anchor="here"><w:r><w:t>in</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:footnoteReference w:id="2"/></w:r></w:p><w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:fldChar w:fldCharType="begin"><w:ffData><w:checkBox><w:checked/></w:checkBox></w:ffData></w:fldChar></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p><w:sectPr><w:headerReference w:type="first" r:id="r2"/><w:pgSz w:w="12240" w:h="15840" w:orient="landscape"/><w:pgMar w:top="1440" w:left="720"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x/" TargetMode="External"/><Relationship Id="r2" Target="header1.xml"/></Relationships>',
    "word/header1.xml": '<w:hdr xmlns:w="u"><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>',
    "word/styles.xml": '<w:styles xmlns:w="u"><w:style w:type="paragraph" w:styleId="H1" w:default="1"><w:name w:val="heading 1"/><w:basedOn w:val="Base"/><w:pPr><w:outlineLvl w:val="0"/><w:jc w:val="center"/><w:spacing w:before="240"/></w:pPr><w:rPr><w:i/><w:b w:val="0"/><w:rFonts w:ascii="Arial"/></w:rPr></w:style></w:styles>',
    "word/numbering.xml": '<w:numbering xmlns:w="u"><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="9"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>',
    "word/footnotes.xml": '<w:footnotes xmlns:w="u"><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "word/comments.xml": '<w:comments xmlns:w="u"><w:comment w:id="4" w:author="Ann"><w:p w:paraId="A1"><w:r><w:t>why</w:t></w:r></w:p></w:comment><w:comment w:id="5" w:author="Bob"><w:p w:paraId="A2"><w:r><w:t>so</w:t></w:r></w:p></w:comment></w:comments>',
    "word/commentsExtended.xml": '<x:ex xmlns:x="u"><x:c x:paraId="A2" x:paraIdParent="A1" x:done="1"/></x:ex>',
    "word/charts/chart1.xml": '<c:chartSpace xmlns:c="u"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:strCache><c:pt><c:v>S</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache><c:pt><c:v>p</c:v></c:pt></c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:pt><c:v>2.5</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>',
}


def test_document_facets(spark):
    parsed = office.parse(spark.createDataFrame([("a", office._zip(WORD))], "path string, content binary"), "docx").cache()
    get = {name: office.facet(parsed, "docx", name).collect() for name in ("rows", "runs", "styles", "levels", "notes", "comments", "cells", "bookmarks", "sections", "bands", "fields", "checks", "charts", "losses")}
    assert [r.text for r in get["rows"]] == ["boldoutinnew", "a", "b", "", "c", "7"]
    runs = get["runs"]
    assert (runs[0].text, runs[0].bold, runs[0].size, runs[0].color, runs[0].style) == ("bold", True, 14.0, "FF0000", "Strong")
    assert [(r.text, r.href, r.anchor, r.comment, r.inserted, r.note_ref) for r in runs[1:5]] == [("out", "http://x/", None, "4", False, None), ("in", None, "here", None, False, None), ("new", None, None, None, True, None), ("", None, None, None, False, "2")]
    s = get["styles"][0]
    assert (s.style_id, s.based_on, s.is_default, s.outline_level, s.alignment, s.space_before, s.bold, s.italic, s.font) == ("H1", "Base", True, 0, "center", 12.0, False, True, "Arial")
    assert [tuple(r)[1:] for r in get["levels"]] == [("5", 0, "upperRoman", "%1.", 3)] and [tuple(r)[1:] for r in get["notes"]] == [("footnote", "2", "note")]
    assert [(r.id, r.author, r.text, r.parent, r.done) for r in get["comments"]] == [("4", "Ann", "why", None, False), ("5", "Bob", "so", "4", True)]
    assert [(r.row, r.col, r.span, r.vmerge, r.text, r.header) for r in get["cells"]] == [(0, 0, 2, "restart", "a", True), (0, 2, 1, None, "b", True), (1, 0, 2, "continue", "", False), (1, 2, 1, None, "c", False)]
    assert get["bookmarks"][0].name == "here" and [tuple(r)[1:] for r in get["bands"]] == [("header", "first", "top")]
    sec = get["sections"][0]
    assert (sec.width, sec.landscape, sec.top, sec.left, sec.columns) == (612.0, True, 72.0, 36.0, 2)
    assert [(r.block, r.code, r.result) for r in get["fields"]] == [(5, "PAGE", "7")] and get["checks"][0].checked
    assert [(r.kind, r.name, r.categories, r.vals) for r in get["charts"]] == [("bar", "S", ["p"], [2.5])]
    tables = office.facet(parsed, "docx", "cells")
    assert document.html_tables(tables, ["table"]).first().html == '<table>\n<tr><th colspan="2" rowspan="2">a</th><th>b</th></tr>\n<tr><td>c</td></tr>\n</table>'
    assert document.markdown_tables(tables, ["table"]).first().markdown == "| a |  | b |\n| --- | --- | --- |\n|  |  | c |"


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(office.write_xlsx(CELLS))
    (tmp_path / "b.docx").write_bytes(office.write_docx([{"seq": 0, "style": "Title", "text": "T"}, {"seq": 1, "text": "body"}]))
    (tmp_path / "c.bin").write_bytes(b"nothing")
    (tmp_path / "d.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest")
    deck = {"ppt/presentation.xml": '<p xmlns:r="u"><sldIdLst><sldId r:id="r1"/></sldIdLst></p>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s.xml"/></Relationships>', "ppt/slides/s.xml": '<sld><sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><p><r><t>Hello</t></r></p><p><pPr lvl="1"/><r><t>sub</t></r></p></txBody></sp></sld>'}
    (tmp_path / "e.pptx").write_bytes(office._zip(deck))
    cells, losses = office.read(spark, str(tmp_path), "xlsx")
    assert cells.count() == 4 and losses.count() == 4
    blocks, _ = office.read(spark, str(tmp_path), "docx")
    assert [(r.level, r.text) for r in office.outline(blocks).collect()] == [(1, "T")]
    slides, _ = office.read(spark, str(tmp_path), "pptx")
    assert [(r.placeholder, r.level, r.text) for r in slides.orderBy("seq").collect()] == [("title", 0, "Hello"), ("title", 1, "sub")]
    files = office.to_files(cells.select("path", "sheet", "sheet_name", "row", "col", "kind", "num", "str", "bool", "err"), "path", "xlsx").first()
    assert bytes(files.content) == office.write_xlsx(CELLS)
    marked = blocks.withColumns({"level": F.lit(1), "kind": F.when(F.col("style") == "Title", "heading").otherwise("p")})
    assert document.markdown(marked, ["path"], "seq").first().markdown == "# T\n\nbody"


def test_packages_over_their_limits_are_refused(monkeypatch):
    data = office.write_xlsx(CELLS)
    monkeypatch.setattr(office, "MAX_ENTRIES", 1)
    with pytest.raises(office.Refused):
        office.Package(data)
    bad = office._zip({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"})
    monkeypatch.setattr(office, "MAX_ENTRIES", 100)
    with pytest.raises(office.Refused):
        office.docx_blocks(bad)
    assert office.sniff(b"PK\x03\x04junk") is None and zipfile.is_zipfile(__import__("io").BytesIO(data))


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "a", 2.0), (2, "2024-01-01 00:04:00", "a", 5.0), (3, "2024-01-01 00:06:00", "a", 1.0), (4, "2024-01-01 00:02:00", "b", 9.0)]
    events = spark.createDataFrame(rows, "id int, t string, k string, v double").select("id", F.to_timestamp("t").alias("ts"), "k", "v")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windows.windowed_formulas(stream, "ts", "5 minutes", {"s": "SUM(v)", "n": 'COUNTIF(v,">1")'}, ["k"])
    query = out.writeStream.outputMode("complete").format("memory").queryName("win").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.k, r.start.minute): (r.s, r.n) for r in spark.table("win").collect()}
    batch = {(r.k, r.start.minute): (r.s, r.n) for r in windows.windowed_formulas(events, "ts", "5 minutes", {"s": "SUM(v)", "n": 'COUNTIF(v,">1")'}, ["k"]).collect()}
    assert got == batch == {("a", 0): (7.0, 2.0), ("a", 5): (1.0, 0.0), ("b", 0): (9.0, 1.0)}
    assert {(r.k, r.n) for r in windows.sessions(events, "ts", "4 minutes", "k").collect()} == {("a", 3), ("b", 1)}
