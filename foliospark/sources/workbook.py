"""The parts of a workbook beside its cells, as facets: styles, names, layout, tables, rules, notes, properties.

Each facet is a list of flat rows. Styles resolve to what a cell shows: its number format code,
font, fill and borders. Colours are RRGGBB; theme colours are taken without a tint.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..functions.numfmt import BUILT_IN
from ..plans.syntax import FormulaError, parse_cell
from .office import Package, Refused, _attr, _child, _local, _rich, unescape, xlsx_cells

#: Facet name to the schema of its rows.
FACETS = {
    "cells": "sheet int, sheet_name string, hidden boolean, row int, col int, kind string, num double, str string, bool boolean, err string, formula string, style int",
    "sheets": "sheet int, sheet_name string, state string, default_width double, default_height double, freeze string, auto_filter string, date1904 boolean",
    "styles": "idx int, num_fmt_id int, num_fmt string, font string, size double, bold boolean, italic boolean, underline boolean, strike boolean, color string, fill string, border_top string, border_right string, border_bottom string, border_left string, horizontal string, vertical string, wrap boolean, indent int",
    "names": "name string, sheet int, value string, hidden boolean",
    "merges": "sheet int, r0 int, c0 int, r1 int, c1 int",
    "columns": "sheet int, c0 int, c1 int, width double, hidden boolean, style int, level int",
    "rows": "sheet int, row int, height double, custom boolean, hidden boolean, style int, level int",
    "validations": "sheet int, seq int, kind string, operator string, formula1 string, formula2 string, allow_blank boolean, r0 int, c0 int, r1 int, c1 int",
    "rules": "sheet int, seq int, kind string, priority int, operator string, formulas array<string>, format int, stop boolean, r0 int, c0 int, r1 int, c1 int",
    "links": "sheet int, seq int, target string, location string, tooltip string, r0 int, c0 int, r1 int, c1 int",
    "tables": "sheet int, id int, name string, r0 int, c0 int, r1 int, c1 int, header_rows int, totals_rows int, style string, row_stripes boolean, column_stripes boolean, first_column boolean, last_column boolean, columns array<string>",
    "filters": "sheet int, table_id int, column int, vals array<string>, blank boolean",
    "comments": "sheet int, row int, col int, seq int, author string, text string, parent string, id string, done boolean",
    "charts": "part string, series int, kind string, name string, categories array<string>, vals array<double>",
    "slicers": "sheet int, name string, caption string, cache string, source string, table_id int, column int",
    "pivots": "sheet int, name string, cache int, r0 int, c0 int, r1 int, c1 int, first_data_row int, first_data_col int, row_fields array<int>, column_fields array<int>, data array<string>",
    "drawings": "sheet int, seq int, kind string, name string, target string, r0 int, c0 int, r1 int, c1 int",
    "properties": "name string, value string",
    "losses": "severity string, feature string, detail string",
}
#: The scheme slots in the order a theme index counts them.
_THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")


def area(text: str) -> tuple[int, int, int, int] | None:
    """The corners of A1:B2 or a sheet's area, whole rows and columns included; null if it is none."""
    text = text.rsplit("!", 1)[-1].replace("$", "").strip()
    a, _, b = text.partition(":")
    b = b or a
    try:
        if a.isdigit() and b.isdigit():
            return int(a) - 1, 0, int(b) - 1, 16383
        if a.isalpha() and b.isalpha():
            return 0, parse_cell(a + "1")[1], 1048575, parse_cell(b + "1")[1]
        (r0, c0, *_), (r1, c1, *_) = parse_cell(a), parse_cell(b)
    except FormulaError:
        return None
    return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)


def _corners(text: str) -> Iterator[dict]:
    for part in (text or "").split():
        if found := area(part):
            yield dict(zip(("r0", "c0", "r1", "c1"), found, strict=True))


def _flag(node: ET.Element | None, name: str, default: bool = False) -> bool:
    value = None if node is None else node.attrib.get(name)
    return default if value is None else value in ("1", "true", "on")


def _int(node: ET.Element, name: str, default: int | None = None) -> int | None:
    value = node.attrib.get(name, "")
    return int(value) if value.lstrip("-").isdigit() else default


def _float(node: ET.Element, name: str) -> float | None:
    try:
        return float(node.attrib[name])
    except (KeyError, ValueError):
        return None


def _children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if _local(c.tag) == name]


def _theme(package: Package, links: dict[str, str]) -> list[str | None]:
    root = package.xml(next((p for p in links.values() if "/theme/" in p), "xl/theme/theme1.xml"))
    scheme = next((n for n in root.iter() if _local(n.tag) == "clrScheme"), None) if root is not None else None
    slots = {}
    for slot in scheme if scheme is not None else ():
        for c in slot:
            slots[_local(slot.tag)] = (c.attrib.get("lastClr") or c.attrib.get("val") or "").upper() or None
    return [slots.get(name) for name in _THEME]


def _colour(node: ET.Element | None, theme: list[str | None]) -> str | None:
    if node is None:
        return None
    if rgb := node.attrib.get("rgb"):
        return rgb[-6:].upper()
    slot = _int(node, "theme")
    return theme[slot] if slot is not None and 0 <= slot < len(theme) else None


def styles(package: Package, links: dict[str, str]) -> list[dict]:
    """One row a cell format, with all that it indexes."""
    root, theme = package.xml(next((p for p in links.values() if p.endswith("styles.xml")), "xl/styles.xml")), _theme(package, links)
    if root is None:
        return []
    codes = BUILT_IN | {_int(n, "numFmtId", -1): n.attrib.get("formatCode", "") for n in _children(_child(root, "numFmts"), "numFmt")}
    fonts, fills, borders = (_children(_child(root, plural), one) for plural, one in (("fonts", "font"), ("fills", "fill"), ("borders", "border")))
    pick = lambda items, k: items[k] if k is not None and 0 <= k < len(items) else None
    on = lambda font, name: (n := _child(font, name)) is not None and _flag(n, "val", True)
    out = []
    for idx, xf in enumerate(_children(_child(root, "cellXfs"), "xf")):
        font, fill, border = pick(fonts, _int(xf, "fontId", 0)), _child(pick(fills, _int(xf, "fillId", 0)), "patternFill"), pick(borders, _int(xf, "borderId", 0))
        name, size, align, code = _child(font, "name"), _child(font, "sz"), _child(xf, "alignment"), _int(xf, "numFmtId", 0)
        solid = fill is not None and fill.attrib.get("patternType") == "solid"
        edges = {f"border_{side}": None if (e := _child(border, side)) is None or e.attrib.get("style") in (None, "none") else e.attrib["style"] for side in ("top", "right", "bottom", "left")}
        held = align.attrib if align is not None else {}
        out.append(
            {"idx": idx, "num_fmt_id": code, "num_fmt": codes.get(code, "General"), "font": None if name is None else name.attrib.get("val"), "size": None if size is None else _float(size, "val"), "bold": on(font, "b"), "italic": on(font, "i"), "underline": (u := _child(font, "u")) is not None and u.attrib.get("val") != "none", "strike": on(font, "strike")}
            | {"color": _colour(_child(font, "color"), theme), "fill": _colour(_child(fill, "fgColor"), theme) if solid else None, "horizontal": held.get("horizontal"), "vertical": held.get("vertical"), "wrap": _flag(align, "wrapText"), "indent": int(held.get("indent", 0))}
            | edges
        )
    return out


def _sheet_rows(k: int, root: ET.Element) -> Iterator[tuple[str, dict]]:
    for m in _children(_child(root, "mergeCells"), "mergeCell"):
        for c in _corners(m.attrib.get("ref", "")):
            yield "merges", {"sheet": k} | c
    for c in _children(_child(root, "cols"), "col"):
        yield "columns", {"sheet": k, "c0": _int(c, "min", 1) - 1, "c1": _int(c, "max", 1) - 1, "width": _float(c, "width"), "hidden": _flag(c, "hidden"), "style": _int(c, "style"), "level": _int(c, "outlineLevel", 0)}
    row = -1
    for r in _children(_child(root, "sheetData"), "row"):
        row = _int(r, "r", row + 2) - 1
        if {"ht", "hidden", "s", "customHeight", "outlineLevel"} & set(r.attrib):
            yield "rows", {"sheet": k, "row": row, "height": _float(r, "ht"), "custom": _flag(r, "customHeight"), "hidden": _flag(r, "hidden"), "style": _int(r, "s") if _flag(r, "customFormat") else None, "level": _int(r, "outlineLevel", 0)}
    text = lambda node, name: None if (n := _child(node, name)) is None else n.text
    for seq, v in enumerate(_children(_child(root, "dataValidations"), "dataValidation")):
        for c in _corners(v.attrib.get("sqref", "")):
            yield "validations", {"sheet": k, "seq": seq, "kind": v.attrib.get("type", "none"), "operator": v.attrib.get("operator", "between"), "formula1": text(v, "formula1"), "formula2": text(v, "formula2"), "allow_blank": _flag(v, "allowBlank")} | c
    for seq, f in enumerate(_children(root, "conditionalFormatting")):
        for rule in _children(f, "cfRule"):
            for c in _corners(f.attrib.get("sqref", "")):
                yield "rules", {"sheet": k, "seq": seq, "kind": rule.attrib.get("type"), "priority": _int(rule, "priority", 0), "operator": rule.attrib.get("operator"), "formulas": [n.text or "" for n in _children(rule, "formula")], "format": _int(rule, "dxfId"), "stop": _flag(rule, "stopIfTrue")} | c


def _linked(package: Package, k: int, root: ET.Element, links: dict[str, str]) -> Iterator[tuple[str, dict]]:
    """What a sheet points at: links, tables, slicers, pivot tables, drawings, notes."""
    for seq, h in enumerate(_children(_child(root, "hyperlinks"), "hyperlink")):
        for c in _corners(h.attrib.get("ref", "")):
            yield "links", {"sheet": k, "seq": seq, "target": links.get(_attr(h, "id") or ""), "location": h.attrib.get("location"), "tooltip": h.attrib.get("tooltip")} | c
    filters = lambda holder, table: (("filters", {"sheet": k, "table_id": table, "column": _int(f, "colId", 0), "vals": [v.attrib.get("val", "") for v in _children(_child(f, "filters"), "filter")], "blank": _flag(_child(f, "filters"), "blank")}) for f in _children(holder, "filterColumn") if _child(f, "filters") is not None)
    yield from filters(_child(root, "autoFilter"), None)
    for part in links.values():
        if "/tables/" in part and (t := package.xml(part)) is not None:
            style = _child(t, "tableStyleInfo")
            for c in _corners(t.attrib.get("ref", "")):
                yield "tables", {"sheet": k, "id": _int(t, "id"), "name": t.attrib.get("displayName") or t.attrib.get("name"), "header_rows": _int(t, "headerRowCount", 1), "totals_rows": _int(t, "totalsRowCount", 0), "style": None if style is None else style.attrib.get("name"), "row_stripes": _flag(style, "showRowStripes"), "column_stripes": _flag(style, "showColumnStripes"), "first_column": _flag(style, "showFirstColumn"), "last_column": _flag(style, "showLastColumn"), "columns": [unescape(n.attrib.get("name", "")) for n in _children(_child(t, "tableColumns"), "tableColumn")]} | c
            yield from filters(_child(t, "autoFilter"), _int(t, "id"))
    caches = {}
    for name in package.names:
        if name.startswith("xl/slicerCaches/") and (root_s := package.xml(name)) is not None:
            held = next((x for x in root_s.iter() if _local(x.tag) == "tableSlicerCache"), None)
            caches[root_s.attrib.get("name")] = {"source": root_s.attrib.get("sourceName"), "table_id": None if held is None else _int(held, "tableId"), "column": None if held is None else _int(held, "column")}
    for part in links.values():
        root_x = package.xml(part) if any(x in part for x in ("/slicers/", "/pivotTables/", "/drawings/")) and part.endswith(".xml") else None
        if root_x is None:
            continue
        if "/slicers/" in part:
            for x in _children(root_x, "slicer"):
                cache = x.attrib.get("cache")
                yield "slicers", {"sheet": k, "name": x.attrib.get("name"), "caption": x.attrib.get("caption"), "cache": cache} | caches.get(cache, {})
        elif "/pivotTables/" in part:
            place = _child(root_x, "location")
            fields = lambda name: [_int(f, "x", 0) for f in _children(_child(root_x, name), "field")]  # noqa: E731, B023
            for c in _corners("" if place is None else place.attrib.get("ref", "")):
                yield "pivots", {"sheet": k, "name": root_x.attrib.get("name"), "cache": _int(root_x, "cacheId"), "first_data_row": _int(place, "firstDataRow"), "first_data_col": _int(place, "firstDataCol"), "row_fields": fields("rowFields"), "column_fields": fields("colFields"), "data": [f.attrib.get("name", "") for f in _children(_child(root_x, "dataFields"), "dataField")]} | c
        else:
            targets = package.relations(part)
            for seq, anchor in enumerate(x for x in root_x if _local(x.tag).endswith("Anchor")):
                kind = next((_local(x.tag) for x in anchor if _local(x.tag) in ("pic", "sp", "graphicFrame", "cxnSp", "grpSp")), "none")
                named = next((x for x in anchor.iter() if _local(x.tag) == "cNvPr"), None)
                link = next((_attr(x, "embed") or _attr(x, "id") for x in anchor.iter() if _local(x.tag) in ("blip", "chart")), None)
                at = lambda end, axis: None if (n := _child(anchor, end, axis)) is None or not (n.text or "").strip().isdigit() else int(n.text)  # noqa: E731, B023
                yield "drawings", {"sheet": k, "seq": seq, "kind": kind, "name": None if named is None else named.attrib.get("name"), "target": targets.get(link or ""), "r0": at("from", "row"), "c0": at("from", "col"), "r1": at("to", "row"), "c1": at("to", "col")}
    persons = {}
    for name in package.names:
        if name.startswith("xl/persons/") and (root_p := package.xml(name)) is not None:
            persons |= {p.attrib.get("id"): p.attrib.get("displayName") for p in root_p}
    threaded = [p for p in links.values() if "threadedComment" in p]
    seq, places = 0, set()
    for part in threaded:
        for c in package.xml(part) if package.xml(part) is not None else ():
            (place,) = list(_corners(c.attrib.get("ref", ""))) or [None]
            if place:
                places.add((place["r0"], place["c0"]))
                text = next((n.text for n in c if _local(n.tag) == "text"), "")
                yield "comments", {"sheet": k, "row": place["r0"], "col": place["c0"], "seq": seq, "author": persons.get(c.attrib.get("personId")), "text": text or "", "parent": c.attrib.get("parentId"), "id": c.attrib.get("id"), "done": _flag(c, "done")}
                seq += 1
    for part in (p for p in links.values() if "comments" in posixpath.basename(p).lower() and "threaded" not in p.lower()):
        root_c = package.xml(part)
        authors = [a.text or "" for a in _children(_child(root_c, "authors"), "author")]
        for c in _children(_child(root_c, "commentList"), "comment"):
            (place,) = list(_corners(c.attrib.get("ref", ""))) or [None]
            if place and (place["r0"], place["c0"]) not in places:  # a thread stands for the note kept beside it
                author, text = _int(c, "authorId"), _child(c, "text")
                yield "comments", {"sheet": k, "row": place["r0"], "col": place["c0"], "seq": seq, "author": authors[author] if author is not None and author < len(authors) else None, "text": _rich(text) if text is not None else "", "parent": None, "id": None, "done": False}
                seq += 1


def properties(package: Package) -> list[dict]:
    """The core properties that are given."""
    root = package.xml("docProps/core.xml")
    return [{"name": _local(n.tag), "value": n.text.strip()} for n in root if n.text and n.text.strip()] if root is not None else []


def charts(package: Package) -> Iterator[tuple[str, dict]]:
    """The series of every chart part, from their cached values."""
    for part in sorted(n for n in package.names if "/charts/chart" in n and n.endswith(".xml")):
        root = package.xml(part)
        plot = next((x for x in root.iter() if _local(x.tag) == "plotArea"), None) if root is not None else None
        number = 0
        for kind in plot if plot is not None else ():
            for ser in _children(kind, "ser"):
                cached = lambda *names: ["".join(v.text or "" for v in p if _local(v.tag) == "v") for n in names if (holder := _child(ser, n)) is not None for p in holder.iter() if _local(p.tag) == "pt"]  # noqa: E731, B023
                title = _child(ser, "tx")
                name = None if title is None else next((v.text for v in title.iter() if _local(v.tag) == "v"), None)
                yield "charts", {"part": part, "series": number, "kind": _local(kind.tag).removesuffix("Chart"), "name": name, "categories": cached("cat", "xVal"), "vals": [_number(v) for v in cached("val", "yVal")]}
                number += 1


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def facets(data: bytes) -> Iterator[tuple[str, dict]]:
    """(facet, row) of everything in a workbook, read once."""
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise Refused("no xl/workbook.xml")
    links = package.relations("xl/workbook.xml")
    cells, losses = xlsx_cells(data, package)
    yield from (("cells", c) for c in cells)
    yield from (("losses", x) for x in losses)
    yield from (("styles", s) for s in styles(package, links))
    yield from (("properties", p) for p in properties(package))
    yield from charts(package)
    for n in _children(_child(book, "definedNames"), "definedName"):
        yield "names", {"name": n.attrib.get("name"), "sheet": _int(n, "localSheetId"), "value": n.text or "", "hidden": _flag(n, "hidden")}
    dates = _flag(_child(book, "workbookPr"), "date1904")
    for k, sheet in enumerate(_children(_child(book, "sheets"), "sheet")):
        part = links.get(_attr(sheet, "id") or "", "")
        root = package.xml(part)
        if root is None:
            continue
        form, pane, found = _child(root, "sheetFormatPr"), next((p for p in root.iter() if _local(p.tag) == "pane"), None), _child(root, "autoFilter")
        frozen = pane is not None and pane.attrib.get("state") in ("frozen", "frozenSplit")
        yield "sheets", {"sheet": k, "sheet_name": sheet.attrib.get("name"), "state": sheet.attrib.get("state", "visible"), "default_width": None if form is None else _float(form, "defaultColWidth"), "default_height": None if form is None else _float(form, "defaultRowHeight"), "freeze": pane.attrib.get("topLeftCell") if frozen else None, "auto_filter": None if found is None else found.attrib.get("ref"), "date1904": dates}
        yield from _sheet_rows(k, root)
        yield from _linked(package, k, root, package.relations(part))
