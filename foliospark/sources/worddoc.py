"""The parts of a docx beside its paragraphs, as facets: runs, styles, numbering, notes, comments, tables, sections, bands, charts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .office import Package, Refused, _attr, _child, _local, _run_text, _runs, docx_blocks
from .workbook import charts, properties

_LOOK = "bold boolean, italic boolean, underline boolean, strike boolean, size double, font string, color string, highlight string, vert_align string"
FACETS = {
    "rows": "seq int, kind string, style string, outline_level int, num_id string, ilvl int, cell string, text string, bold boolean, italic boolean",
    "runs": f"block int, run int, text string, style string, href string, anchor string, note_kind string, note_ref string, comment string, inserted boolean, {_LOOK}",
    "styles": f"style_id string, name string, kind string, based_on string, is_default boolean, outline_level int, alignment string, indent double, space_before double, space_after double, num_id string, {_LOOK}",
    "levels": "num_id string, ilvl int, format string, template string, start int",
    "notes": "note_kind string, note_ref string, text string",
    "comments": "id string, author string, date string, text string, parent string, done boolean",
    "cells": "table int, row int, col int, span int, vmerge string, text string, header boolean",
    "bookmarks": "block int, name string",
    "sections": "seq int, width double, height double, landscape boolean, top double, right double, bottom double, left double, columns int, kind string",
    "bands": "kind string, place string, text string",
    "fields": "block int, code string, result string",
    "checks": "block int, checked boolean",
    "charts": "part string, series int, kind string, name string, categories array<string>, vals array<double>",
    "properties": "name string, value string",
    "losses": "severity string, feature string, detail string",
}


def _value(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else _attr(node, name)


def _on(node: ET.Element | None) -> bool | None:
    return None if node is None else (_value(node) or "1") not in ("0", "false", "off", "none")


def _points(text: str | None, parts: float = 20.0) -> float | None:
    try:
        return None if text is None else float(text) / parts
    except ValueError:
        return None


def look(props: ET.Element | None) -> dict:
    """Character formatting; null where it is not set."""
    get = lambda name: _child(props, name)
    fonts, colour = get("rFonts"), _value(get("color"))
    return {"bold": _on(get("b")), "italic": _on(get("i")), "underline": _on(get("u")), "strike": _on(get("strike")), "size": _points(_value(get("sz")), 2.0), "font": _value(fonts, "ascii"), "color": None if colour in (None, "auto") else colour.upper(), "highlight": _value(get("highlight")), "vert_align": _value(get("vertAlign"))}


def _text(node: ET.Element) -> str:
    """All paragraphs under a node, a line each."""
    return "\n".join("".join(map(_run_text, _runs(p))) for p in node.iter() if _local(p.tag) == "p")


def _paragraphs(node: ET.Element) -> Iterator[ET.Element]:
    """In the order that docx_blocks numbers them."""
    for c in node:
        name = _local(c.tag)
        if name == "p":
            yield c
        elif name == "tbl":
            for row in (r for r in c if _local(r.tag) == "tr"):
                for cell in (t for t in row if _local(t.tag) == "tc"):
                    yield from _paragraphs(cell)
        elif name in ("sdt", "sdtContent", "ins", "moveTo", "customXml", "smartTag"):
            yield from _paragraphs(c)


def _runs_of(block: int, p: ET.Element, links: dict[str, str]) -> Iterator[tuple[str, dict]]:
    number = 0
    field: list[str] = []  # instruction so far, of the outermost open field

    def walk(node: ET.Element, href: str | None, anchor: str | None, comments: list[str], inserted: bool) -> Iterator[tuple[str, dict]]:
        nonlocal number
        for c in node:
            name = _local(c.tag)
            if name == "r":
                note = next((n for n in c if _local(n.tag) in ("footnoteReference", "endnoteReference")), None)
                props = _child(c, "rPr")
                yield "runs", {"block": block, "run": number, "text": _run_text(c), "style": _value(_child(props, "rStyle")), "href": href, "anchor": anchor, "note_kind": None if note is None else _local(note.tag)[:-9], "note_ref": None if note is None else _attr(note, "id"), "comment": comments[-1] if comments else None, "inserted": inserted} | look(props)
                number += 1
            elif name == "hyperlink":
                yield from walk(c, links.get(_attr(c, "id") or "", href), _attr(c, "anchor"), comments, inserted)
            elif name == "commentRangeStart":
                comments.append(_attr(c, "id") or "")
            elif name == "commentRangeEnd":
                comments[:] = [x for x in comments if x != _attr(c, "id")]
            elif name == "bookmarkStart" and _attr(c, "name") and _attr(c, "name") != "_GoBack":
                yield "bookmarks", {"block": block, "name": _attr(c, "name")}
            elif name == "fldSimple":
                yield "fields", {"block": block, "code": (_attr(c, "instr") or "").strip(), "result": _text_of(c)}
                yield from walk(c, href, anchor, comments, inserted)
            elif name not in ("del", "moveFrom", "pPr"):
                yield from walk(c, href, anchor, comments, inserted or name in ("ins", "moveTo"))

    yield from walk(p, None, None, [], False)
    state, result = "", []
    for run in (r for r in p.iter() if _local(r.tag) == "r"):
        for c in run:
            name = _local(c.tag)
            if name == "fldChar":
                state = _attr(c, "fldCharType") or ""
                if state == "begin":
                    field, result = [], []
                    box = _child(c, "ffData", "checkBox")
                    if box is not None:
                        mark = _child(box, "checked") if _child(box, "checked") is not None else _child(box, "default")
                        yield "checks", {"block": block, "checked": bool(_on(mark))}
                elif state == "end" and field:
                    yield "fields", {"block": block, "code": "".join(field).strip(), "result": "".join(result)}
                    field = []
            elif name == "instrText" and state == "begin":
                field.append(c.text or "")
            elif name == "t" and state == "separate":
                result.append(c.text or "")


def _text_of(node: ET.Element) -> str:
    return "".join(map(_run_text, _runs(node)))


def _tables(body: ET.Element) -> Iterator[tuple[str, dict]]:
    for n, table in enumerate(t for t in body.iter() if _local(t.tag) == "tbl"):
        for r, row in enumerate(x for x in table if _local(x.tag) == "tr"):
            props = _child(row, "trPr")
            skip = _value(_child(props, "gridBefore"))
            col = int(skip) if skip and skip.isdigit() else 0
            for cell in (x for x in row if _local(x.tag) == "tc"):
                held = _child(cell, "tcPr")
                merge = _child(held, "vMerge")
                span = _value(_child(held, "gridSpan"))
                width = int(span) if span and span.isdigit() else 1
                own = "\n".join(_text_of(p) for p in cell if _local(p.tag) == "p")
                yield "cells", {"table": n, "row": r, "col": col, "span": width, "vmerge": None if merge is None else _value(merge) or "continue", "text": own, "header": bool(_on(_child(props, "tblHeader")))}
                col += width


def _style_rows(root: ET.Element | None) -> Iterator[tuple[str, dict]]:
    for s in (x for x in (root if root is not None else ()) if _local(x.tag) == "style"):
        para = _child(s, "pPr")
        level = _value(_child(para, "outlineLvl"))
        gap = _child(para, "spacing")
        yield "styles", {"style_id": _attr(s, "styleId"), "name": _value(_child(s, "name")), "kind": _attr(s, "type"), "based_on": _value(_child(s, "basedOn")), "is_default": _attr(s, "default") in ("1", "true"), "outline_level": int(level) if level and level.isdigit() else None, "alignment": _value(_child(para, "jc")), "indent": _points(_value(_child(para, "ind"), "left")), "space_before": _points(_value(gap, "before")), "space_after": _points(_value(gap, "after")), "num_id": _value(_child(para, "numPr", "numId"))} | look(_child(s, "rPr"))


def _levels(root: ET.Element | None) -> Iterator[tuple[str, dict]]:
    plans = {_attr(a, "abstractNumId"): a for a in (root if root is not None else ()) if _local(a.tag) == "abstractNum"}
    for num in (n for n in (root if root is not None else ()) if _local(n.tag) == "num"):
        starts = {_attr(o, "ilvl"): _value(_child(o, "startOverride")) for o in num if _local(o.tag) == "lvlOverride"}
        own = {_attr(lvl, "ilvl"): lvl for o in num if _local(o.tag) == "lvlOverride" for lvl in o if _local(lvl.tag) == "lvl"}
        plan = plans.get(_value(_child(num, "abstractNumId")))
        for lvl in (x for x in (plan if plan is not None else ()) if _local(x.tag) == "lvl"):
            k = _attr(lvl, "ilvl") or "0"
            lvl = own.get(k, lvl)
            start = starts.get(k) or _value(_child(lvl, "start")) or "1"
            yield "levels", {"num_id": _attr(num, "numId"), "ilvl": int(k), "format": _value(_child(lvl, "numFmt")) or "decimal", "template": _value(_child(lvl, "lvlText")) or "", "start": int(start) if start.lstrip("-").isdigit() else 1}


def _sections(body: ET.Element) -> Iterator[tuple[str, dict]]:
    for seq, s in enumerate(x for x in body.iter() if _local(x.tag) == "sectPr"):
        size, edge, columns = _child(s, "pgSz"), _child(s, "pgMar"), _value(_child(s, "cols"), "num")
        yield "sections", {"seq": seq, "width": _points(_value(size, "w")), "height": _points(_value(size, "h")), "landscape": _value(size, "orient") == "landscape", **{side: _points(_value(edge, side)) for side in ("top", "right", "bottom", "left")}, "columns": int(columns) if columns and columns.isdigit() else 1, "kind": _value(_child(s, "type")) or "nextPage"}


def facets(data: bytes) -> Iterator[tuple[str, dict]]:
    """(facet, row) of everything in a document, read once."""
    package = Package(data)
    root = package.xml("word/document.xml")
    if root is None:
        raise Refused("no word/document.xml")
    blocks, losses = docx_blocks(data)
    yield from (("rows", b) for b in blocks)
    yield from (("losses", x) for x in losses)
    yield from (("properties", p) for p in properties(package))
    links, found = package.relations("word/document.xml"), _child(root, "body")
    body = found if found is not None else root
    for block, p in enumerate(_paragraphs(body)):
        yield from _runs_of(block, p, links)
    yield from _tables(body)
    yield from _sections(body)
    yield from _style_rows(package.xml("word/styles.xml"))
    yield from _levels(package.xml("word/numbering.xml"))
    yield from charts(package)
    for kind in ("footnote", "endnote"):
        for note in _notes(package.xml(f"word/{kind}s.xml")):
            if _attr(note, "type") in (None, "normal"):
                yield "notes", {"note_kind": kind, "note_ref": _attr(note, "id"), "text": _text(note)}
    threads = {_attr(e, "paraId"): (_attr(e, "paraIdParent"), _attr(e, "done") == "1") for e in _notes(package.xml("word/commentsExtended.xml"))}
    ids = {}
    for c in _notes(package.xml("word/comments.xml")):
        marks = [_attr(p, "paraId") for p in c.iter() if _local(p.tag) == "p"]
        ids |= dict.fromkeys(marks, _attr(c, "id"))
        parent, done = threads.get(marks[-1] if marks else None, (None, False))
        yield "comments", {"id": _attr(c, "id"), "author": _attr(c, "author"), "date": _attr(c, "date"), "text": _text(c), "parent": ids.get(parent), "done": done}
    for s in (x for x in body.iter() if _local(x.tag) == "sectPr"):
        for ref in (r for r in s if _local(r.tag) in ("headerReference", "footerReference")):
            part = package.xml(links.get(_attr(ref, "id") or "", ""))
            if part is not None:
                yield "bands", {"kind": _local(ref.tag)[:6], "place": _attr(ref, "type") or "default", "text": _text(part)}


def _notes(root: ET.Element | None) -> list[ET.Element]:
    return [] if root is None else list(root)
