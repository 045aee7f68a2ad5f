"""Office documents as tables: docx blocks and runs, xlsx cells, pptx paragraphs, with a loss report.

Files are read with Spark's binaryFile source, so any store that Spark reads works, and are
parsed one file a row in mapInPandas. Every lossy or refused step is a row of `losses`.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import heading_level
from ..plans.syntax import format_cell, parse_cell

#: Limits of a package: bytes of a part, of all parts, number of entries.
MAX_PART, MAX_TOTAL, MAX_ENTRIES = 128 << 20, 512 << 20, 65536
_ZIP, _CFB, _PDF = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"%PDF-"
_MAIN = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}
#: Text inside these is not part of the document as it stands.
_SKIPPED = {"del", "moveFrom", "instrText", "delText"}


class Refused(ValueError):
    """The bytes are no readable document of the kind asked for."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _child(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if node is None:
            return None
        node = next((c for c in node if _local(c.tag) == name), None)
    return node


def _parts(node: ET.Element | None, name: str) -> list[ET.Element]:
    """The children of a child, none if it is missing."""
    found = _child(node, name)
    return [] if found is None else list(found)


class Package:
    """A zip package within its limits."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise Refused(str(error)) from error
        infos = self.zip.infolist()
        if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_TOTAL or any(i.file_size > MAX_PART for i in infos):
            raise Refused("the package exceeds the limits")
        self.names = {i.filename.lstrip("/"): i for i in infos}

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        raw = self.zip.read(self.names[name])
        if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
            raise Refused(f"{name} declares entities")
        return ET.fromstring(raw)

    def relations(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in root if root is not None else ():
            target = r.attrib.get("Target", "")
            if r.attrib.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
            out[r.attrib.get("Id", "")] = target
        return out


def sniff(data: bytes) -> str | None:
    """docx, xlsx, pptx, cfb (a legacy or encrypted document), pdf, or null."""
    if data.startswith(_CFB):
        return "cfb"
    if _PDF in data[:1024]:
        return "pdf"
    if not data.startswith(_ZIP):
        return None
    try:
        names = Package(data).names
    except Refused:
        return None
    return next((kind for prefix, kind in _MAIN.items() if any(n.startswith(prefix) for n in names)), None)


def _run_text(run: ET.Element) -> str:
    out = []
    for c in run:
        name = _local(c.tag)
        if name == "t":
            out.append(c.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("‑")
        elif name == "softHyphen":
            out.append("­")
    return "".join(out)


def _runs(node: ET.Element) -> Iterator[ET.Element]:
    """The runs of a paragraph, through links, fields and insertions but not deletions."""
    for c in node:
        name = _local(c.tag)
        if name == "r":
            yield c
        elif name not in _SKIPPED and name != "pPr":
            yield from _runs(c)


def docx_blocks(data: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs in order (table cells included, with their place) and losses."""
    package, blocks, losses = Package(data), [], []
    root = package.xml("word/document.xml")
    if root is None:
        raise Refused("no word/document.xml")

    def paragraph(p: ET.Element, cell: str | None) -> None:
        props = _child(p, "pPr")
        style, num = _child(props, "pStyle"), _child(props, "numPr")
        outline = _child(props, "outlineLvl")
        value = lambda n: None if n is None else _attr(n, "val")
        runs = list(_runs(p))
        level, ilvl = value(outline), value(_child(num, "ilvl")) if num is not None else None
        flag = lambda r, k: (n := _child(r, "rPr", k)) is not None and (value(n) or "1") not in ("0", "false")
        blocks.append({"seq": len(blocks), "kind": "cell" if cell else "paragraph", "style": value(style), "outline_level": None if level is None else int(level), "num_id": value(_child(num, "numId")) if num is not None else None, "ilvl": int(ilvl or 0) if num is not None else None, "cell": cell, "text": "".join(map(_run_text, runs)), "bold": bool(runs) and all(flag(r, "b") for r in runs), "italic": bool(runs) and all(flag(r, "i") for r in runs)})

    def walk(node: ET.Element, cell: str | None, depth: int) -> None:
        if depth > 32:
            losses.append({"severity": "dropped", "feature": "tables.nested", "detail": "nested deeper than 32"})
            return
        for c in node:
            name = _local(c.tag)
            if name == "p":
                paragraph(c, cell)
                for drawing in c.iter():
                    if _local(drawing.tag) in ("drawing", "pict", "object"):
                        losses.append({"severity": "dropped", "feature": "images", "detail": _local(drawing.tag)})
            elif name == "tbl":
                rows = [r for r in c if _local(r.tag) == "tr"]
                for i, row in enumerate(rows):
                    for j, tc in enumerate(t for t in row if _local(t.tag) == "tc"):
                        walk(tc, f"{cell or ''}/{i},{j}", depth + 1)
            elif name in ("sdt", "sdtContent", "ins", "moveTo", "customXml", "smartTag"):
                walk(c, cell, depth + 1)

    body = _child(root, "body")
    walk(body if body is not None else root, None, 0)
    return blocks, losses


_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)


def _rich(node: ET.Element) -> str:
    """A string item's text without its phonetic runs."""
    return "".join(unescape(t.text or "") for c in node if _local(c.tag) in ("t", "r") for t in ([c] if _local(c.tag) == "t" else [x for x in c if _local(x.tag) == "t"]))


def xlsx_cells(data: bytes, package: Package | None = None) -> tuple[list[dict], list[dict]]:
    """Decoded cells of all sheets (sheet, row, col, kind, num, str, bool, err, formula, style) and losses."""
    package, cells, losses = package or Package(data), [], []
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise Refused("no xl/workbook.xml")
    links = package.relations("xl/workbook.xml")
    shared_root = package.xml(next((p for p in links.values() if p.endswith("sharedStrings.xml")), "xl/sharedStrings.xml"))
    shared = [_rich(si) for si in shared_root if _local(si.tag) == "si"] if shared_root is not None else []
    for k, sheet in enumerate(_parts(book, "sheets")):
        root = package.xml(links.get(_attr(sheet, "id") or "", ""))
        if root is None:
            losses.append({"severity": "dropped", "feature": "sheet", "detail": sheet.attrib.get("name", "")})
            continue
        row = -1
        for r in _parts(root, "sheetData"):
            row, col = int(r.attrib["r"]) - 1 if r.attrib.get("r", "").isdigit() else row + 1, -1
            for c in r:
                try:
                    _, col, *_ = parse_cell(c.attrib["r"])
                except (KeyError, ValueError):
                    col += 1
                kind, v = c.attrib.get("t", "n"), _child(c, "v")
                raw = v.text or "" if v is not None else None
                out = {"sheet": k, "sheet_name": sheet.attrib.get("name"), "hidden": sheet.attrib.get("state", "visible") != "visible", "row": row, "col": col, "kind": "blank", "num": None, "str": None, "bool": None, "err": None, "formula": f.text if (f := _child(c, "f")) is not None else None, "style": int(c.attrib.get("s", 0))}
                if kind == "inlineStr":
                    inline = _child(c, "is")
                    out |= {"kind": "str", "str": _rich(inline) if inline is not None else ""}
                elif raw is None:
                    continue
                elif kind == "s":
                    out |= {"kind": "str", "str": shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""}
                elif kind == "b":
                    out |= {"kind": "bool", "bool": raw.strip() in ("1", "TRUE", "true")}
                elif kind == "e":
                    out |= {"kind": "err", "err": raw}
                elif kind in ("str", "d"):
                    out |= {"kind": "str", "str": unescape(raw)}
                else:
                    try:
                        out |= {"kind": "num", "num": float(raw)}
                    except ValueError:
                        losses.append({"severity": "degraded", "feature": "cell.value", "detail": format_cell(row, col)})
                        continue
                cells.append(out)
    return cells, losses


def xlsx_merges(data: bytes) -> list[dict]:
    package = Package(data)
    book, links = package.xml("xl/workbook.xml"), package.relations("xl/workbook.xml")
    out = []
    for k, sheet in enumerate(_parts(book, "sheets")):
        root = package.xml(links.get(_attr(sheet, "id") or "", ""))
        for m in _parts(root, "mergeCells"):
            a, _, b = m.attrib.get("ref", "").partition(":")
            (r0, c0, *_), (r1, c1, *_) = parse_cell(a), parse_cell(b or a)
            out.append({"sheet": k, "r0": r0, "c0": c0, "r1": r1, "c1": c1})
    return out


def pptx_paragraphs(data: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs of all slides in presentation order, and losses."""
    package, out, losses = Package(data), [], []
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise Refused("no ppt/presentation.xml")
    links = package.relations("ppt/presentation.xml")
    for n, slide in enumerate(_parts(deck, "sldIdLst")):
        part = links.get(next((v for k, v in slide.attrib.items() if k.endswith("}id")), ""), "")
        root = package.xml(part)
        if root is None:
            losses.append({"severity": "dropped", "feature": "slide", "detail": str(n)})
            continue
        for shape in (s for s in root.iter() if _local(s.tag) in ("sp", "graphicFrame", "pic")):
            if _local(shape.tag) == "pic":
                losses.append({"severity": "dropped", "feature": "images", "detail": f"slide {n}"})
            holder = _child(shape, "nvSpPr", "nvPr", "ph")
            for p in (p for p in shape.iter() if _local(p.tag) == "p"):
                props = _child(p, "pPr")
                text = "".join((t.text or "") if _local(t.tag) == "t" else "\n" for t in p.iter() if _local(t.tag) in ("t", "br"))
                out.append({"seq": len(out), "slide": n, "placeholder": None if holder is None else holder.attrib.get("type", "body"), "level": int((props.attrib if props is not None else {}).get("lvl", 0)), "text": text})
    return out, losses


_SCHEMAS = {
    "docx": {"rows": "seq int, kind string, style string, outline_level int, num_id string, ilvl int, cell string, text string, bold boolean, italic boolean"},
    "pptx": {"rows": "seq int, slide int, placeholder string, level int, text string"},
    "pdf": {"rows": "page int, run_idx int, x double, y double, end_x double, font_size double, text string"},
}
_SCHEMAS |= {"doc": _SCHEMAS["docx"], "ppt": _SCHEMAS["pptx"]}
#: Kind to what reads it, (rows, losses) from bytes; register_reader adds others.
_READERS: dict[str, Callable[[bytes], tuple[list[dict], list[dict]]]] = {"docx": docx_blocks, "pptx": pptx_paragraphs}
_SNIFFERS: list[Callable[[bytes], str | None]] = []


def register_reader(kind: str, schema: str, sniffs: Callable[[bytes], bool], reads: Callable[[bytes], tuple[list[dict], list[dict]]]) -> None:
    """Adds a document kind: how its bytes are known, the schema of its rows, and what reads (rows, losses).

    The functions travel to the executors with the plan, so they may be local ones.
    """
    _SCHEMAS[kind] = {"rows": schema}
    _READERS[kind] = reads
    _SNIFFERS.append(lambda data: kind if sniffs(data) else None)


def _reader(kind: str) -> Callable[[bytes], tuple[list[dict], list[dict]]]:
    if kind in ("doc", "ppt"):
        from . import legacy

        return {"doc": legacy.doc_blocks, "ppt": legacy.ppt_paragraphs}[kind]
    if kind == "pdf":
        from .pdf import pdf_runs

        return pdf_runs
    return _READERS[kind]
_LOSSES = "severity string, feature string, detail string"


def _facets(kind: str, content: bytes, reads: Callable | None, sniffers: list) -> Iterator[tuple[str, dict]]:
    """(facet, row) of a document; what cannot be read is a loss."""
    found = next((k for s in sniffers if (k := s(content))), None) or sniff(content)
    try:
        if found == "cfb":
            from .legacy import kind_of

            found = kind_of(content) or found
        if found != kind:
            raise Refused(f"{found or 'unknown'} is no {kind}")
        if kind == "xlsx":
            from .workbook import facets

            yield from list(facets(content))
        elif kind == "docx":
            from .worddoc import facets

            yield from list(facets(content))
        elif kind == "xls":
            from .legacy import xls_facets

            yield from list(xls_facets(content))
        else:
            rows, losses = reads(content)
            yield from (("rows", r) for r in rows)
            yield from (("losses", x) for x in losses)
    except (Refused, ET.ParseError, KeyError, ValueError, IndexError, struct.error, zipfile.BadZipFile) as error:
        yield "losses", {"severity": "dropped", "feature": "document", "detail": str(error)[:200]}


def parse(files: DataFrame, kind: str) -> DataFrame:
    """(path, facet, row): everything in files(path, content) of one kind, each opened once; row is JSON.

    kind: docx, xlsx, pptx, doc, xls, ppt, pdf, or one that register_reader added.
    """
    reads, sniffers = None if kind in ("xlsx", "xls", "docx") else _reader(kind), list(_SNIFFERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = [(name, facet, json.dumps(row, ensure_ascii=False)) for facet, row in _facets(kind, bytes(content), reads, sniffers)]
                for start in range(0, len(found), 65536):
                    yield pd.DataFrame(found[start : start + 65536], columns=["path", "facet", "row"])

    return files.select("path", "content").mapInPandas(run, "path string, facet string, row string")


def facet(parsed: DataFrame, kind: str, name: str) -> DataFrame:
    """One facet's rows with their path, from parse()."""
    schemas = {"losses": _LOSSES} | _SCHEMAS.get(kind, {})
    if kind in ("xlsx", "xls"):
        from .workbook import FACETS

        schemas = FACETS
    elif kind == "docx":
        from .worddoc import FACETS

        schemas = FACETS
    found = parsed.where(F.col("facet") == name).select("path", F.from_json("row", schemas[name]).alias("r"))
    return found.select("path", "r.*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path or glob, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read(spark: SparkSession, path: str, kind: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, losses) of the documents of one kind under a path or glob; others are losses.

    With `store`, a path for a Parquet table, the files are parsed once into it; without, both
    frames are lazy over the files, and each parses what it is asked for.
    """
    parsed = parse(files(spark, path), kind)
    if store is not None:
        parsed.write.parquet(store)
        parsed = spark.read.parquet(store)
    return facet(parsed, kind, "cells" if kind in ("xlsx", "xls") else "rows"), facet(parsed, kind, "losses")


def outline(blocks: DataFrame) -> DataFrame:
    """The headings of docx blocks with their level."""
    level = heading_level(F.col("outline_level"), F.col("style"))
    return blocks.withColumn("level", level).where("level is not null").select("path", "seq", "level", "text")


# --- writers --------------------------------------------------------------------------------


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _zip(parts: dict[str, str]) -> bytes:
    """The same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _frame(main: str, kind: str, extra: str = "") -> dict[str, str]:
    return {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/>{extra}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_DOC}/officeDocument" Target="{main}"/></Relationships>',
    }


def _styles_xml(formats: list[str]) -> str:
    """A style table with one cell format a number format code, after the default one."""
    codes = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{_escape(c)}"/>' for k, c in enumerate(formats))
    xfs = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" applyNumberFormat="1"/>' for n in (0, *range(164, 164 + len(formats))))
    return f'<styleSheet xmlns="{_SHEET}"><numFmts count="{len(formats)}">{codes}</numFmts><fonts><font><sz val="11"/><name val="Calibri"/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders><cellXfs>{xfs}</cellXfs></styleSheet>'


def write_xlsx(cells: list[dict]) -> bytes:
    """A workbook from cells with sheet, sheet_name, row, col, kind, the kind's value and, if given, num_fmt, a format code."""
    sheets: dict[int, list[dict]] = {}
    for c in cells:
        sheets.setdefault(c["sheet"], []).append(c)
    formats = sorted({c["num_fmt"] for c in cells if c.get("num_fmt")})
    style_of = {code: f' s="{k + 1}"' for k, code in enumerate(formats)}
    extra = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets)))
    if formats:
        extra += '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
    parts = _frame("xl/workbook.xml", "spreadsheetml.sheet", extra)
    names = []
    for k, (_, own) in enumerate(sorted(sheets.items())):
        names.append(own[0].get("sheet_name") or f"Sheet{k + 1}")
        rows: dict[int, list[dict]] = {}
        for c in sorted(own, key=lambda c: (c["row"], c["col"])):
            rows.setdefault(c["row"], []).append(c)
        body = ""
        for r, row in rows.items():
            body += f'<row r="{r + 1}">'
            for c in row:
                at, kind = format_cell(r, c["col"]) + '"' + style_of.get(c.get("num_fmt"), ""), c["kind"]
                if kind == "num":
                    body += f'<c r="{at}><v>{c["num"]!r}</v></c>'
                elif kind == "bool":
                    body += f'<c r="{at} t="b"><v>{int(c["bool"])}</v></c>'
                elif kind == "err":
                    body += f'<c r="{at} t="e"><v>{_escape(c["err"])}</v></c>'
                else:
                    body += f'<c r="{at} t="inlineStr"><is><t xml:space="preserve">{_escape(c["str"] or "")}</t></is></c>'
            body += "</row>"
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = f'<worksheet xmlns="{_SHEET}"><sheetData>{body}</sheetData></worksheet>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name="{_escape(n)}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(names)) + "</sheets></workbook>"
    links = [("worksheet", f"worksheets/sheet{k + 1}.xml") for k in range(len(names))]
    if formats:
        links.append(("styles", "styles.xml"))
        parts["xl/styles.xml"] = _styles_xml(formats)
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="r{k + 1}" Type="{_DOC}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(links)) + "</Relationships>"
    return _zip(parts)


def write_docx(blocks: list[dict]) -> bytes:
    """A document from paragraphs with text and, if given, style."""
    body = ""
    for b in sorted(blocks, key=lambda b: b["seq"]):
        style = f'<w:pPr><w:pStyle w:val="{_escape(b["style"])}"/></w:pPr>' if b.get("style") else ""
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{_escape(t)}</w:t>' for t in (b["text"] or "").split("\n"))
        body += f"<w:p>{style}<w:r>{lines}</w:r></w:p>"
    return _zip(_frame("word/document.xml", "wordprocessingml.document") | {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'})


def to_files(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, content): one written document per value of `by`, ready for any binary sink. kind: xlsx, docx or pdf (plain text)."""

    def write_pdf(blocks: list[dict]) -> bytes:
        from .pdf import write_text

        return write_text("\n".join(b["text"] or "" for b in sorted(blocks, key=lambda b: b["seq"])))

    write = {"xlsx": write_xlsx, "docx": write_docx, "pdf": write_pdf}[kind]
    key = rows.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        clean = pdf.astype(object).where(pdf.notna(), None)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [write(clean.to_dict("records"))]})

    return rows.groupBy(by).applyInPandas(one, f"{by} {key}, content binary")
