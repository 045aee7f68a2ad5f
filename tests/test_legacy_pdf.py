import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.operators import layout
from foliospark.sources import images, legacy, office, pdf


def compound(streams):
    """A compound file of 512-byte sectors; streams under 4096 bytes go to the mini stream."""
    sectors, fat, mini, mini_fat = [], [], b"", []

    def add(data):
        first = len(sectors)
        parts = [data[k : k + 512].ljust(512, b"\0") for k in range(0, max(len(data), 1), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), 0xFFFFFFFE])
        return first

    entries = []
    for name, data in streams.items():
        if len(data) >= 4096:
            entries.append((name, add(data), len(data)))
        else:
            start, n = len(mini_fat), -(-len(data) // 64)
            mini += data.ljust(64 * n, b"\0")
            mini_fat += [*range(start + 1, start + n), 0xFFFFFFFE] if n else []
            entries.append((name, start if n else 0xFFFFFFFE, len(data)))
    root = add(mini) if mini else 0xFFFFFFFE

    def entry(name, kind, left, right, child, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    folder = entry("Root Entry", 5, none, none, 1, root, len(mini))
    for k, (name, start, size) in enumerate(entries, 1):
        folder += entry(name, 2, none, k + 1 if k < len(entries) else none, none, start, size)
    first_dir = add(folder)
    first_mini = add(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else 0xFFFFFFFE
    at = len(sectors)
    table = struct.pack(f"<{len(fat) + 1}I", *fat, 0xFFFFFFFD).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, first_dir, 0, 4096, first_mini, 1, 0xFFFFFFFE, 0)
    return (head + struct.pack("<109I", at, *[none] * 108))[:512] + b"".join(sectors) + table


def rec(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def sample_xls():
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 5, 0) + b"he"
    rest = b"\0llo" + struct.pack("<HB", 2, 1) + "éß".encode("utf-16-le")
    book = rec(0x809, b"\0\6\5\0" + b"\0" * 12) + rec(0x22, b"\0\0") + rec(0x41E, struct.pack("<H", 164) + struct.pack("<HB", 5, 0) + b"0.0#x") + rec(0xE0, struct.pack("<HH", 0, 0) + b"\0" * 16) + rec(0xE0, struct.pack("<HH", 0, 164) + b"\0" * 16)
    tail = rec(0xFC, sst) + rec(0x3C, rest) + rec(0x0A)
    bound = lambda start: rec(0x85, struct.pack("<IBBBB", start, 1, 0, 3, 0) + b"one")
    start = len(book) + len(bound(0)) + len(tail)
    sheet = rec(0x809, b"\0\6\x10\0" + b"\0" * 12)
    sheet += rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + rec(0x203, struct.pack("<HHHd", 1, 0, 1, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 1, (-7 << 2 & 0xFFFFFFFF) | 2))
    sheet += rec(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, 12345 << 2 | 3) + struct.pack("<HI", 0, struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) + struct.pack("<H", 1))
    sheet += rec(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + rec(0x205, struct.pack("<HHHBB", 3, 1, 0, 7, 1)) + rec(0x06, struct.pack("<HHH", 4, 0, 0) + struct.pack("<d", 9.0) + b"\0" * 8) + rec(0x06, struct.pack("<HHH", 4, 1, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + rec(0x207, struct.pack("<HB", 2, 0) + b"ok")
    sheet += rec(0xE5, struct.pack("<H4H", 1, 0, 1, 2, 3)) + rec(0x0A)
    return compound({"Workbook": book + bound(start) + tail + sheet, "other": b"x" * 5000})


def sample_doc():
    text, wide = b"Plain \x13 HYPERLINK x \x14link\x15 text\rcell\x07two\x07\x07", "Ünï\r"
    main = bytearray(2048)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<I", main, 0x4C, len(text) + len(wide))
    main[1024 : 1024 + len(text)] = text
    main[1536 : 1536 + 2 * len(wide)] = wide.encode("utf-16-le")
    pieces = struct.pack("<3I", 0, len(text), len(text) + len(wide)) + struct.pack("<HIH", 0, 0x40000000 | 2048, 0) + struct.pack("<HIH", 0, 1536, 0)
    clx = b"\1" + struct.pack("<H", 2) + b"zz" + b"\2" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 10, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": b"\0" * 10 + clx})


def sample_ppt():
    atom = lambda kind, body, inst=0, ver=0: struct.pack("<HHI", inst << 4 | ver, kind, len(body)) + body
    slide = lambda text: atom(0x03EE, atom(0x040C, atom(0x0FA8, text), ver=15), ver=15)
    listed = atom(0x0FF0, atom(0x03F3, b"\0" * 20) + atom(0x0FA0, "Títle\rsub".encode("utf-16-le")) + atom(0x03F3, b"\0" * 20) + atom(0x0FA8, b"Second"), ver=15)
    return compound({"PowerPoint Document": atom(0x03E8, listed, ver=15) + slide(b"drawn") + slide(b"also\x0bhere")})


def sample_pdf(extra=""):
    body = zlib.compress(b"BT /F1 12 Tf 14 TL 72 700 Td (Hello) Tj 40 0 Td [(wor) -50 (ld)] TJ T* <0102> Tj ET q 1 0 0 1 0 -100 cm /X Do Q")
    parts = [
        b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj", b"2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>/XObject<</X 7 0 R>>>>>> endobj", b"3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R>> endobj",
        b"4 0 obj <</Length %d/Filter/FlateDecode>> stream\n" % len(body) + body + b"\nendstream endobj", b"5 0 obj <</Type/Font/Subtype/Type1/Encoding<</Differences[1/Omega/uni00E9]>>/FirstChar 72/Widths[1000]/ToUnicode 6 0 R>> endobj",
        b"6 0 obj <</Length 60>> stream\n1 beginbfrange <01> <01> <03A9> endbfrange                  \nendstream endobj", b"7 0 obj <</Type/XObject/Subtype/Form/Length 50>> stream\nBT /F1 10 Tf 1 0 0 1 72 300 Tm (in form) Tj ET\nendstream endobj",
    ]
    return b"%PDF-1.4\n" + b"\n".join(parts) + extra.encode() + b"\ntrailer <</Root 1 0 R>>\n"


def test_compound_file_kinds():
    assert [legacy.kind_of(x) for x in (sample_xls(), sample_doc(), sample_ppt(), compound({"EncryptedPackage": b"x"}), b"no")] == ["xls", "doc", "ppt", "encrypted", None]
    held = legacy.CompoundFile(compound({"a": b"1" * 70, "b": b"2" * 9000, "empty": b""})).streams
    assert held == {"a": b"1" * 70, "b": b"2" * 9000, "empty": b""}


def test_xls():
    found = list(legacy.xls_facets(sample_xls()))
    cells = {(c["row"], c["col"]): c[c["kind"]] for f, c in found if f == "cells"}
    assert cells == {(0, 0): "hello", (0, 1): "éß", (1, 0): 2.5, (1, 1): -7.0, (2, 0): 123.45, (2, 1): 1.5, (3, 0): True, (3, 1): "#DIV/0!", (4, 0): 9.0, (4, 1): "ok"}
    assert [c for f, c in found if f == "merges"] == [{"sheet": 0, "r0": 0, "c0": 2, "r1": 1, "c1": 3}]
    assert [c["num_fmt"] for f, c in found if f == "styles"] == ["General", "0.0#x"]
    assert [(c["sheet_name"], c["state"]) for f, c in found if f == "sheets"] == [("one", "hidden")]


def test_doc_and_ppt():
    blocks, _ = legacy.doc_blocks(sample_doc())
    assert [(b["text"], b["cell"]) for b in blocks] == [("Plain link text", None), ("cell", "/0,0"), ("two", "/0,1"), ("Ünï", None)]
    slides, _ = legacy.ppt_paragraphs(sample_ppt())
    assert [(s["slide"], s["text"]) for s in slides] == [(0, "Títle"), (0, "sub"), (0, "drawn"), (1, "Second"), (1, "also\nhere")]


def test_pdf_text():
    runs, losses = pdf.pdf_runs(sample_pdf())
    assert [r["text"] for r in runs] == ["Hello", "wor", "ld", "Ωé", "in form"] and losses == []
    assert (runs[0]["x"], runs[0]["y"], runs[0]["font_size"]) == (72, 100, 12) and runs[1]["x"] == 112 and runs[3]["y"] == pytest.approx(114)
    assert runs[0]["end_x"] == pytest.approx(72 + 12 * (1.0 + 4 * 0.5)) and runs[4]["y"] == 600
    newer = sample_pdf("\n3 0 obj <</Type/Page/Parent 2 0 R/Contents[8 0 R]>> endobj 8 0 obj <</Length 99>> stream\nBT /F1 9 Tf (new) Tj ET\nendstream endobj")
    assert [r["text"] for r in pdf.pdf_runs(newer)[0]] == ["new"]
    with pytest.raises(office.Refused):
        pdf.pdf_runs(sample_pdf() + b"trailer <</Encrypt 9 0 R>>")


def test_pdf_object_streams():
    inner = b"1 0 2 30 <</Type/Catalog/Pages 2 0 R>>   <</Type/Pages/Kids[3 0 R]>>"
    first = inner.index(b"<<")
    packed = zlib.compress(inner)
    data = b"%PDF-1.5\n9 0 obj <</Type/ObjStm/N 2/First " + str(first).encode() + b"/Length %d/Filter/FlateDecode>> stream\n" % len(packed) + packed + b"\nendstream endobj\n3 0 obj <</Type/Page/Contents 4 0 R/Resources<</Font<</F<</Subtype/Type1>>>>>>>> endobj 4 0 obj <</Length 30>> stream\nBT /F 8 Tf (packed) Tj ET     \nendstream endobj 5 0 obj <</Type/XRef/Root 1 0 R/Length 0>> stream\n\nendstream endobj"
    assert [r["text"] for r in pdf.pdf_runs(data)[0]] == ["packed"]


def test_stream_filters():
    assert pdf.run_length(b"\x02abc\xfdz\x80rest") == b"abczzzz"
    assert pdf.ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!" and pdf.ascii85(b"z~>") == b"\0" * 4
    assert pdf.ascii_hex(b"48 65 6C6c 6F7>") == b"Hellop"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.unpredicted(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    assert pdf.unpredicted(bytes([1, 5, 1, 4, 5, 1]), {"Predictor": 15, "Columns": 2}) == bytes([5, 6, 10, 11])
    whole = zlib.compress(b"x" * 5000)
    assert pdf.inflate(whole[:-3]).startswith(b"x")
    pdf.FILTERS["Mine"] = bytes.upper
    try:
        file = pdf.File(b"%PDF-1.4 1 0 obj <</Filter/Mine/Length 3>> stream\nabc\nendstream endobj")
        assert file.bytes_of(file.get(pdf.Ref(1))) == b"ABC"
    finally:
        del pdf.FILTERS["Mine"]


def test_pictures(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 4)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 12
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 5, 0) + struct.pack("<HHII", 257, 4, 1, 6)
    emf = b"\1\0\0\0" + b"\0" * 4 + struct.pack("<4i", 0, 0, 9, 19) + b"\0" * 16 + b" EMF"
    files = {"a": png, "b": jpeg, "c": b"GIF89a" + struct.pack("<HH", 1, 2), "d": b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 8, -6), "e": tiff, "f": emf, "g": b"<svg xmlns='x'/>", "h": b"RIFF\0\0\0\0WEBP", "i": b"text", "j": None}
    found = {r.path: (r.format, r.width, r.height) for r in images.formats(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert found == {"a": ("png", 3, 4), "b": ("jpeg", 9, 7), "c": ("gif", 1, 2), "d": ("bmp", 8, 6), "e": ("tiff", 5, 6), "f": ("emf", 10, 20), "g": ("svg", None, None), "h": ("webp", None, None), "i": (None, None, None), "j": (None, None, None)}


def test_kinds_side_by_side(spark):
    """Each kind reads its own files; every other one is a loss. A registered reader takes part."""
    files = spark.createDataFrame([("x", sample_xls()), ("d", sample_doc()), ("p", sample_ppt()), ("f", sample_pdf()), ("e", compound({"EncryptedPackage": b"x"})), ("l", b"LOG a\nb")], "path string, content binary")
    assert office.facet(office.parse(files, "xls"), "xls", "cells").count() == 10
    assert office.facet(office.parse(files, "doc"), "doc", "rows").count() == 4
    assert office.facet(office.parse(files, "ppt"), "ppt", "rows").count() == 5
    runs = office.facet(office.parse(files, "pdf"), "pdf", "rows").withColumn("doc_id", F.lit(1))
    assert [r.text for r in layout.line_texts(layout.cluster_lines(runs)).orderBy("line").collect()][0].startswith("Hello")
    lost = {r.path: r.detail for r in office.facet(office.parse(files, "pdf"), "pdf", "losses").collect()}
    assert lost == {"x": "xls is no pdf", "d": "doc is no pdf", "p": "ppt is no pdf", "e": "encrypted is no pdf", "l": "unknown is no pdf"}
    office.register_reader("log", "seq int, text string", lambda data: data.startswith(b"LOG"), lambda data: ([{"seq": k, "text": t} for k, t in enumerate(data[4:].decode().split("\n"))], []))
    assert [r.text for r in office.facet(office.parse(files, "log"), "log", "rows").orderBy("seq").collect()] == ["a", "b"]


def test_plain_text_round_trip():
    text = "A (b) \\ line\n\n" + "word " * 60 + "\fsecond page é €\n" + "x" * 200 + "\n" + "\n".join(f"row {k}" for k in range(80))
    data = pdf.write_text(text)
    assert data == pdf.write_text(text)
    runs, losses = pdf.pdf_runs(data)
    assert losses == [] and max(r["page"] for r in runs) == 2 and runs[0]["text"] == "A (b) \\ line"
    lines = [r["text"] for r in runs]
    assert "second page é €" in lines and all(len(x) <= 87 for x in lines) and [x for x in lines if x.startswith("row")] == [f"row {k}" for k in range(80)]
    assert " ".join(lines[1 : lines.index("second page é €")]).split() == ["word"] * 60
    assert pdf.pdf_runs(pdf.write_text(""))[0] == []
