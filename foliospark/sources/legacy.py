"""Legacy binary documents: compound files, xls cells, doc paragraphs, ppt slide text.

The numbers below are fixed values of the file formats. A damaged chain or record ends what is
read of its stream; a file that cannot be read at all is refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .office import Refused

_END, _MAGIC = 0xFFFFFFFA, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class CompoundFile:
    """The streams of a compound file by path."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(_MAGIC):
            raise Refused("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise Refused("a compound file of unknown sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
        sectors = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_difat, len(data) // self.size)):
            if first_difat >= _END:
                break
            *more, first_difat = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            sectors += more
        self.fat = [x for s in sectors if s < _END for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini_fat = list(struct.unpack(f"<{(n := len(raw := self._chain(first_mini))) // 4}I", raw[: n // 4 * 4]))
        entries = self._chain(first_dir)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries) - 127, 128)]
        root = self.entries[0] if self.entries else b"\0" * 128
        self.mini_stream = self._chain(struct.unpack_from("<I", root, 116)[0])
        self.streams = dict(self._walk(struct.unpack_from("<I", root, 76)[0], "", set()))

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < _END and k not in seen and k < len(self.fat):
            seen.add(k)
            out.append(self._sector(k))
            k = self.fat[k]
        return b"".join(out)

    def _walk(self, k: int, folder: str, seen: set[int]) -> Iterator[tuple[str, bytes]]:
        if k >= len(self.entries) or k in seen:
            return
        seen.add(k)
        e = self.entries[k]
        n, kind = struct.unpack_from("<HB", e, 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        name = folder + e[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        yield from self._walk(left, folder, seen)
        if kind == 2:
            start, size = struct.unpack_from("<IQ", e, 116)
            size &= 0xFFFFFFFF if self.size == 512 else 2**63 - 1
            yield name, self._small(start, size) if size < self.cutoff else self._chain(start)[:size]
        elif kind == 1:
            yield from self._walk(child, name + "/", seen)
        yield from self._walk(right, folder, seen)

    def _small(self, k: int, size: int) -> bytes:
        out, seen = [], set()
        while k < _END and k not in seen and k < len(self.mini_fat):
            seen.add(k)
            out.append(self.mini_stream[k * self.mini : (k + 1) * self.mini])
            k = self.mini_fat[k]
        return b"".join(out)[:size]


def kind_of(data: bytes) -> str | None:
    """xls, doc, ppt or encrypted, by a compound file's streams."""
    try:
        names = {n.rsplit("/", 1)[-1] for n in CompoundFile(data).streams}
    except (Refused, struct.error):
        return None
    for stream, kind in (("EncryptedPackage", "encrypted"), ("Workbook", "xls"), ("Book", "xls"), ("WordDocument", "doc"), ("PowerPoint Document", "ppt")):
        if stream in names:
            return kind
    return None


# --- xls ------------------------------------------------------------------------------------

_BOF, _BOUND, _SST, _CONTINUE, _DATES, _FORMAT, _XF, _MERGED = 0x809, 0x85, 0xFC, 0x3C, 0x22, 0x41E, 0xE0, 0xE5
_NUMBER, _RK, _MULRK, _LABEL_SST, _LABEL, _BOOL, _FORMULA, _STRING = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06, 0x207
_XLS_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def rk_number(raw: int) -> float:
    """A packed number: thirty bits, whole or the upper part of a double, perhaps in hundredths."""
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Pieces:
    """Reads across a record's continuations, each of which starts with a flag byte amid text."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.pieces):
            part = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
            if n:
                self.k, self.at = self.k + 1, 0
        if n:
            raise Refused("a string table is cut short")
        return out

    def text(self, count: int, wide: bool) -> str:
        out = ""
        while count:
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = bool(self.take(1)[0] & 1)
            room = (len(self.pieces[self.k]) - self.at) // (1 + wide)
            n = min(count, max(room, 1))
            raw = self.take(n * (1 + wide))
            out, count = out + raw.decode("utf-16-le" if wide else "latin-1", "replace"), count - n
        return out


def _shared(pieces: list[bytes]) -> list[str]:
    reader = _Pieces(pieces)
    _, unique = struct.unpack("<II", reader.take(8))
    out = []
    for _ in range(unique):
        count, flags = struct.unpack("<HB", reader.take(3))
        runs = struct.unpack("<H", reader.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", reader.take(4))[0] if flags & 4 else 0
        out.append(reader.text(count, bool(flags & 1)))
        reader.take(4 * runs + extra)
    return out


def _long_text(raw: bytes) -> str:
    count, flags = struct.unpack_from("<HB", raw)
    return raw[3 : 3 + count * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def xls_facets(data: bytes) -> Iterator[tuple[str, dict]]:
    """(facet, row) like those of a workbook: cells, sheets, styles (number formats), merges."""
    from ..functions.numfmt import BUILT_IN

    streams = CompoundFile(data).streams
    book = streams.get("Workbook") or streams.get("Book")
    if book is None:
        raise Refused("no workbook stream")
    sheets, shared, formats, dates, index = [], [], dict(BUILT_IN), False, 0
    records = list(_records(book))
    for k, (kind, raw) in enumerate(records):
        if kind == _BOUND:
            start, state, _, count, flags = struct.unpack_from("<IBBBB", raw)
            sheets.append((start, state & 3, raw[8 : 8 + count * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")))
        elif kind == _SST:
            more = k + 1
            while more < len(records) and records[more][0] == _CONTINUE:
                more += 1
            shared = _shared([r for _, r in records[k:more]])
        elif kind == _DATES:
            dates = raw[:2] == b"\1\0"
        elif kind == _FORMAT:
            formats[struct.unpack_from("<H", raw)[0]] = _long_text(raw[2:])
        elif kind == _XF:
            code = struct.unpack_from("<HH", raw)[1]
            yield "styles", {"idx": index, "num_fmt_id": code, "num_fmt": formats.get(code, "General")}
            index += 1
    for n, (start, state, name) in enumerate(sheets):
        yield "sheets", {"sheet": n, "sheet_name": name, "state": ("visible", "hidden", "veryHidden", "hidden")[state], "date1904": dates}
        depth, waiting = 0, None
        for kind, raw in _records(book, start):
            depth += (kind == _BOF) - (kind == 0x0A)
            if depth == 0:
                break
            if depth > 1:  # a chart inside the sheet
                continue
            cell = lambda row, col, style, **value: ("cells", {"sheet": n, "sheet_name": name, "hidden": bool(state), "row": row, "col": col, "style": style, "kind": next(iter(value))} | value)  # noqa: E731, B023
            if kind == _MERGED:
                for k in range(struct.unpack_from("<H", raw)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<4H", raw, 2 + 8 * k)
                    yield "merges", {"sheet": n, "r0": r0, "c0": c0, "r1": r1, "c1": c1}
            elif kind == _STRING and waiting:
                yield cell(*waiting, str=_long_text(raw))
                waiting = None
            elif kind == _MULRK:
                row, col = struct.unpack_from("<HH", raw)
                for k in range((len(raw) - 6) // 6):
                    style, rk = struct.unpack_from("<HI", raw, 4 + 6 * k)
                    yield cell(row, col + k, style, num=rk_number(rk))
            elif kind in (_NUMBER, _RK, _LABEL_SST, _LABEL, _BOOL, _FORMULA):
                at, rest = struct.unpack_from("<HHH", raw), raw[6:]
                if kind == _NUMBER:
                    yield cell(*at, num=struct.unpack_from("<d", rest)[0])
                elif kind == _RK:
                    yield cell(*at, num=rk_number(struct.unpack_from("<I", rest)[0]))
                elif kind == _LABEL_SST:
                    place = struct.unpack_from("<I", rest)[0]
                    yield cell(*at, str=shared[place] if place < len(shared) else "")
                elif kind == _LABEL:
                    yield cell(*at, str=_long_text(rest))
                elif kind == _BOOL:
                    yield cell(*at, err=_XLS_ERRORS.get(rest[0], "#N/A")) if rest[1] else cell(*at, bool=bool(rest[0]))
                elif rest[6:8] != b"\xff\xff":
                    yield cell(*at, num=struct.unpack_from("<d", rest)[0])
                elif rest[0] == 0:
                    waiting = at
                elif rest[0] == 1:
                    yield cell(*at, bool=bool(rest[2]))
                elif rest[0] == 2:
                    yield cell(*at, err=_XLS_ERRORS.get(rest[2], "#N/A"))


# --- doc ------------------------------------------------------------------------------------


def doc_text(data: bytes) -> str:
    """The main text by the piece table, with the marks of paragraphs, cells and fields."""
    streams = CompoundFile(data).streams
    main = streams.get("WordDocument")
    if main is None or len(main) < 0x1AA:
        raise Refused("no Word text")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x0100:
        raise Refused("the document is encrypted")
    table = streams.get("1Table" if flags & 0x0200 else "0Table", b"")
    length, (place, size) = struct.unpack_from("<I", main, 0x4C)[0], struct.unpack_from("<II", main, 0x1A2)
    clx, at, out = table[place : place + size], 0, []
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise Refused("no piece table")
    n = (struct.unpack_from("<I", clx, at + 1)[0] - 4) // 12
    starts = struct.unpack_from(f"<{n + 1}I", clx, at + 5)
    for k in range(n):
        where = struct.unpack_from("<I", clx, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        count = starts[k + 1] - starts[k]
        if where & 0x40000000:
            begin = (where & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + count].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)[:length]


def doc_blocks(data: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs like those of a docx; a field shows its result, a deleted instruction goes."""
    text = doc_text(data)
    while (bare := re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x14\x15]*)\x15|\x13[^\x13\x14\x15]*\x15", r"\1", text)) != text:
        text = bare
    blocks, column = [], 0
    for part, mark in re.findall("([^\r\x07\x0c]*)([\r\x07\x0c]|$)", text):
        if not part and not mark:
            continue
        if mark == "\x07" and not part and column:  # a row's end
            column = 0
            continue
        clean = re.sub("[\x00-\x08\x0e-\x1f]", "", part.replace("\x0b", "\n").replace("\x1e", "‑").replace("\x1f", "­"))
        blocks.append({"seq": len(blocks), "kind": "cell" if mark == "\x07" else "paragraph", "text": clean, "cell": f"/0,{column}" if mark == "\x07" else None, "bold": False, "italic": False})
        column = column + 1 if mark == "\x07" else 0
    return blocks, [{"severity": "degraded", "feature": "formatting", "detail": "text only"}]


# --- ppt ------------------------------------------------------------------------------------

_LIST, _PERSIST, _SLIDE, _CHARS, _BYTES = 0x0FF0, 0x03F3, 0x03EE, 0x0FA0, 0x0FA8


def _atoms(data: bytes, path: tuple[int, ...] = (), depth: int = 0) -> Iterator[tuple[tuple[int, ...], int, int, bytes]]:
    at = 0
    while at + 8 <= len(data) and depth < 32:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + size]
        yield path, kind, head >> 4, body
        if head & 15 == 15:
            yield from _atoms(body, (*path, (kind << 16) | (head >> 4)), depth + 1)
        at += 8 + size


def ppt_paragraphs(data: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs of all slides: those of the slide list, then those in the slide's own shapes."""
    stream = CompoundFile(data).streams.get("PowerPoint Document")
    if stream is None:
        raise Refused("no slides")
    slides: dict[int, list[str]] = {}
    listed, drawn = -1, -1
    for path, kind, instance, body in _atoms(stream):
        if kind == _PERSIST and path and path[-1] == _LIST << 16:
            listed += 1
        elif kind == _SLIDE:
            drawn += 1
        elif kind in (_CHARS, _BYTES):
            text = body.decode("utf-16-le" if kind == _CHARS else "latin-1", "replace")
            if path and path[-1] == _LIST << 16 and listed >= 0:
                slides.setdefault(listed, []).append(text)
            elif any(p >> 16 == _SLIDE for p in path):
                slides.setdefault(drawn, []).append(text)
    out = []
    for slide, texts in sorted(slides.items()):
        for line in (x for t in texts for x in t.replace("\x0b", "\n").split("\r")):
            out.append({"seq": len(out), "slide": slide, "placeholder": None, "level": 0, "text": line})
    return out, [{"severity": "degraded", "feature": "formatting", "detail": "text only"}]
