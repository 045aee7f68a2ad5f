"""PDF text: the objects of a file, its pages, and the text runs that their content shows.

Objects are found by scanning for their heads, so a damaged cross-reference table does no harm;
later definitions replace earlier ones, as an update means them to. Runs have the columns that
`operators.layout` reconstructs lines and paragraphs from: y grows downward from the page's top.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

from .office import Refused

#: Other filters by name: bytes to bytes; what is registered here wins over the built-in ones.
FILTERS: dict[str, Callable[[bytes], bytes]] = {}
MAX_STREAM = 64 << 20


class Name(str):
    """/Name"""


class Ref(int):
    """The number of an indirect object."""


class Stream:
    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


class Operator(str):
    """A content operator or keyword."""


_SPACE, _TOKEN_END = b"\0\t\n\x0c\r ", b"\0\t\n\x0c\r ()<>[]{}/%"
_NUMBER = re.compile(rb"[-+]*(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![A-Za-z])")
_HEAD = re.compile(rb"(?<!\d)(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj")
_ESCAPES = {ord(k): v for k, v in zip("nrtbf", "\n\r\t\b\f", strict=True)}


class Reader:
    """Values one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def _skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                end = re.compile(rb"[\r\n]|$").search(self.data, self.at)
                self.at = end.end() if end else len(self.data)
            else:
                return

    def value(self, depth: int = 0):
        """The next value; EOFError at the end."""
        self._skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > 64:
            raise EOFError
        c = data[at : at + 1]
        if c == b"/":
            end = at + 1
            while end < len(data) and data[end] not in _TOKEN_END:
                end += 1
            self.at = end
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), data[at + 1 : end].decode("latin-1")))
        if c == b"(":
            return self._text()
        if data.startswith(b"<<", at):
            self.at += 2
            items = self._until(b">>", depth)
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]", depth)
        if self.refs and (m := _REF.match(data, at)):
            self.at = m.end()
            return Ref(m[1])
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            text = m[0].lstrip(b"+-")
            return (float(text) if b"." in text else int(text)) * (-1 if m[0].startswith(b"-") else 1)
        end = at
        while end < len(data) and data[end] not in _TOKEN_END:
            end += 1
        self.at = max(end, at + 1)
        word = data[at : self.at].decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Operator(word))

    def _until(self, close: bytes, depth: int) -> list:
        out = []
        while True:
            self._skip()
            if self.at >= len(self.data):
                return out
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            out.append(self.value(depth + 1))

    def _text(self) -> bytes:
        out, depth, at, data = bytearray(), 1, self.at + 1, self.data
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e].encode()
                elif m := re.compile(rb"[0-7]{1,3}").match(data, at - 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        self.at = at
        return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    body = re.sub(rb"\s", b"", data).removeprefix(b"<~").split(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 33 <= c <= 117:
            continue
        group.append(c - 33)
        if len(group) == 5:
            out += (sum(d * 85 ** (4 - k) for k, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
            group = []
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(d * 85 ** (4 - k) for k, d in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable codes of 9 to 12 bits, high bit first."""
    table: list[bytes] = []
    out, held, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            now = bytes([code])
        elif code - 258 < len(table):
            now = table[code - 258]
        elif last:
            now = last + last[:1]
        else:
            break
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 258 + early).bit_length()))
    return bytes(out)


def inflate(data: bytes) -> bytes:
    """As much as can be inflated."""
    engine, out = zlib.decompressobj(), b""
    try:
        out = engine.decompress(data, MAX_STREAM)
    except zlib.error:
        for skip in (0, 2):  # damaged ends, or a missing header
            engine, out = zlib.decompressobj(-15 if skip else 15), b""
            try:
                for k in range(skip, len(data), 256):
                    out += engine.decompress(data[k : k + 256])
            except zlib.error:
                pass
            if out:
                break
    return out


def unpredicted(data: bytes, info: dict) -> bytes:
    """Undoes a predictor of whole bytes."""
    kind, colours, bits, columns = (int(info.get(k, d) or d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return data
    step, row = max(1, colours * bits // 8), (colours * bits * columns + 7) // 8
    out, before = bytearray(), bytearray(row)
    head = 1 if kind >= 10 else 0
    for at in range(0, len(data), row + head):
        mode, line = (data[at], bytearray(data[at + 1 : at + 1 + row])) if head else (1, bytearray(data[at : at + row]))
        for k in range(len(line)):
            left, up = line[k - step] if k >= step else 0, before[k]
            corner = before[k - step] if k >= step else 0
            if mode == 4:
                guess = left + up - corner
                add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[mode] if mode < 4 else 0
            line[k] = (line[k] + add) & 255
        out += line
        before = line.ljust(row, b"\0")
    return bytes(out)


class File:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Refused("no PDF")
        self.data = data
        self.places = {int(m[1]): m.end() for m in _HEAD.finditer(data)}
        self.held: dict[int, object] = {}
        trailers = [m.end() for m in re.finditer(rb"trailer", data)]
        self.trailer: dict = {}
        for at in trailers:
            found = self._safe(Reader(data, at))
            self.trailer |= found if isinstance(found, dict) else {}
        for n in list(self.places):
            x = self.get(Ref(n))
            if isinstance(x, Stream) and x.info.get("Type") == "XRef":
                self.trailer = {k: v for k, v in x.info.items() if k in ("Root", "Encrypt", "Info")} | self.trailer
            elif isinstance(x, Stream) and x.info.get("Type") == "ObjStm":
                self._unpack(x)
        if "Encrypt" in self.trailer:
            raise Refused("the document is encrypted")

    @staticmethod
    def _safe(reader: Reader):
        try:
            return reader.value()
        except (EOFError, ValueError, RecursionError):
            return None

    def get(self, x, depth: int = 0):
        """What a reference stands for."""
        if not isinstance(x, Ref):
            return x
        if int(x) not in self.held:
            self.held[int(x)] = self._object(int(x))
        found = self.held[int(x)]
        return self.get(found, depth + 1) if isinstance(found, Ref) and depth < 16 else found

    def _object(self, n: int):
        if n not in self.places:
            return None
        reader = Reader(self.data, self.places[n])
        value = self._safe(reader)
        reader._skip()
        if not isinstance(value, dict) or not self.data.startswith(b"stream", reader.at):
            return value
        start = reader.at + 6
        start += 2 if self.data.startswith(b"\r\n", start) else self.data[start : start + 1] in (b"\n", b"\r")
        size = self.get(value.get("Length")) if not isinstance(value.get("Length"), Ref) or int(value["Length"]) != n else None
        end = start + size if isinstance(size, int) and size >= 0 else -1
        if end < 0 or b"endstream" not in self.data[end : end + 20]:
            end = self.data.find(b"endstream", start)
            end = len(self.data) if end < 0 else end
        return Stream(value, self.data[start:end])

    def _unpack(self, x: Stream) -> None:
        body, first = self.bytes_of(x), self.get(x.info.get("First")) or 0
        heads = Reader(body, refs=False)
        for _ in range(int(self.get(x.info.get("N")) or 0)):
            n, at = self._safe(heads), self._safe(heads)
            if isinstance(n, int) and isinstance(at, int) and n not in self.places:
                self.held[n] = self._safe(Reader(body, first + at))

    def bytes_of(self, x) -> bytes:
        """A stream's bytes through its filters; empty past one that is not known."""
        if not isinstance(x, Stream):
            return b""
        listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        names = [str(self.get(f)) for f in listed(self.get(x.info.get("Filter") or x.info.get("F")))]
        details = [self.get(d) or {} for d in listed(self.get(x.info.get("DecodeParms") or x.info.get("DP")))]
        out = x.raw
        for k, name in enumerate(names):
            info = details[k] if k < len(details) and isinstance(details[k], dict) else {}
            if name in FILTERS:
                out = FILTERS[name](out)
            elif name in ("FlateDecode", "Fl"):
                out = unpredicted(inflate(out), info)
            elif name in ("LZWDecode", "LZW"):
                out = unpredicted(lzw(out, int(info.get("EarlyChange", 1))), info)
            elif name in ("ASCII85Decode", "A85"):
                out = ascii85(out)
            elif name in ("ASCIIHexDecode", "AHx"):
                out = ascii_hex(out)
            elif name in ("RunLengthDecode", "RL"):
                out = run_length(out)
            else:
                return b""
        return out

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""

        def walk(ref, inherited: dict, seen: frozenset) -> Iterator[dict]:
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen and isinstance(ref, Ref):
                return
            own = inherited | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "CropBox", "Rotate")}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    yield from walk(kid, own, seen | {ref} if isinstance(ref, Ref) else seen)
            else:
                yield node | own

        root = self.get(self.trailer.get("Root"))
        if isinstance(root, dict) and root.get("Pages") is not None:
            yield from walk(root["Pages"], {}, frozenset())
        else:  # no catalogue: every page object there is
            yield from (x for n in sorted({*self.places, *self.held}) if isinstance(x := self.get(Ref(n)), dict) and x.get("Type") == "Page")


_NAMED = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "slash": "/", "quotesingle": "'", "quotedbl": '"', "exclam": "!", "question": "?", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "bullet": "•"}


class Font:
    """Codes to text and widths (in thousandths of the size)."""

    def __init__(self, file: File, info: dict):
        get = lambda key: file.get(info.get(key))
        self.double = info.get("Subtype") == "Type0"
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 500.0
        if not self.double:
            coding = get("Encoding")
            page = "mac_roman" if "MacRoman" in str(coding.get("BaseEncoding") if isinstance(coding, dict) else coding) else "cp1252"
            self.text = {c: bytes([c]).decode(page, "replace") for c in range(256)}
            code = 0
            for x in (file.get(coding.get("Differences")) or []) if isinstance(coding, dict) else []:
                if isinstance(x, int):
                    code = x
                else:
                    name = str(x)
                    m = re.fullmatch(r"(?:uni|u)([0-9A-Fa-f]{4,6})", name)
                    self.text[code] = chr(int(m[1], 16)) if m else _NAMED.get(name, name if len(name) == 1 else self.text.get(code, ""))
                    code += 1
            first = get("FirstChar") or 0
            self.widths = {first + k: float(file.get(w)) for k, w in enumerate(get("Widths") or []) if isinstance(file.get(w), (int, float))}
        else:
            below = file.get((get("DescendantFonts") or [None])[0])
            if isinstance(below, dict):
                self.default = float(file.get(below.get("DW")) or 1000)
                self._wide([file.get(x) for x in file.get(below.get("W")) or []], file)
        if isinstance(get("ToUnicode"), Stream):
            self._unicode(file.bytes_of(get("ToUnicode")))

    def _wide(self, items: list, file: File) -> None:
        k = 0
        while k + 1 < len(items):
            if isinstance(items[k + 1], list):
                self.widths |= {items[k] + j: float(file.get(w) or 0) for j, w in enumerate(items[k + 1])}
                k += 2
            elif k + 2 < len(items):
                self.widths |= dict.fromkeys(range(items[k], min(items[k + 1], items[k] + 65536) + 1), float(items[k + 2]))
                k += 3
            else:
                break

    def _unicode(self, body: bytes) -> None:
        text = lambda raw: raw.decode("utf-16-be", "replace")
        for block, pairs in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", body, re.DOTALL):
            items = Reader(b"[" + pairs + b"]").value()
            if block == b"bfchar":
                self.text |= {int.from_bytes(a, "big"): text(b) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
                continue
            for a, b, c in zip(items[::3], items[1::3], items[2::3], strict=False):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(high - low + 1, 65536)):
                    self.text[low + k] = text(c[k]) if isinstance(c, list) and k < len(c) else text(c[:-2] + ((int.from_bytes(c[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")) if isinstance(c, bytes) else ""

    def codes(self, raw: bytes) -> Iterator[tuple[int, str, float]]:
        size = 2 if self.double else 1
        for k in range(0, len(raw) - size + 1, size):
            code = int.from_bytes(raw[k : k + size], "big")
            yield code, self.text.get(code, ""), self.widths.get(code, self.default)


Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


_ONE: Matrix = (1, 0, 0, 1, 0, 0)


def _shown(file: File, content: bytes, resources: dict, ctm: Matrix, depth: int = 0) -> Iterator[tuple[float, float, float, float, str]]:
    """(x, y, end, size, text) of each shown string."""
    fonts: dict[str, Font] = {}
    stack: list[Matrix] = []
    tm = line = _ONE
    font, size, char, word, scale, leading, rise = None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0
    reader, args = Reader(content, refs=False), []

    def show(raw: bytes) -> tuple[float, float, float, float, str]:
        nonlocal tm
        out = []
        at = _times((size * scale, 0, 0, size, 0, rise), _times(tm, ctm))
        start = at[4], at[5]
        for code, text, width in font.codes(raw) if font else ():
            out.append(text)
            step = (width / 1000 * size + char + (word if code == 32 and not font.double else 0)) * scale
            tm = _times((1, 0, 0, 1, step, 0), tm)
        end = _times(tm, ctm)
        return start[0], start[1], end[4], (at[2] ** 2 + at[3] ** 2) ** 0.5, "".join(out)

    while True:
        try:
            x = reader.value()
        except EOFError:
            return
        if not isinstance(x, Operator):
            args.append(x)
            args = args[-64:]
            continue
        numbers = [a for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        try:
            if x == "q":
                stack.append(ctm)
            elif x == "Q" and stack:
                ctm = stack.pop()
            elif x == "cm":
                ctm = _times(tuple(numbers[-6:]), ctm)
            elif x == "BT":
                tm = line = _ONE
            elif x == "Tf":
                name, size = str(args[-2]), float(numbers[-1])
                if name not in fonts:
                    held = file.get((file.get(resources.get("Font")) or {}).get(name))
                    fonts[name] = Font(file, held) if isinstance(held, dict) else None
                font = fonts[name]
            elif x in ("Td", "TD"):
                leading = -numbers[-1] if x == "TD" else leading
                tm = line = _times((1, 0, 0, 1, numbers[-2], numbers[-1]), line)
            elif x == "Tm":
                tm = line = tuple(numbers[-6:])
            elif x in ("T*", "'", '"'):
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                if x == '"':
                    word, char = numbers[0], numbers[1]
                if x != "T*":
                    yield show(args[-1])
            elif x == "Tj":
                yield show(args[-1])
            elif x == "TJ":
                for part in args[-1]:
                    if isinstance(part, bytes):
                        yield show(part)
                    else:
                        tm = _times((1, 0, 0, 1, -part / 1000 * size * scale, 0), tm)
            elif x in ("Tc", "Tw", "TL", "Ts", "Tz"):
                value = float(numbers[-1])
                if x == "Tc":
                    char = value
                elif x == "Tw":
                    word = value
                elif x == "TL":
                    leading = value
                elif x == "Ts":
                    rise = value
                else:
                    scale = value / 100
            elif x == "Do" and depth < 8:
                form = file.get((file.get(resources.get("XObject")) or {}).get(str(args[-1])))
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                    own = file.get(form.info.get("Matrix")) or list(_ONE)
                    yield from _shown(file, file.bytes_of(form), file.get(form.info.get("Resources")) or resources, _times(tuple(own), ctm), depth + 1)
            elif x == "BI":
                end = re.compile(rb"\sEI(?=\s|$)").search(reader.data, reader.at)
                reader.at = end.end() if end else len(reader.data)
        except (IndexError, TypeError, ValueError, AttributeError):
            pass  # an operator with wrong operands does nothing
        args = []


def pdf_runs(data: bytes) -> tuple[list[dict], list[dict]]:
    """Text runs of all pages (page, run_idx, x, y, end_x, font_size, text) and losses."""
    file, out, losses = File(data), [], []
    for n, page in enumerate(file.pages()):
        box = [float(v) if isinstance(v := file.get(x), (int, float)) else 0.0 for x in file.get(page.get("CropBox") or page.get("MediaBox")) or [0, 0, 612, 792]]
        left, top = min(box[0], box[2]), max(box[1], box[3])
        parts = file.get(page.get("Contents"))
        content = b"\n".join(file.bytes_of(file.get(p)) for p in (parts if isinstance(parts, list) else [parts]))
        resources, before = file.get(page.get("Resources")) or {}, len(out)
        for x, y, end, size, text in _shown(file, content, resources, _ONE):
            if text:
                out.append({"page": n, "run_idx": len(out) - before, "x": x - left, "y": top - y, "end_x": end - left, "font_size": size, "text": text})
        if b"Do" in content and len(out) == before:
            losses.append({"severity": "dropped", "feature": "images", "detail": f"page {n} has no text"})
    return out, losses


# --- plain text as a PDF --------------------------------------------------------------------

PAGE, MARGIN, SIZE, LEADING = (595, 842), 56, 11, 14


def write_text(text: str) -> bytes:
    """A PDF of plain text in one standard font, a paragraph's line a line, wrapped by width; what the font lacks becomes a question mark.

    A form feed starts a new page. The same text gives the same bytes.
    """
    room = int((PAGE[0] - 2 * MARGIN) / (0.5 * SIZE))
    per_page = int((PAGE[1] - 2 * MARGIN) / LEADING)
    pages: list[list[str]] = []
    for part in text.split("\f"):
        lines = [w for line in part.split("\n") for w in _wrapped(line, room)]
        pages += [lines[k : k + per_page] for k in range(0, len(lines), per_page)] or [[]]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))), len(pages)), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for k, lines in enumerate(pages):
        shown = b"".join(b"(%s) Tj T* " % re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace")) for x in lines)
        body = zlib.compress(b"BT /F 11 Tf %d TL %d %d Td %sET" % (LEADING, MARGIN, PAGE[1] - MARGIN - SIZE, shown))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (*PAGE, 5 + 2 * k))
        objects.append(b"<</Length %d/Filter/FlateDecode>>\nstream\n" % len(body) + body + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def _wrapped(line: str, room: int) -> list[str]:
    """The line in parts of at most `room` characters, cut at blanks where there are any."""
    out = []
    while len(line) > room:
        cut = line.rfind(" ", 1, room + 1)
        cut = cut if cut > 0 else room
        out.append(line[:cut])
        line = line[cut + 1 :] if line[cut : cut + 1] == " " else line[cut:]
    return [*out, line]
