"""Text functions: scripts, direction, CJK segmentation, links, headings, hyphenation, escapes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that need a face of their own, by code point ranges (Java character classes).
SCRIPT_CLASSES = {
    "hebrew": r"[\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "kana": r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]",
    "hangul": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]",
    "han": r"[\x{2E80}-\x{2FDF}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]",
}
_RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}\x{200F}\x{202B}\x{202E}\x{2067}]"
_WIDE = r"\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
#: Characters that may not begin a line, and that may not end one.
NO_BREAK_BEFORE = "、。，．！？：；」』】）〕〉》｝〞〟｣‐・…‥ー〜々ゝゞぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"
NO_BREAK_AFTER = "（｛「『【〔〈《〝｟"
#: Schemes that a link may have.
LINK_SCHEMES = ("http", "https", "mailto")


def script_count(text: Column, script: str) -> Column:
    """The number of characters of a script."""
    return F.regexp_count(text, F.lit(SCRIPT_CLASSES[script]))


def scripts(text: Column) -> Column:
    """The sorted scripts present beside Latin; Han counts as Japanese beside kana, else Korean beside hangul."""
    has = {s: text.rlike(p) for s, p in SCRIPT_CLASSES.items()}
    han = F.when(has["kana"], "jp").when(has["hangul"], "kr").when(has["han"], "sc")
    return F.array_sort(F.array_compact(F.array(*[F.when(has[s], s) for s in ("hebrew", "arabic", "devanagari", "thai")], han)))


def has_rtl(text: Column) -> Column:
    """Whether right-to-left handling is needed at all."""
    return F.coalesce(text.rlike(_RTL), F.lit(False))


def cjk_pieces(segment: Column) -> Column:
    """Each wide character apart, other runs whole."""
    return F.regexp_extract_all(segment, F.lit(f"[{_WIDE}]|[^{_WIDE}]+"), F.lit(0))


def cjk_break_between(left: Column, right: Column) -> Column:
    """Whether a line may break between the last and first characters of two pieces."""
    wide = f"^[{_WIDE}]$"
    return (left.rlike(wide) | right.rlike(wide)) & ~F.lit(NO_BREAK_AFTER).contains(left) & ~F.lit(NO_BREAK_BEFORE).contains(right)


def safe_link(href: Column) -> Column:
    """The trimmed address if its scheme is allowed, else null."""
    url = F.trim(href)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.when(scheme.isin(*LINK_SCHEMES), url)


def heading_level(outline: Column, style: Column) -> Column:
    """1 to 6 from an outline level 0 to 8, else from a style named Heading N, Title or Subtitle; null for body text."""
    n = F.regexp_extract(style, r"(?i)^heading\s*([1-9])$", 1)
    named = F.when(n != "", F.least(n.try_cast("int"), F.lit(6))).when(F.lower(style).isin("title", "subtitle"), 1)
    return F.when(outline.between(0, 8), F.least(outline + 1, F.lit(6))).otherwise(named)


def heading_by_size(size: Column, median: Column) -> Column:
    return F.when(size >= 1.5 * median, 0).when(size >= 1.25 * median, 1)


def is_blank(text: Column) -> Column:
    """Nothing but white space and zero-width characters."""
    return F.coalesce(~text.rlike(r"[^\s\x{00A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"), F.lit(True))


def within_feature(feature: Column, prefix: str) -> Column:
    return (feature == prefix) | feature.startswith(prefix + ".")


def decode_xstring(text: Column) -> Column:
    """_xHHHH_ escapes to their characters; the escape of an underscore keeps what follows literal."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)_x[0-9A-Fa-f]{4}_|(?:(?!_x[0-9A-Fa-f]{4}_).)+"), F.lit(0))
    code = lambda p: F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^_x[0-9A-Fa-f]{4}_$"), code(p)).otherwise(p)), "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def guard_block_start(text: Column) -> Column:
    """Text that would start a heading, list, quote or rule is escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"^(\s*)([#>+-]|={3,})", r"$1\\$2"), r"^(\s*\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def join_hyphenated(lines: Column) -> Column:
    """Lines as one text: a soft hyphen at a line's end goes, a hard one joins without a space."""

    def add(acc: Column, line: Column) -> Column:
        soft = F.regexp_replace(acc, r"\x{00AD}$", "")
        return F.when(acc.isNull(), line).when(acc.endswith("­"), F.concat(soft, line)).when(acc.endswith("-"), F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(lines, F.lit(None).cast("string"), add)


class Hyphenator:
    """Break points of words by weighted letter patterns (the higher weight at a place wins; odd breaks)."""

    def __init__(self, patterns: Iterable[str], exceptions: Iterable[str] = (), left: int = 2, right: int = 2):
        self.left, self.right = left, right
        self.weights: dict[str, list[int]] = {}
        for p in patterns:
            letters = re.sub(r"\d", "", p)
            found = [0] * (len(letters) + 1)
            at = 0
            for c in p:
                if c.isdigit():
                    found[at] = int(c)
                else:
                    at += 1
            self.weights[letters] = found
        self.longest = max(map(len, self.weights), default=0)
        self.exceptions = {e.replace("-", ""): [len(x) for x in e.split("-")[:-1]] for e in exceptions}

    def breaks(self, word: str) -> list[int]:
        lower = word.lower()
        if lower in self.exceptions:
            out, at = [], 0
            for n in self.exceptions[lower]:
                at += n
                out.append(at)
            return out
        framed = f".{lower}."
        level = [0] * (len(framed) + 1)
        for a in range(len(framed)):
            for b in range(a + 1, min(len(framed), a + self.longest) + 1):
                for k, w in enumerate(self.weights.get(framed[a:b], ())):
                    level[a + k] = max(level[a + k], w)
        return [k for k in range(self.left, len(word) - self.right + 1) if level[k + 1] % 2]

    def hyphenate(self, word: str, mark: str = "­") -> str:
        cuts = [0, *self.breaks(word), len(word)]
        return mark.join(word[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def udf(self, mark: str = "­"):
        """A pandas UDF over single words."""

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for words in batches:
                known = {w: self.hyphenate(w, mark) for w in words.dropna().unique()}
                yield words.map(known)

        return run
