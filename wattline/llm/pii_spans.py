"""Personal data with source offsets: base patterns, and a chain of transducers that undo disguises first.

Three transducers rewrite a text and remember where each piece came from: `fold` (homoglyphs, full-width and styled
characters, foreign digits, zero-width characters), `spelled` (runs of spelled digits) and `signs` (at and dot disguises).
The same detectors then read the rewritten text and their spans are mapped back to source characters. A mapped span is
added unless it lies inside a base span of its kind; base spans always stay.

Edge cases: a null text counts as empty and has no spans; every row is judged alone, so repeated rows repeat their spans;
detectors are linear in the length of the text; other columns are untouched.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import read_table, schema

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TWICE = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_TWICE[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Looks left and right of each @, so long runs without one cost nothing."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


DETECTORS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: find(text) for kind, find in DETECTORS.items()}


class Aligned:
    """A rewritten text whose pieces know their source: pieces copied as they are map character by character, rewritten ones as a whole."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int, bool]] | None = None):
        self.text = text
        #: (start, end, source start, source end, copied)
        self.pieces = pieces if pieces is not None else [(0, len(text), 0, len(text), True)]
        self.starts = [p[0] for p in self.pieces]

    def piece(self, at: int) -> tuple[int, int, int, int, bool]:
        return self.pieces[max(0, bisect_right(self.starts, at) - 1)]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of text[start:end], not empty."""
        a, b = self.piece(start), self.piece(end - 1)
        return (a[2] + start - a[0] if a[4] else a[2]), (b[2] + end - b[0] if b[4] else b[3])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """edits: spans of this text, in order and apart, with what replaces them."""
        out, pieces, size, at = [], [], 0, 0

        def put(piece: str, start: int, end: int, copied: bool) -> None:
            nonlocal size
            if not piece:
                return
            if not copied:
                pieces.append((size, size + len(piece), *self.source(start, end), False))
            else:
                k = max(0, bisect_right(self.starts, start) - 1)
                while start < end:
                    p = self.pieces[k]
                    stop = min(end, p[1])
                    src = (p[2] + start - p[0], p[2] + stop - p[0]) if p[4] else (p[2], p[3])
                    pieces.append((size + start - (end - len(piece)), size + stop - (end - len(piece)), *src, p[4]))
                    start, k = stop, k + 1
            out.append(piece)
            size += len(piece)

        for start, end, new in edits:
            put(self.text[at:start], at, start, True)
            put(new, start, end, False)
            at = end
        put(self.text[at:], at, len(self.text), True)
        return Aligned("".join(out), pieces)


# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
ZERO_WIDTH = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—―−"


def _fold_table() -> dict[str, str]:
    """From Unicode's own compatibility forms and digit values, and the lists above."""
    table = {}
    for block in ((0xA0, 0xBF), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F), (0x2000, 0x200A), (0x2024, 0x2024), (0x202F, 0x202F), (0x2070, 0x209C), (0x2100, 0x214F), (0x2460, 0x24EA), (0x3000, 0x3000), (0xFE50, 0xFE6B), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)):
        for code in range(block[0], block[1] + 1):
            char = chr(code)
            digit = unicodedata.digit(char, None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
            if len(plain) == 1 and plain.isascii():
                table[char] = plain
    return table | HOMOGLYPHS | dict.fromkeys(ZERO_WIDTH, "") | dict.fromkeys(DASHES, "-")


FOLD = _fold_table()
_FOLD_KEYS = frozenset(FOLD)
_FOLDED = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")

# Spelled digits in English, French, German and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOTS = ("dot", "point", "punkt", "punto")
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A run of at least so many spelled digits is read as digits.
MIN_SPELLED = 3
_RUN = re.compile(rf"(?:\bplus[\s-]+|\+\s*)?(?<!\w)(?:{_WORD}|[0-9]+)(?:[\s,-]+(?:{_WORD}|[0-9]+|{'|'.join(DOTS)})(?!\w))+", re.IGNORECASE)
_TOKEN = re.compile(r"\w+|\+")
_WORDS = re.compile(r"\w+")
_OPEN, _CLOSE = r"(?<!\s)\s*+[\[({<]\s*+", r"\s*+[\])}>]\s*+"
_DOT = "|".join(DOTS)
#: A label of a host, at most as long as names may be; so no position is read more often than that.
_LABEL = rf"[A-Za-z0-9]{{1,63}}+(?:-{{1,63}}+(?!(?:{_DOT})[\s_-])[A-Za-z0-9]{{1,63}}+){{0,63}}+"
_PLAIN = rf"(?:at|arobase|arroba|@)[\s_-]++(?={_LABEL}(?:[\s_-]++(?:{_DOT})[\s_-]++|\.)[A-Za-z0-9-])"
_SIGNS = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@|arobase|arroba){_CLOSE})|(?P<dot>{_OPEN}(?:\.|{_DOT}){_CLOSE})|(?P<plain>(?<=[A-Za-z0-9])[\s_-]++{_PLAIN})"
    rf"|(?P<spot>(?<=[A-Za-z0-9])[\s_-]++(?:{_DOT})[\s_-]++(?=[A-Za-z0-9]))|(?P<gap>(?<=[A-Za-z0-9])[^\S\n]++\.[^\S\n]++(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
#: A host after a plain `at` must end in one of these, unless its dots are spelled.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev cloud online shop site blog tv me eu us uk ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg dk se no fi is ee lv lt ru ua tr il in cn jp kr "
    "tw hk sg br mx ar cl za example test invalid local".split()
)
#: Words that stand before `at` in prose; a local part is none of them.
PROSE = frozenset(
    "a about active added after aim aimed all also am and appear appeared appears are around arrive arrived arrives as attend available back based be began begin best better been being browse but buy buying bought call can "
    "check checked click close closed come comes cost costs down eat else end ended ends even everyone expert find fine first for found free glance go goes going good great he held her here hers him his "
    "host hosted hosts hint i in information is it its join joined just land landed last later laugh learn list listed live lived lives located look looked looking looks many me meet meeting meets met more most much "
    "my new no not now of off officer on one only open opened opens or order ordered our out over page pages point pointed post posted price priced prices published put reach read ready register registered "
    "released run running runs sale sat save saw see seen sees sell selling sells served serving she shop shopping shout sign sit sits smile so sold stand stands stare start started starts stay stayed "
    "stays still stood stop stopped store study studied that the them then there they things this time to today together too trade traded try up us valued via visit visited wait waited was we well went "
    "were what when where who with work worked working works write you your".split()
)
_HOST_AFTER = re.compile(rf"{_LABEL}(?:\.{_LABEL}){{0,10}}+")
_LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_BRACKETED = re.compile(r"[\[({<]\s*+(?:at|@|\.|dot|p[ou]|arr?ob)", re.IGNORECASE)
_SPACED_AT = re.compile(rf"[\s_-]{_PLAIN}", re.IGNORECASE)
_SPACED_DOT = re.compile(rf"[\s_-](?:{_DOT})[\s_-]", re.IGNORECASE)


def fold(a: Aligned) -> Aligned:
    if a.text.isascii() or _FOLD_KEYS.isdisjoint(a.text):
        return a
    edits = [(m.start(), m.end(), FOLD[m.group()]) for m in _FOLDED.finditer(a.text)]
    return a.rewrite(edits) if edits else a


def means_address(text: str, sign: re.Match) -> bool:
    """Whether a plain `at` joins an address, and no place to a verb: what stands before it is no word of prose, and the host ends in
    a top-level domain or has its dots spelled too."""
    word = sign.group().strip(" \t\r\n\f\v_-").casefold()
    if word in ("arobase", "arroba"):
        return True
    host = _HOST_AFTER.match(text, sign.end())
    if not host:
        return False
    if word == "at":
        local = _LOCAL_BEFORE.search(text[max(0, sign.start() - 64) : sign.start()])
        if local and local.group().strip("._%+-").casefold() in PROSE:
            return False
    _, dot, last = host.group().rpartition(".")
    return last.casefold() in TOP_LEVEL if dot else True


def may_be_spelled(text: str) -> bool:
    """Whether MIN_SPELLED spelled digits have only numerals and dot words between them, as every run of _RUN that counts."""
    words = _WORDS.findall(text.casefold())
    at = [k for k, word in enumerate(words) if word in DIGITS]
    near = 1
    for k, after in pairwise(at):
        near = near + 1 if all(word.isdecimal() or word in DOTS for word in words[k + 1 : after]) else 1
        if near >= MIN_SPELLED:
            return True
    return False


def may_have_signs(text: str) -> bool:
    """Whether _SIGNS finds more than dot words far from any at sign."""
    return bool(_BRACKETED.search(text) or _SPACED_AT.search(text) or ("@" in text and _SPACED_DOT.search(text)))


def spelled(a: Aligned) -> Aligned:
    if not may_be_spelled(a.text):
        return a
    edits = []
    for m in _RUN.finditer(a.text):
        tokens = [t.lower() for t in _TOKEN.findall(m.group())]
        if sum(t in DIGITS for t in tokens) >= MIN_SPELLED:
            new = "".join(DIGITS.get(t, "+" if t in ("plus", "+") else "." if t in DOTS else t) for t in tokens)
            edits.append((m.start(), m.end(), new))
    return a.rewrite(edits) if edits else a


def signs(a: Aligned) -> Aligned:
    low = a.text
    if not may_have_signs(low):
        return a
    found = [m for m in _SIGNS.finditer(low) if not m["plain"] or means_address(low, m)]
    edits = []
    for k, m in enumerate(found):
        # a dot between spaces counts only after a disguised at sign on its line
        if m["gap"] and not any((f["at"] or f["plain"]) and "\n" not in low[f.end() : m.start()] for f in found[max(0, k - 6) : k] if m.start() - f.end() < 80):
            continue
        # a dot word counts only near an at sign: on the same line, at most a few words on
        if m["spot"] and not any(f["at"] or f["plain"] for f in found[max(0, k - 6) : k] if m.start() - f.end() < 80) and "@" not in low[max(0, m.start() - 80) : m.start()]:
            if not any(f["at"] or f["plain"] for f in found[k + 1 : k + 5] if f.start() - m.end() < 40):
                continue
        edits.append((m.start(), m.end(), "@" if m["at"] or m["plain"] else "."))
    return a.rewrite(edits) if edits else a


TRANSDUCERS = (fold, spelled, signs)


def find_spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans by kind, as code points of the source."""
    text = text or ""
    base, aligned = detect(text), Aligned(text)
    for transducer in TRANSDUCERS:
        aligned = transducer(aligned)
    added = {kind: [] for kind in KINDS}
    if aligned.text != text:
        for kind, spans in detect(aligned.text).items():
            have = base[kind]
            firsts = [s for s, _ in have]
            for start, end in spans:
                s, e = aligned.source(start, end)
                k = bisect_right(firsts, s) - 1
                if not (k >= 0 and have[k][1] >= e):
                    added[kind].append((s, e))
    return base, added


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Each span, or chain of overlapping spans, becomes the name of its first kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, kind) for kind, found in spans.items() for s, e in found):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


FIGURES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


@F.pandas_udf(schema(FIGURES))
def pii_figures(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, added = find_spans(text)
        every = {kind: base[kind] + added[kind] for kind in KINDS}
        rows.append((*(len(base[kind]) for kind in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, added.values()))))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FIGURES.split(", ")])


@F.pandas_udf(schema("x string").fields[0].dataType)
def pii_redacted(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        base, added = find_spans(text)
        out.append(redact(text, {kind: base[kind] + added[kind] for kind in KINDS}))
    return pd.Series(out, dtype=object)


def find_pii(text: str | Column = "text") -> Column:
    return pii_figures(F.col(text) if isinstance(text, str) else text)


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    out = docs.withColumn(text, pii_redacted(F.col(text)).cast(docs.schema[text].dataType))
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars and n_chars in docs.columns else out


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", find_pii().alias("p")).select("doc_id", "p.*")
