"""Personal data: base patterns, and disguised identifiers by offset-preserving transducers."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_columns, spans_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def detect(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of kind, kind, end) of the base identifiers, each kind leftmost
    and non-overlapping. Linear in the text: an e-mail's local part is looked for
    back from each @, and runs of digits are matched whole."""
    found = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, "email", m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, "ip", m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, "phone", m.end()))
    return found


# Letters of other scripts that look like ASCII ones.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρ", "aeopcyxijshdqwABEKMHOPCTYXIJSABEZHIKMNOPTYXovap", strict=True))
# Dots, at signs, dashes and spaces that stand for the ASCII ones.
SIGNS = dict.fromkeys("․。｡．﹒", ".") | dict.fromkeys("＠﹫", "@") | dict.fromkeys("‐‑‒–—−－﹣", "-") | dict.fromkeys("   　", " ")
# Characters of no width.
UNSEEN = dict.fromkeys("­​‌‍⁠﻿", "")
GLYPH = re.compile("[" + "".join([*LOOKALIKE, *SIGNS, *UNSEEN]) + "٠-٩۰-۹०-९⁰-⁹₀-₉①-⑨！-～\U0001d400-\U0001d7ff]")
GLYPH_DIGITS = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl|](?:[ ().-]{0,2}[0-9OoIl|]){6,}(?![A-Za-z0-9])")
GLYPH_NEAR = re.compile(r"[0-9][ ().-]{0,2}[OoIl|]|[OoIl|][ ().-]{0,2}[0-9]")
SPELLED = {
    word: str(d)
    for language in ("zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun")
    for d, word in enumerate(language.split())
} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_BETWEEN = r"[ \t]*[,;/-]?[ \t\n]*"
_DIGITS = rf"(?:{_DIGIT_WORD}|[0-9]+)"
#: Four or more digit words, or numbers among them, in a row.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus{_BETWEEN})?{_DIGITS}(?:{_BETWEEN}(?:(?:dot|point|punto|punkt){_BETWEEN})?{_DIGITS})" + r"{3,}(?!\w)", re.I)
SPELLED_PART = re.compile(rf"plus|dot|point|punto|punkt|{_DIGIT_WORD}|[0-9]+", re.I)
SPELLED_WORD = re.compile(rf"(?:{_DIGIT_WORD}){_BETWEEN}(?:(?:dot|point|punto|punkt){_BETWEEN})?{_DIGITS}", re.I)
#: Digit words that a run with numbers has at least.
LEAST_SPELLED = 3
_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba|arobase)\s*[\])}>]\s*|\s*(?:&#64;|&#x40;|&commat;|%40)\s*|\s+@\s+|\s+@|@\s+)"
_AT_WORD = r"\s+(?:at|arroba|arobase)\s+"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punto|point|punkt|\.)\s*[\])}>]\s*|\s*(?:&#46;|&#x2e;|&period;)\s*|\s+(?:dot|punto|punkt)\s+)"
AT = re.compile(f"{_AT}|{_AT_WORD}", re.I)
AT_WORD = re.compile(_AT_WORD, re.I)
DOT = re.compile(_DOT, re.I)
DOT_WORDS = frozenset(("dot", "punto", "punkt"))
#: A first look at a text: whatever AT and NUMBER_DOT need, in forms that are quick to look for.
SIGN = re.compile(r"&#64;|&#x40;|&commat;|%40|&#46;|&#x2e;|&period;|arroba|arobase|[\[({<]\s*(?:at|@|dot|punto|point|punkt|\.)\s*[\])}>]|@\s|\s@|\s(?:dot|punto|punkt)\s|\sat\s+[A-Za-z0-9-]+\.", re.I)
BEFORE_AT = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]+)*\Z", re.I)
AFTER_AT = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
PLAIN_ADDRESS = re.compile(r"(?<![\w.])[A-Za-z0-9_%+-]*[0-9._%+-][A-Za-z0-9_.%+-]*\Z")
#: Last labels of addresses that only words disguise ("anna at firm dot com"); marked ones may end in any.
ENDINGS = frozenset("com org net edu gov info biz io co me dev app ai uk us eu de fr es it nl ch at be ca au in br mx ar pl ru cn jp kr se no dk fi cz pt gr ie nz za tr int mil xyz online cloud example test".split())
#: Characters back from an at sign that are looked at first; doubled while the address goes on.
REACH = 128


#: White space as re has it.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _linear(pattern: re.Pattern) -> str:
    """pattern for Arrow's automaton, which finds what re finds if case is ignored: there, i has more forms and white space is ASCII."""
    return pattern.pattern.replace("[A-Za-z0-9-]", "[A-Za-z0-9\u0131\u0130-]").replace("i", "[i\u0131\u0130]").replace(r"\s", SPACES)


LINEAR_SIGN, LINEAR_SPELLED_WORD = _linear(SIGN), _linear(SPELLED_WORD)


def first_looks(texts: list[str]) -> list[tuple[bool, bool]]:
    """For each text, whether SIGN and whether SPELLED_WORD is found; all texts at once, by an automaton without backtracking."""
    column = pa.array(texts, type=pa.large_string())
    return list(zip(*(pc.match_substring_regex(column, x, ignore_case=True).to_pylist() for x in (LINEAR_SIGN, LINEAR_SPELLED_WORD)), strict=True))


def glyph(ch: str) -> str:
    """The ASCII character that ch looks like; ch itself if none."""
    for table in (LOOKALIKE, SIGNS, UNSEEN):
        if ch in table:
            return table[ch]
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


class Tape:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1
        self.edited = np.zeros(len(text), dtype=bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace non-overlapping ranges; a replacement's characters stand for its whole range."""
        texts, starts, ends, edited, low = [], [], [], [], 0
        for s, e, new in sorted(edits):
            if s < low:
                continue
            texts += [self.text[low:s], new]
            starts += [self.starts[low:s], np.repeat(self.starts[s], len(new))]
            ends += [self.ends[low:s], np.repeat(self.ends[e - 1], len(new))]
            edited += [self.edited[low:s], np.ones(len(new), dtype=bool)]
            low = e
        texts.append(self.text[low:])
        starts.append(self.starts[low:])
        ends.append(self.ends[low:])
        edited.append(self.edited[low:])
        gone = [(int(self.starts[s]), int(self.ends[e - 1])) for s, e, new in edits if not new]
        self.text, self.starts, self.ends, self.edited = "".join(texts), np.concatenate(starts), np.concatenate(ends), np.concatenate(edited)
        if gone and len(self.text):  # a character beside one that was left out counts as edited
            at = np.searchsorted(self.starts, [g[0] for g in gone])
            self.edited[np.clip(at, 0, len(self.text) - 1)] = True
            self.edited[np.clip(at - 1, 0, len(self.text) - 1)] = True


def unglyph(tape: Tape) -> None:
    """Homoglyphs, signs, digits of other scripts and unseen characters to ASCII; then
    letters O, o, I, l inside numbers to digits."""
    edits = [(m.start(), m.end(), new) for m in GLYPH.finditer(tape.text) if (new := glyph(m[0])) != m[0]]
    if edits:
        tape.rewrite(edits)
    if not GLYPH_NEAR.search(tape.text):
        return
    edits = []
    for m in GLYPH_DIGITS.finditer(tape.text):
        letters = sum(c in "OoIl|" for c in m[0])
        if letters and 2 * letters <= sum(c.isdigit() for c in m[0]):
            edits += [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(m[0]) if c in "OoIl|"]
    if edits:
        tape.rewrite(edits)


def _before(text: str, at: int) -> tuple[int, int] | None:
    """Where the local part that ends at at begins and ends."""
    reach = REACH
    while True:
        base = max(0, at - reach)
        m = BEFORE_AT.search(text, base, at)
        if not m or m.start() > base or not base:
            return m and m.span()
        reach *= 2


def unspell_signs(tape: Tape) -> None:
    """at and dot disguises to signs, where a local part, an at and a domain come together.

    A domain's last label has two letters or more. Where nothing but plain words make
    the disguise it is one of ENDINGS; after a spaced at sign it is not capitalised."""
    text, edits = tape.text, [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(tape.text)]
    for m in AT.finditer(text):
        left = _before(text, m.start())
        right = AFTER_AT.match(text, m.end())
        if not left or not right:
            continue
        dots = list(DOT.finditer(text, right.start(), right.end()))
        labels = DOT.sub(".", right[0]).split(".")
        words = bool(AT_WORD.fullmatch(m[0]))
        marked = not words and m[0].strip() != "@" or any(d[0].strip(" \t\n\r\f\v").lower() not in DOT_WORDS for d in dots)
        spaced = not words and m[0].strip() == "@"

        def ends(label: str, marked: bool = marked, spaced: bool = spaced) -> bool:
            letters = len(label) >= 2 and label.isascii() and label.isalpha()
            return letters and (marked or label.lower() in ENDINGS or spaced and (label.islower() or label.isupper()))

        while len(labels) > 1 and not ends(labels[-1]):
            labels.pop()
        if len(labels) < 2:
            continue
        dots = dots[: len(labels) - 1]
        if words and not dots and not PLAIN_ADDRESS.search(text, left[0], left[1]):
            continue  # "meet at example.com" is no address
        edits += [(m.start(), m.end(), "@")] + [(d.start(), d.end(), ".") for d in dots]
        edits += [(d.start(), d.end(), ".") for d in DOT.finditer(text, *left)]
    if edits:
        tape.rewrite(edits)


def unspell_digits(tape: Tape) -> list[tuple[int, int]]:
    """Runs of spelled digits, and numbers among them, to digits. Returns where runs of 10 to 15 digits, most of them spelled, stand that no plus begins."""
    edits, bare = [], []
    for m in SPELLED_RUN.finditer(tape.text):
        parts = list(SPELLED_PART.finditer(tape.text, m.start(), m.end()))
        signs = ["+" if p[0].lower() == "plus" else p[0] if p[0][0] in "0123456789" else SPELLED.get(p[0].lower(), ".") for p in parts]
        spelled = sum(p[0].lower() in SPELLED for p in parts)
        if spelled < min(LEAST_SPELLED, len(signs)):
            continue
        digits = "".join(signs)
        if 10 <= len(digits) <= 15 and 2 * spelled >= len(digits) and digits.isdigit() and not re.search(r"[+0-9][ -]?\Z", tape.text[max(0, m.start() - 2) : m.start()]):
            bare.append((int(tape.starts[m.start()]), int(tape.ends[m.end() - 1])))
        for p, sign, after in zip(parts, signs, [*parts[1:], None], strict=True):
            edits.append((p.start(), p.end() if after is None else after.start(), sign))
    if edits:
        tape.rewrite(edits)
    return bare


def disguised(text: str, look: bool = True, seen: tuple[bool, bool] | None = None) -> list[tuple[int, int, str, int]]:
    """Spans, in text, of identifiers that show only when its disguises are undone.

    With look, transducers that a first look (seen, if it was taken) shows to have
    nothing to do are left out; that changes no result."""
    odd = not look or bool(GLYPH.search(text)) or bool(GLYPH_NEAR.search(text))
    signs, digits = (True, True) if not look else seen or first_looks([text])[0]
    if not (odd or signs or digits):
        return []
    tape, bare = Tape(text), []
    if odd:
        unglyph(tape)
    if signs or tape.text != text and SIGN.search(tape.text):
        unspell_signs(tape)
    if digits or tape.text != text and SPELLED_WORD.search(tape.text):
        bare = unspell_digits(tape)
    found = [(s, 3, "phone", e) for s, e in bare]
    if tape.edited.any():
        found += [(int(tape.starts[s]), rank, kind, int(tape.ends[e - 1])) for s, rank, kind, e in detect(tape.text) if tape.edited[s:e].any()]
    return found


def find(text: str, seen: tuple[bool, bool] | None = None) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and disguised ones that lie in none of their kind."""
    base = detect(text)
    more = [x for x in dict.fromkeys(disguised(text, seen=seen)) if not any(k == x[1] and s <= x[0] and x[3] <= e for s, k, _, e in base)]
    return base, base + more


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Offsets are code points of the source text, end exclusive. Map-side only. Null
    text is empty: no spans, the digest of nothing. Null doc_ids, repeated rows and
    empty tables pass through; other columns are ignored. A whole text is scanned
    in time linear in its length; disguises are undone only in texts that have some."""

    def factory():
        def step(cols):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            texts = [text or "" for text in cols["text"]]
            for text, seen in zip(texts, first_looks(texts), strict=True):
                base, spans = find(text, seen)
                for rank, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(x[1] == rank for x in base))
                out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out["spans"].append(spans_text(spans))
                out["n_added"].append(len(spans) - len(base))
            return {"doc_id": cols["doc_id"]} | out

        return step

    return map_columns(docs.select("doc_id", "text"), factory, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
