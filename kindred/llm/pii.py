"""Personal data, plain and disguised: offset-preserving deobfuscation.

Identifiers are found twice: in the text as it stands, and in what three transducers make of it.
A transducer rewrites pieces of its input and keeps, for every character it puts out, the span of source
characters that it stands for, so that a span found in the last output maps back to the source:

1. `unify`: lookalikes of ASCII characters (compatibility forms, digits of other scripts, Cyrillic and Greek letters, dashes,
   spaces) become these; characters without width vanish.
2. `spell`: of three or more spelled digits in a row (English, German, French, Spanish; also mixed with digits, spelled
   dots and a leading spelled plus) each becomes a digit.
3. `point`: bracketed or spelled at and dot become @ and . where they stand in an address: bracketed ones anywhere, spelled
   dots between digits or in a domain, a spelled at only before a domain, and, if nothing else in the address is disguised,
   only after a name that is no plain word ("look at example.com" is left alone).

Each row is handled in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow

KINDS = ("email", "ip", "card", "phone")
# What each kind matches. Quantifiers that can never give back a character are possessive.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Letters of other scripts that look like a Latin one, and marks that no compatibility form covers.
_ALIKE = dict(zip("асԁеһіјӏорԛѕухѵԝАВСЕНІЈКМОРЅТУХαονικρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ", "acdehijlopqsyxvwABCEHIJKMOPSTYXaovikpuxABEZHIKMNOPTYXiag", strict=True)) \
    | dict.fromkeys("‐‑‒–—―−", "-") | dict.fromkeys("。｡", ".")
_WIDTHLESS = "­​‌‍‎‏⁠﻿"
_NOTHING = re.compile("[" + _WIDTHLESS + "]+")
# Digits spelled in four languages, words for a dot, an at and a plus.
_DIGITS = {word: str(n) for n, words in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
    "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for word in words.split()}
_DOT, _AT = "dot|punkt|point|punto", "at|ät|arobase|arroba"
_WORD = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -]{{1,2}})?(?:{_WORD})(?![^\W_])(?:[ ,-]{{1,2}}(?:{_WORD}|{_DOT}|[0-9]+)(?![^\W_]))+")
_MEMBER = re.compile(rf"(?P<digit>{_WORD})|(?P<dot>{_DOT})|(?P<plus>plus)|(?P<number>[0-9]+)|(?P<gap>[ ,-]+)")
_HARD = re.compile(rf"[\[({{<]\s?({_AT}|@|{_DOT}|\.)\s?[\])}}>]\s{{0,2}}")
_HARD_DOTS = frozenset([*_DOT.split("|"), "."])
_SOFT_AT = re.compile(rf"(?: {{1,2}}(?:{_AT}) {{1,2}}|(?<=[a-z0-9])@)(?=[a-z0-9])")
_SOFT_DOMAIN = re.compile(rf"[a-z0-9-]++(?:(?: {{1,2}}(?:{_DOT}) {{1,2}}|\.)[a-z0-9-]++)++")
_SOFT_DOT = re.compile(rf" {{1,2}}(?:{_DOT}) {{1,2}}")
_DOT_BEFORE = re.compile(rf" {{1,2}}(?:{_DOT}) {{1,2}}$")
_DIGIT_DOT = re.compile(rf"(?<=[0-9]) {{1,2}}(?:{_DOT}) {{1,2}}(?=[0-9])")


@lru_cache(maxsize=1)
def _lookalikes() -> tuple[dict, frozenset]:
    """Character by character: the ASCII one it stands for; and all characters to change."""
    wanted = _LOCAL | set(" @()[]{}<>")
    table = dict(_ALIKE)
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain not in wanted:
            digit = unicodedata.decimal(char, None)
            plain = None if digit is None else str(digit)
        if plain:
            table.setdefault(char, plain)
    return str.maketrans(table), frozenset([*table, *_WIDTHLESS])


class Mapped:
    """A text and, per character, the span of source characters it stands for (None: itself)."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, characters) in ascending order; every new character stands for the whole span."""
        if not edits:
            return
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])

    def disguised(self, start: int, end: int) -> bool:
        """Whether a character there stands for several source characters."""
        return self.start is not None and bool((self.end[start:end] - self.start[start:end] > 1).any())

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.start is None else (int(self.start[start]), int(self.end[end - 1]))

    def lower(self) -> str:
        """The text in lower case, character by character."""
        low = self.text.lower()
        return low if len(low) == len(self.text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)


def unify(m: Mapped) -> bool:
    """First transducer; whether it changed anything."""
    table, changed = _lookalikes()
    if m.text.isascii() or changed.isdisjoint(m.text):
        return False
    m.text = m.text.translate(table)
    m.rewrite([(*g.span(), "") for g in _NOTHING.finditer(m.text)])
    return True


def spell(m: Mapped) -> bool:
    """Second transducer; whether it changed anything."""
    edits = []
    for sequence in _SPELLED.finditer(m.lower()):
        members = [(g.lastgroup, *g.span(), g.group()) for g in _MEMBER.finditer(sequence.string, *sequence.span())]
        if sum(kind == "digit" for kind, *_ in members) < 3:
            continue
        while members[-1][0] in ("dot", "gap"):
            members.pop()
        for k, (kind, a, b, word) in enumerate(members):
            if kind == "digit":
                edits.append((a, b, _DIGITS[word]))
            elif kind == "plus":
                edits.append((a, b, "+"))
            elif kind == "dot":
                edits.append((a, b, "."))
            elif kind == "gap":
                # A gap stays, as one space or hyphen, only beside a number written in digits.
                beside = {members[k - 1][0], members[k + 1][0]}
                edits.append((a, b, "" if "dot" in beside or "number" not in beside else "-" if word == "-" else " "))
    m.rewrite(edits)
    return bool(edits)


def _run_start(low: str, end: int, least: int = 0) -> int:
    """Where the run of local-part characters that ends before `end` starts."""
    while end > least and low[end - 1] in _LOCAL:
        end -= 1
    return end


def point(m: Mapped) -> bool:
    """Third transducer; whether it changed anything."""
    low = m.lower()
    hard = []
    for mark in _HARD.finditer(low):
        begin = mark.start()
        while begin > (hard[-1][1] if hard else 0) and mark.start() - begin < 2 and low[begin - 1].isspace():
            begin -= 1
        hard.append((begin, mark.end(), "." if mark[1] in _HARD_DOTS else "@"))
    m.rewrite(hard)
    low = m.lower() if hard else low
    edits, done = {}, 0
    for at in _SOFT_AT.finditer(low):
        domain = _SOFT_DOMAIN.match(low, at.end())
        if at.start() < done or not domain:
            continue
        begin, spelled = _run_start(low, at.start(), done), at.group() != "@"
        dots = [g.span() for g in _SOFT_DOT.finditer(low, *domain.span())]
        hidden = bool(dots) or m.disguised(at.start(), domain.end())
        if begin == at.start() or spelled and not hidden and low[begin:at.start()].isalpha():
            continue
        # Spelled dots before the at belong to the name if the rest is disguised.
        while hidden and (dot := _DOT_BEFORE.search(low, max(done, begin - 12), begin)):
            further = _run_start(low, dot.start(), done)
            if further == dot.start():
                break
            dots.append(dot.span())
            begin = further
        edits |= dict.fromkeys(dots, ".") | ({at.span(): "@"} if spelled else {})
        done = domain.end()
    for dot in _DIGIT_DOT.finditer(low):
        edits.setdefault(dot.span(), ".")
    m.rewrite([(*span, new) for span, new in sorted(edits.items())])
    return bool(hard or edits)


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double, its digits summed."""
    double = "0246813579"
    return sum(int(c) for c in digits[::-2]) % 10 == -sum(int(double[int(c)]) for c in digits[-2::-2]) % 10


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all plain identifiers of a text: leftmost non-overlapping matches per kind that pass their check."""
    found = []
    at, least = text.find("@"), 0
    while at >= 0:
        # A match starts with the run of local characters before an @ and ends with the longest domain after it.
        begin = _run_start(text, at, least)
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            least = domain.end()
            found.append(("email", begin, least))
        at = text.find("@", at + 1)
    for g in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in g.group().split(".")):
            found.append(("ip", *g.span()))
    for g in _CARD.finditer(text):
        if 14 <= g.end() - g.start() <= 37:
            digits = g.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *g.span()))
    if "+" in text:
        for g in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in g.group()) <= 15:
                found.append(("phone", *g.span()))
    return found


def spans(text: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, base, value) of all identifiers, by start, then kind; base ones stand in the text as they are.

    value is the identifier without disguise. A disguised find inside a plain one of its kind is that one.
    """
    found = [(a, b, kind, True, text[a:b]) for kind, a, b in identifiers(text)]
    m = Mapped(text)
    if any([unify(m), spell(m), point(m)]):
        plain = {kind: [f[:2] for f in found if f[2] == kind] for kind in KINDS}
        for kind, a, b in identifiers(m.text):
            start, end = m.source(a, b)
            if not any(x <= start and end <= y for x, y in plain[kind]):
                found.append((start, end, kind, False, m.text[a:b]))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("value", pa.string())]))


def _find(batches):
    for batch in batches:
        for part in arrow.pieces(batch, "text"):
            found = [[dict(zip(("start", "end", "kind", "base", "value"), s, strict=True)) for s in spans(text or "")]
                     for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "found"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, found (start, end, kind, base, value; see `spans`) of every row of `docs` (doc_id, text).

    start and end count characters (code points) of the whole text, end exclusive. Null and empty texts have no spans. Repeated
    rows and null ids give a row each; a very long text is searched in time in proportion to its length; other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(_find, "doc_id long, found array<struct<start:long,end:long,kind:string,base:boolean,value:string>>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (of base spans), base_sha256, spans of rows of `personal_data`: spans joined as kind:start:end."""
    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.expr(f"size(filter(found, s -> s.base and s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
