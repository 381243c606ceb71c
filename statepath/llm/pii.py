"""Personal data in texts, also where it is written in disguise.

Base spans are what the patterns below find in a text as it is. For the rest the text goes
through transducers, each of which rewrites some of it and remembers where every output
character came from: look-alike characters, spelled digits, disguised at-signs and dots.
The patterns run over what comes out, and the spans are mapped back to the characters of
the source; a rewritten piece counts as a whole. Texts that no transducer changes are
searched once.

Patterns take the leftmost match and do not overlap within a kind; a match that fails the
check of its kind is dropped, and nothing inside it is tried again.

email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
ip:    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
card:  ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits with a valid Luhn sum
phone: ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_FOUND_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# no match can begin inside a run of digits, as one from the head of the run would do as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "Α": "A", "Β": "B", "Ε": "E", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "ο": "o", "ν": "v", "ı": "i", "。": ".", "·": ".", "∙": ".", "•": ".",
}
# The digits by name in four languages.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DOT_NAMES = ("dot", "punkt", "point", "punto")

# Endings after which spelled signs are taken for an address.
ENDINGS = "com org net edu gov info biz io eu de fr es it uk ch nl".split()

_DIGITS = {name: str(d) for names in DIGIT_NAMES for d, name in enumerate(names.split())}
_DOTS = "|".join(DOT_NAMES)
_NAMES = "|".join(sorted(_DIGITS, key=len, reverse=True))
# over lower-case text: a named digit next to another item of a number
_GATE = re.compile(
    rf"(?<!\w)(?:{_NAMES})[ ,.-]{{1,3}}(?:{_NAMES}|{_DOTS}|[0-9])|(?:[0-9]|{_DOTS})[ ,.-]{{1,3}}(?:{_NAMES})(?!\w)"
)
_NAMED = re.compile(rf"(?<!\w)(?:{_NAMES})(?!\w)", re.IGNORECASE)
_ITEM = rf"(?:{_NAMES}|{_DOTS}|[0-9]+)(?!\w)"
_RUN = re.compile(
    rf"(?<!\w)(?:(?:\+|plus)[ ]?)?{_ITEM}(?:[ ,.-]{{1,3}}{_ITEM}){{3,}}", re.IGNORECASE
)
_PART = re.compile(
    rf"(?P<plus>plus[ ]?)|[ ]?(?P<dot>{_DOTS})[ ]?|(?P<digit>{_NAMES})|(?P<gap>,[ ]?|[ ,.-]{{2,3}})",
    re.IGNORECASE,
)
_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
_LABEL_DOT = rf"(?:[ ](?:{_DOTS})[ ]|[ ]?{_OPEN}(?:{_DOTS}|\.){_SHUT}[ ]?)"
_SPELLED = rf"[A-Za-z0-9-]+(?:{_LABEL_DOT}[A-Za-z0-9-]+)*{_LABEL_DOT}(?:{'|'.join(ENDINGS)})(?![A-Za-z0-9-])"
_SIGN = re.compile(
    rf"(?<=[A-Za-z0-9])(?:"
    rf"(?P<at>[ ]?{_OPEN}(?:at|@){_SHUT}[ ]?|[ ]at[ ](?={_SPELLED})|[ ]@[ ]?|@[ ])"
    rf"|(?P<dot>{_LABEL_DOT})"
    rf")(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
_MAYBE_SIGN = re.compile(rf"[@\[({{<][ ]|[ ]@|{_OPEN}(?:at|@|{_DOTS}|\.){_SHUT}|[ ](?:{_DOTS})[ ]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at-sign once: what stands before it can only begin at the head of its run."""
    before = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        before = domain.end() if domain else at + 1
        if domain:
            yield start, before
        at = text.find("@", before)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, *span) for span in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, *span) for span in _ips(text)]
        found += [(2, *span) for span in _cards(text)]
        if "+" in text:
            found += [(3, *span) for span in _phones(text)]
    return found


Edit = tuple[int, int, str]


class _Folds(dict):
    """What a character is written as: itself unless it is a variant of an ASCII one."""

    def __missing__(self, c: str) -> str:
        found = c
        if c > "\x7f":
            kind = unicodedata.category(c)
            if c in LOOKALIKES:
                found = LOOKALIKES[c]
            elif kind == "Nd":
                found = str(unicodedata.decimal(c))
            elif kind == "Cf":
                found = ""
            elif kind in ("Zs", "Pd"):
                found = " " if kind == "Zs" else "-"
            else:
                plain = unicodedata.normalize("NFKC", c)
                found = plain if len(plain) == 1 and plain <= "\x7f" else c
        self[c] = found
        return found


_FOLDS = _Folds()


def fold_lookalikes(text: str) -> Iterator[Edit]:
    """Variants and look-alikes of ASCII characters; invisible characters go."""
    if not text.isascii():
        changed = "".join(c for c in set(text) if c > "\x7f" and _FOLDS[c] != c)
        if changed:
            for m in re.finditer(f"[{re.escape(changed)}]", text):
                yield m.start(), m.end(), _FOLDS[m[0]]


def read_digits(text: str) -> Iterator[Edit]:
    """Runs of four or more digits by name or in figures, of which some are by name."""
    place = 0
    named = _NAMED.search(text) if _GATE.search(text.lower()) else None
    while named:
        # the run may begin with figures: look for it from the items before on
        run = next(
            (m for m in _RUN.finditer(text, max(place, named.start() - 64)) if m.end() > named.start()), None
        )
        if run is None:
            return
        for m in _PART.finditer(text, run.start(), run.end()):
            if m["digit"]:
                yield m.start(), m.end(), _DIGITS[m[0].lower()]
            elif m.end() > m.start():
                yield m.start(), m.end(), "+" if m["plus"] else "." if m["dot"] else " "
        place = run.end()
        named = _NAMED.search(text, place)


def read_signs(text: str) -> Iterator[Edit]:
    """At-signs and dots that are spelled, bracketed or set apart.

    A bare ``at`` counts only before names with disguised dots and one of ENDINGS.
    """
    if _MAYBE_SIGN.search(text):
        for m in _SIGN.finditer(text):
            yield m.start(), m.end(), "@" if m["at"] else "."


TRANSDUCERS = (fold_lookalikes, read_digits, read_signs)


class Rewritten:
    """A text after edits, and the way back from its characters to those of the source."""

    def __init__(self, text: str, edits: Iterable[Edit]):
        parts: list[str] = []
        # where a segment begins in the output and in the source, and whether it was rewritten
        self._out: list[int] = []
        self._from: list[tuple[int, int, bool]] = []
        at = place = 0
        for start, end, output in edits:
            for source_start, source_end, piece, new in (
                (place, start, text[place:start], False), (start, end, output, True),
            ):
                if piece:
                    self._out.append(at)
                    self._from.append((source_start, source_end, new))
                    parts.append(piece)
                    at += len(piece)
            place = end
        self._out.append(at)
        self._from.append((place, len(text), False))
        parts.append(text[place:])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        def segment(place: int) -> tuple[int, int, int, bool]:
            i = bisect_right(self._out, place) - 1
            return self._out[i], *self._from[i]

        out, first, _, new = segment(start)
        begin = first if new else first + start - out
        out, first, last, new = segment(end - 1)
        return begin, last if new else first + end - out


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in ``text`` of what the patterns find once it is rewritten."""
    steps: list[Rewritten] = []
    for transducer in TRANSDUCERS:
        edits = list(transducer(steps[-1].text if steps else text))
        if edits:
            steps.append(Rewritten(steps[-1].text if steps else text, edits))
    if not steps:
        return []
    found = []
    for kind, start, end in detect(steps[-1].text):
        for step in reversed(steps):
            start, end = step.source(start, end)
        found.append((kind, start, end))
    return found


def find(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and place.

    All base spans, and those others that do not lie inside a base span of their kind.
    """
    base = detect(text)
    found = [(*span, True) for span in base]
    by_kind: dict[int, tuple[list[int], list[int]]] = {}
    for kind, start, end in base:
        starts, ends = by_kind.setdefault(kind, ([], []))
        starts.append(start)
        ends.append(end)
    for kind, start, end in disguised(text):
        starts, ends = by_kind.get(kind, ([], []))
        i = bisect_right(starts, start) - 1
        if i < 0 or end > ends[i]:
            found.append((kind, start, end, False))
    return sorted(found)


def scan(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with found: kind, start and end (code points, end exclusive) and base.

    A null or empty text has none. Ordered by kind as listed in KINDS, then place. Rows are
    independent of each other, so repeated rows and ids do not matter. A column of ``docs``
    with the result's name is replaced; others, whatever their names, stay.
    """

    def compute(piece: pa.RecordBatch) -> dict:
        listed = [
            [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in find(t)] if t else []
            for t in piece.column(text).to_pylist()
        ]
        return {"found": pa.array(listed, _FOUND_TYPE)}

    return add_columns(docs, compute, {"found": FOUND}, text, () if keep_text else (text,))


def only_base(found: Column) -> Column:
    return F.filter(found, lambda s: s["base"])


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def as_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
