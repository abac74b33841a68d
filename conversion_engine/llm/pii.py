"""Personal data in texts, plain and disguised, with spans of the original characters."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only skips starts within a run of digits, where no match can begin.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, str, int, str]  # start, kind, end, value


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain``, found from each @ in linear time."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            low = match.end()
            out.append((start, low))
        at = text.find("@", low if match else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 10 + d % 10 for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def find(text: str) -> list[Span]:
    """Spans of every kind: leftmost, not overlapping within a kind; by start, then kind."""
    found = [(s, "email", e, text[s:e]) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
                    found.append((m.start(), "ip", m.end(), m[0]))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), "card", m.end(), m[0]))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), "phone", m.end(), m[0]))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


# --- Disguises --------------------------------------------------------------

#: Letters that look like ASCII ones: Cyrillic and Greek.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһ", "ABESIJKMHOPCTYXaesijopcyxdh")) \
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABEZHIKMNOPTYXova"))
INVISIBLE = "­​‌‍⁠﻿"
#: Zero to nine in English, German, French and Spanish.
DIGIT_WORDS = {word: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, word in enumerate(words.split())}
AT, DOT, PLUS = "at|arroba|klammeraffe", "dot|punkt|punto|point", "plus|más"


def _character(c: str) -> str | None:
    """The plain form of a disguised character, None for one that stands for itself."""
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":  # full width
        return chr(ord(c) - 0xFEE0)
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if not c.isascii() and c.isdecimal():
        return str(unicodedata.decimal(c))
    return None


_ODD = re.compile(rf"[{''.join(HOMOGLYPHS)}{INVISIBLE}！-～]|(?![0-9])\d")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:{_WORD}|{DOT}|{PLUS}|[0-9]+)"
#: Units in a row; whether one is a word and they have the digits of an identifier is asked afterwards.
_SPOKEN = re.compile(rf"(?<!\w)(?:{_UNIT}(?!\w)[\s,.()-]{{0,3}})+{_UNIT}(?!\w)", re.I)
_SPOKEN_UNIT = re.compile(rf"({_WORD})|({DOT})|({PLUS})|[0-9]+", re.I)
_BRACKETED = re.compile(rf"\s?[\[({{<]\s?(?:({AT}|@)|(?:{DOT}|\.))\s?[\])}}>]\s?", re.I)
_PLAIN_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s(?:{DOT})\s(?=[A-Za-z0-9])", re.I)
#: Words alone ("john at example dot com") count before any ending of letters: of two, a country's (there are
#: no others); of more, any but a few words of everyday sentences, which are no endings either.
_COUNTRIES = """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg
ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq
gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu
lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn
pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt
tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"""
TOP = rf"(?:{'|'.join(_COUNTRIES.split())})\b|(?!(?:the|and|that|was|with|from|which|where|when|are|were|has|had|but|not)\b)[a-z]{{3,}}"
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s(?:{AT})\s(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\s(?:{DOT})\s"
                       rf"(?:[A-Za-z0-9-]+(?:\.|\s(?:{DOT})\s)){{0,4}}(?:{TOP})\b)", re.I)
_LETTER_DIGITS = re.compile(r"(?<=[0-9])[OoIl](?=[0-9OoIl -]*[0-9])")
_DOTS = re.compile(DOT, re.I)


class Rewrite:
    """A text with some stretches replaced, and the way back to its characters."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), sorted, not overlapping."""
        parts, self.at, self.source, self.copied = [], [], [], []
        self.starts, self.ends = [e[0] for e in edits], [e[1] for e in edits]
        done = size = 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for piece, low, high, same in ((text[done:start], done, start, True), (new, start, end, False)):
                if piece:
                    parts.append(piece)
                    self.at.append(size)
                    self.source.append((low, high))
                    self.copied.append(same)
                    size += len(piece)
            done = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The original stretch behind ``text[start:end]``."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low = self.source[i][0] + (start - self.at[i] if self.copied[i] else 0)
        high = self.source[j][0] + end - self.at[j] if self.copied[j] else self.source[j][1]
        return low, high

    def within(self, low: int, high: int) -> bool:
        """Does the original stretch share a character with an edit?"""
        i = bisect_right(self.ends, low)
        return i < len(self.ends) and self.starts[i] < high


def _merged(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _runs(text: str) -> list[list[re.Match]]:
    """Runs of numbers and spelled digits, dots and pluses, with at least one word and the four digits of the shortest identifier."""
    found = ([*_SPOKEN_UNIT.finditer(text, run.start(), run.end())] for run in _SPOKEN.finditer(text))
    return [units for units in found if any(u[1] or u[2] or u[3] for u in units)
            and sum(1 if u[1] else 0 if u[2] or u[3] else len(u[0]) for u in units) >= 4]


def _spoken(text: str, runs: list[list[re.Match]], joined: bool) -> list[tuple[int, int, str]]:
    """Runs of spelled digits become digits without gaps. A number next to another or to a digit word may be one of its own: that
    gap stays in runs of fewer than four digit words, unless ``joined``."""
    edits = []
    for units in runs:
        whole = joined or sum(bool(u[1]) for u in units) >= 4
        for unit, after in zip(units, [*units[1:], None]):
            new = DIGIT_WORDS[unit[1].lower()] if unit[1] else "." if unit[2] else "+" if unit[3] else unit[0]
            if new != unit[0]:
                edits.append((unit.start(), unit.end(), new))
            if after and after.start() > unit.end():
                gap = text[unit.end():after.start()]
                if whole or (unit[1] and after[1]) or any(u[2] or u[3] for u in (unit, after)):
                    new = "." if gap.strip() == "." and not (unit[2] or after[2]) else ""
                    if new != gap:
                        edits.append((unit.end(), after.start(), new))
    return edits


def _addresses(text: str, low: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]
    if _DOTS.search(low):
        edits += [(m.start(), m.end(), "@") for m in _PLAIN_AT.finditer(text)]
        edits += [(m.start(), m.end(), ".") for m in _PLAIN_DOT.finditer(text)]
    return edits


def _letters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGITS.finditer(text)]


def normalise(text: str) -> list[list[Rewrite]]:
    """The chains of rewrites that undo the disguises found in ``text``, the likeliest reading of spelled digits first; empty
    if there is none."""
    chain = []
    if not text.isascii() and _ODD.search(text):
        edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _character(m[0])) is not None]
        if edits:
            chain.append(Rewrite(text, edits))
            text = chain[-1].text
    low = text.lower()
    edits, readings = [], []
    words = re.split(r"[\s,.()-]+", low)
    if not _SPOKEN_SET.isdisjoint(words):
        runs = _runs(text)
        if runs:
            readings = [_spoken(text, runs, False), _spoken(text, runs, True)]
    if "@" in low or any(x in low for x in _HINTS):
        edits += _addresses(text, low)
    if _DIGIT.search(text):
        edits += _letters(text)
    out: list[list[tuple[int, int, str]]] = []
    for reading in [*readings, []]:
        every = _merged(reading + edits)
        if every and every not in out:
            out.append(every)
    return [[*chain, Rewrite(text, every)] for every in out] or ([chain] if chain else [])


_SPOKEN_SET = frozenset(DIGIT_WORDS) | frozenset(PLUS.split("|")) | frozenset(DOT.split("|"))
_HINTS = tuple(DOT.split("|")) + tuple(b + a for b in "[({<" for a in (*AT.split("|"), "@", "."))\
    + tuple(b + " " + a for b in "[({<" for a in (*AT.split("|"), "@", "."))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after the disguises are undone and hold such a place, in characters of ``text``.

    Of several readings of spelled digits, a later one's span counts if it overlaps none of its kind of an earlier one.
    """
    out: list[Span] = []
    for chain in normalise(text):
        new = []
        for start, kind, end, value in find(chain[-1].text):
            changed = False
            for step in reversed(chain):
                start, end = step.back(start, end)
                changed = changed or step.within(start, end)
            if changed and not any(k == kind and s <= start and end <= e for s, k, e, _ in base) \
                    and not any(k == kind and s < end and start < e for s, k, e, _ in out):
                new.append((start, kind, end, value))
        out += new
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long")
                    .add("plain", "boolean").add("value", "string"))
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()),
                        ("value", pa.string())])


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id_column``, spans): e-mail, ip, card and phone spans of every whole text.

    A span has its kind, start and end (code points of the text, end exclusive),
    ``plain`` (found in the text as it is) and ``value`` (the identifier, disguises
    undone). Spans are sorted by start, then kind. Plain spans are the leftmost
    matches of each kind; a disguised one is kept unless it lies in a plain one of its kind.

    NULL and empty texts have no spans. Rows stay as they are, repeated ones and
    NULL ids included; other columns are ignored. Texts are handled one by one.
    """
    schema = docs.select(f"`{id_column}`").schema.add("spans", SPANS)

    def rows(part: pa.RecordBatch) -> dict:
        offsets, flat = [0], []
        for text in part.column(1).to_pylist():
            if text:
                base = find(text)
                more = disguised(text, base)
                spans = [(*b, True) for b in base] + [(*m, False) for m in more]
                if more:
                    spans.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                flat += [{"kind": k, "start": s, "end": e, "plain": p, "value": v} for s, k, e, v, p in spans]
            offsets.append(len(flat))
        return {id_column: part.column(0), "spans": pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(flat, _SPAN_TYPE))}

    def run(batches):
        for part in common.slices(batches):
            out = rows(part)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select(f"`{id_column}`", f"`{text_column}`").mapInArrow(run, schema)


def written(spans: Column | str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    column = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, kind) replaced by its kind in angle brackets; overlaps count as one."""
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
