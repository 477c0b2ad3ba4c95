"""Personal data in plain and in disguised form, with offsets into the source text.

Plain identifiers are matched on the text itself. Disguised ones go through two transducers, each of which
keeps for every character it writes the source span it read: the first folds homoglyphs, foreign digits and
full-width forms to ASCII and drops invisible characters; the second rewrites spelled digits and at/dot
disguises. The same matchers run on what comes out, and their spans are mapped back to source characters. A mapped span is
added unless it equals or lies within a plain one.

Edge cases: a null or empty text has no spans; spans are in code points, end exclusive; overlapping spans of
different kinds are all reported and masked as one; repeated rows give repeated results; a very long text is
scanned in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import arrow_rows, small_batches

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,plain:boolean>>"

# The identifiers' patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕЗКМНОРСТУХЅІЈ", "aeopcyxijsdhlqwABE3KMHOPCTYXSIJ"))
_LOOKALIKES |= dict(zip("αοιυνρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoiuvpkABEZHIKMNOPTYX"))
# Digit words from zero to nine.
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGITS = {w: str(k) for words in _DIGIT_WORDS.values() for k, w in enumerate(words.split())}
#: Spelled digits in a row that are taken for a number.
_RUN = 4

_ODD_CASE = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
#: Next to these a shorter run of spelled digits counts as well.
_JOINTS = ("plus ", " dot ", " punto ", " punkt ", " point ")

_FOLDABLE = re.compile("[­Ͱ-ԯ؀-῿​-‏⁠-⁤︀-️﻿！-～\U0001d400-\U0001d7ff]")
_INVISIBLE = re.compile("[­​-‏⁠-⁤︀-️﻿]")
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|dot|arroba|punto|punkt|point|@|\.)\s?[\])}>]")
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_PLUS = re.compile(rf"plus (?:[0-9]|(?:{_WORD})\b)")
_DISGUISES = re.compile(rf"""(?ix)
    (?P<at>\s?[\[({{<]\s?(?:at|arroba|@)\s?[\])}}>]\s?)
  | (?P<dot>\s?[\[({{<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}}>]\s?)
  | (?P<bare_at>(?<=[a-z0-9_%+-])\x20at\x20(?=[a-z0-9-]{{1,63}}\x20(?:dot|punto|punkt|point)\x20[a-z]))
  | (?P<bare_dot>(?<=[a-z0-9-])\x20(?:dot|punto|punkt|point)\x20(?=[a-z0-9]))
  | (?P<plus>\bplus\x20(?=[0-9]|(?:{_WORD})\b))
  | (?P<digits>\b(?:{_WORD})(?:[\x20-](?:{_WORD}))*\b)
""")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around every @: the pattern's leftmost match starts with the whole run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        elif start < at:
            done = at  # the run before belongs to no match; a later run starts after this @
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of plain identifiers: leftmost, non-overlapping for each kind; by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _lower(text: str) -> str:
    """Lower case as the patterns see it: they take these four for i, i, s and k."""
    return text.translate(_ODD_CASE).lower()


@lru_cache(maxsize=1 << 16)
def _folded(char: str) -> str:
    if _INVISIBLE.match(char):
        return ""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else char


class Mapped:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewritten(self, parts: list[tuple[int, int, str]]) -> Mapped:
        """``parts``: (start, end, replacement), in order; each written character stands for the whole part."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in [*parts, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        out = Mapped("")
        out.text, out.starts, out.ends = "".join(text), starts, ends
        return out


def _disguised(text: str) -> bool:
    """False only if the second transducer changes nothing; cheap, since most texts hold nothing."""
    low = _lower(text)
    if "dot" in low or "punto" in low or "punkt" in low or "point" in low or _BRACKETED.search(low) or _PLUS.search(low):
        return True
    run, words = 0, low.replace("-", " ").split()
    if _DIGITS.keys().isdisjoint(words):
        return False
    for w in words:  # the inner words of a run stand alone; its first and last may touch quotes or brackets
        run = run + 1 if w in _DIGITS else 0
        if run == _RUN - 2:
            return True
    return False


def normalised(text: str) -> Mapped | None:
    """The text after both transducers; None if they change nothing."""
    out, changed = Mapped(text), False
    if not text.isascii() and _FOLDABLE.search(text):
        parts = [(m.start(), m.end(), new) for m in _FOLDABLE.finditer(text) if (new := _folded(m[0])) != m[0]]
        if parts:
            out, changed = out.rewritten(parts), True
    if _disguised(out.text):
        parts = []
        for m in _DISGUISES.finditer(out.text):
            kind = m.lastgroup
            if kind == "digits":
                words = re.split("[ -]", _lower(m[0]))
                before, after = _lower(out.text[max(0, m.start() - 7):m.start()]), _lower(out.text[m.end():m.end() + 7])
                if len(words) < _RUN and not before.endswith(_JOINTS) and not after.startswith(_JOINTS):
                    continue
                new = "".join(_DIGITS[w] for w in words)
            else:
                new = {"at": "@", "bare_at": "@", "dot": ".", "bare_dot": ".", "plus": "+"}[kind]
            parts.append((m.start(), m.end(), new))
        if parts:
            out, changed = out.rewritten(parts), True
    return out if changed else None


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain): plain spans and, after the transducers, disguised ones; by kind, then start."""
    if not text:
        return []
    found = [(k, a, b, True) for k, a, b in matches(text)]
    if (shown := normalised(text)) is not None:
        taken = [(a, b) for _, a, b, _ in found]
        for k, a, b in matches(shown.text):
            start, end = shown.starts[a], shown.ends[b - 1]
            if not any(s <= start and end <= e for s, e in taken):
                found.append((k, start, end, False))
    return [(KINDS[k], a, b, plain) for k, a, b, plain in sorted(found)]


def masked(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """Spans, overlapping ones as one, replaced by their kind's name."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for every row."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"id": batch["id"], "spans": [
            [dict(zip(("kind", "start", "end", "plain"), s)) for s in spans(t)] for t in batch["text"]]}

    kind = docs.schema[key].dataType.simpleString()
    return (arrow_rows(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, spans {SPANS}")
            .withColumnRenamed("id", key))


def mask(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs``, all its columns, with every span of ``text`` replaced by its kind; a null text stays null.
    ``length`` names a column of code point counts to bring up to date."""
    def run(batches):
        for batch in batches:
            column = [masked(t, spans(t)) if t else t for t in batch.column(text).to_pylist()]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
