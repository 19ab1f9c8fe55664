"""Citation markers in contexts (TXT10): found once as spans, resolved, and written over.

A context's markers are its author-year units (within brackets, or narrative) and its
numbered brackets. The spans that the cited work is known to stand behind become [CITED],
the others [REF]; a marker that is the only one is the cited work's in any case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of citation markers.
YEAR = r"(?:19|20)\d\d[a-z]?"
NAME = r"[A-Z][\w'’\-]+(?:\s+(?:van|von|de|der|den|du|la|le|da|dos|di)\s+[A-Z][\w'’\-]+)*"
AUTHORS = rf"{NAME}(?:\s+et\s+al\.?|\s+(?:and|&)\s+{NAME}|(?:,\s*{NAME})+,?\s+(?:and|&)\s+{NAME})?"
UNIT = rf"(?:e\.g\.,?\s*|see\s+|cf\.\s*)?({AUTHORS})\s*,?\s*\(?({YEAR}(?:\s*,\s*{YEAR})*)\)?"
NARRATIVE = rf"\b({AUTHORS})\s+\(({YEAR}(?:\s*,\s*{YEAR})*)\)"
GROUP = rf"[\(\[]([^()\[\]]*?{YEAR}[^()\[\]]*?)[\)\]]"
NUMBERED = r"\[\s*\d+(?:\s*[-–,]\s*\d+)*\s*\]"
NUMBERED_V2 = NUMBERED + r"|\(\s*\d{1,3}(?:\s*[-–,]\s*\d{1,3})*\s*\)"
#: Fixed value: the widest range of numbers that a marker may span.
WIDEST = 50
REF, CITED = "[REF]", "[CITED]"

_WITHIN, _NARRATIVE, _BRACKETS = map(re.compile, (UNIT, NARRATIVE, GROUP))
_NUMBERS = {1: re.compile(NUMBERED), 2: re.compile(NUMBERED_V2)}


class Marker(NamedTuple):
    """A citation marker's place in a text, and what it names: authors and years, or numbers of a list."""

    start: int
    end: int
    authors: str = ""
    years: str = ""
    numbers: frozenset[int] = frozenset()


def numbers_of(bracket: str) -> frozenset[int]:
    """Numbers that a numbered bracket names, ranges filled; none if a part is no number or range, or a range is too wide."""
    bounds = [re.split(r"\s*[-–]\s*", part.strip()) for part in bracket[1:-1].split(",")]
    if any(len(b) > 2 or not all(map(str.isdigit, b)) for b in bounds):
        return frozenset()
    ranges = [range(int(b[0]), int(b[-1]) + 1) for b in bounds]
    return frozenset().union(*ranges) if all(0 < len(r) <= WIDEST + 1 for r in ranges) else frozenset()


def markers(text: str, rule: int) -> list[Marker]:
    """All markers of a text in order, none within another; rule 2 knows numbers in round brackets, too."""
    found: list[Marker] = []

    def add(more: Iterable[Marker]) -> None:
        taken = [(m.start, m.end) for m in found]
        found.extend(m for m in more if all(m.end <= a or b <= m.start for a, b in taken))

    add(Marker(m.start(), m.end(), m[1], m[2]) for g in _BRACKETS.finditer(text) for m in _WITHIN.finditer(text, g.start(1), g.end(1)))
    add(Marker(m.start(), m.end(), m[1], m[2]) for m in _NARRATIVE.finditer(text))
    add(Marker(m.start(), m.end(), numbers=numbers_of(m[0])) for m in _NUMBERS[rule].finditer(text))
    return sorted(found)


def written_over(text: str, found: list[Marker], cited: Callable[[Marker], bool]) -> tuple[str, bool]:
    """The text with its markers masked, and whether the cited work has one of them."""
    names = [CITED if cited(m) else REF for m in found]
    cuts = [0, *(x for m in found for x in (m.start, m.end)), len(text)]
    kept = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
    masked = "".join(x for pair in zip(kept, [*names, ""]) for x in pair)
    if CITED not in names and masked.count(REF) == 1:
        return masked.replace(REF, CITED), True
    return masked, CITED in names


def _folded(name: str) -> str:
    apart = unicodedata.normalize("NFKD", name)
    return "".join(filter(lambda c: not unicodedata.combining(c), apart)).casefold()


def first_family(authors: str) -> str:
    """The family name of the first of a marker's authors, folded."""
    alone = re.match(r"(?:(?! et | and | & )[^,])*", authors)[0].split()
    return _folded(alone[-1]) if alone else ""


def masked_by_author(text: str, family: str | None, year: int | None) -> tuple[str, bool]:
    """First rule: the cited work is known by its first author's family name and year."""
    wanted = _folded(family.split()[-1]) if family and year is not None else None
    return written_over(text, markers(text, 1), lambda m: bool(wanted and m.authors) and first_family(m.authors) == wanted and str(year) in m.years)


def masked_by_number(text: str, places=(), list_length: int | None = None) -> tuple[str, bool]:
    """Second rule: the cited work is known by its places in the citing paper's list, if no marker names one beyond its end."""
    found = markers(text, 2)
    highest = max((n for m in found for n in m.numbers), default=0)
    wanted = frozenset(places or ()) if list_length is not None and highest <= list_length else frozenset()
    return written_over(text, found, lambda m: not wanted.isdisjoint(m.numbers))


def _masked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        out = []
        for text, family, year, places, length in zip(*columns):
            text = text if isinstance(text, str) else ""
            masked, placed = masked_by_author(text, family if isinstance(family, str) else None, None if pd.isna(year) else int(year))
            rule = "citations_v1"
            if not placed:
                masked, placed = masked_by_number(text, () if places is None else map(int, places), None if pd.isna(length) else int(length))
                rule = "citations_v2"
            out.append((masked, placed, rule))
        yield pd.DataFrame(out, columns=["text", "placed", "rule"])


def mask_citations(*columns: Column | str) -> Column:
    """struct<text, placed, rule> of a context's (text, family, year, positions, list_length): by author, else by number."""
    return F.pandas_udf(_masked, "struct<text:string,placed:boolean,rule:string>")(*columns)
