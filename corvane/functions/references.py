"""Reference lists of documents (TXT07, TXT08, SRC25, SRC26): the section is cut out of the text, the section into entries, entries are read.

All three work on whole texts by the places where patterns match, not line by line.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import HEADING, html_reference_section, html_text

#: Ends of reference lists, page furniture, starts of entries, and layouts in entries.
STOP = r"(?i)^\s*(?:appendix\b|about the authors?\b)"
FURNITURE = r"(?i)^\s*(?:\d{1,4}|volume \d+,? \w+ \d{4}|.{0,60}\bvol\.\s*\d+\s*,?\s*no\.\s*\d+\s*)$"
ENTRY_START = (
    r"^\s*(?:\[\d{1,3}\]|\d{1,3}\.\s|_{2,}|—+\s|[A-Z][A-Za-z'’\-]+(?: [A-Z][A-Za-z'’\-]+)?,\s*(?:[A-Z]\.|[A-Z][a-z]+\b)|"
    r"[A-Z][A-Za-z'’\-]+ [A-Z]\.(?: ?[A-Z]\.)*(?:,| and\b| &| (?:18|19|20)\d\d)|[A-Z]{2,}[A-Z'’\- ]*\s*[,:])"
)
DITTO = r"^\s*[_—–\-.]*\s*(?:\((?:eds?|editors?)\)\.?\s*)?(?:18|19|20)\d\d[a-z]?\."
AUTHOR_PART = r"^(.*?)(?:\s|\.)(?:18|19|20)\d\d[a-z]?\."
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"
ENTRY_YEAR = r"\b((?:18|19|20)\d{2})[a-z]?\b"
COLON_STYLE = r"(?P<volume>\d{1,4})\s*(?:[({][^)}]{1,12}[)}])?\s*:\s*(?:p+\.\s*)?(?P<page>\d{1,5})\b"
COMMA_STYLE = r"(?P<volume>\d{1,4})\s*,\s*(?P<page>\d{1,5})\s*[-–]\s*\d{1,5}\s*,\s*(?P<year>(?:18|19|20)\d{2})\b"
ABBREVIATION = r"^(?:[A-Z][a-z]{0,6}\.|[A-Z]{2,8}|&|of|and|the)$"
NUMBERED_ENTRY = r"^\s*(?:\[(?P<b>\d{1,3})\]|(?P<n>\d{1,3})\.)\s+\S"
#: Fewest characters of an entry, lines that the first three numbered entries lie within, and how often a line of some length is furniture.
LEAST_ENTRY, OPENING, FURNITURE_TIMES, FURNITURE_CHARS = 12, 30, 3, 5
#: Fixed value: characters in which an entry's year is looked for first.
YEAR_WITHIN = 160
ENTRY = "struct<doi:string,year:int,volume:string,first_page:string,journal:string,text:string>"

_YEAR, _DOI, _COMMA, _COLON, _SHORT = map(re.compile, (ENTRY_YEAR, DOI, COMMA_STYLE, COLON_STYLE, ABBREVIATION))
_LINE = {name: re.compile(pattern) for name, pattern in {"heading": HEADING, "stop": STOP, "furniture": FURNITURE, "numbered": NUMBERED_ENTRY}.items()}


def _first(name: str, lines: list[str]) -> int:
    """Place of the first line of a kind; past the end if there is none."""
    return next((i for i, line in enumerate(lines) if _LINE[name].match(line)), len(lines))


def headed_section(lines: list[str]) -> list[str] | None:
    """What follows the last reference heading, up to an appendix or the like."""
    back = _first("heading", lines[::-1])
    after = lines[len(lines) - back :]
    return after[: _first("stop", after)] if back < len(lines) else None


def numbered_section(lines: list[str]) -> list[str] | None:
    """Without a heading: the last run numbered from 1 whose first three entries follow closely and have a year each, without lines that keep coming back."""
    at: dict[int, list[int]] = {1: [], 2: [], 3: []}
    for i, line in enumerate(lines):
        if (m := _LINE["numbered"].match(line)) and int(m["b"] or m["n"]) in at:
            at[int(m["b"] or m["n"])].append(i)

    def opening(one: int) -> list[int]:
        places = [one]
        for number in (2, 3):
            places += [i for i in at[number] if places[-1] < i <= one + OPENING][:1]
        return places

    for one, *more in map(opening, reversed(at[1])):
        if len(more) == 2 and all(re.search(r"\b(?:18|19|20)\d{2}\b", " ".join(lines[a:b])) for a, b in ((one, more[0]), more, (more[1], more[1] + 1))):
            often = Counter(line.strip() for line in lines if len(line.strip()) >= FURNITURE_CHARS)
            run = lines[one:]
            return [line for line in run[: _first("stop", run)] if often[line.strip()] < FURNITURE_TIMES]
    return None


def by_paragraphs(section: list[str]) -> list[str]:
    """An entry a paragraph."""
    return [" ".join(block) for filled, block in groupby((line.strip() for line in section), bool) if filled]


#: A line break after a sentence's end that is no initial, and the line after it.
_BREAK = re.compile(r"(?<=[.)\]\d])(?<!\s[A-Z]\.)(?<!^[A-Z]\.)\n(?=(?P<line>.*))")
_STARTS = (re.compile(DITTO), re.compile(ENTRY_START))
_HYPHEN = re.compile(r"(?:(?<! )-|¬)\n")


def by_starts(section: list[str]) -> list[str]:
    """Entries of a list whose lines are broken; of one that begins with a dash for the author, the author is the one before."""
    body = _HYPHEN.sub("", "\n".join(line for line in map(str.strip, section) if line and not _LINE["furniture"].match(line)))
    breaks = [(m.end(), [start.match(m["line"]) is not None for start in _STARTS]) for m in _BREAK.finditer(body)]
    cuts = [(at, ditto) for at, (ditto, new) in breaks if ditto or new]
    entries: list[str] = []
    for (start, same_author), (end, _) in zip([(0, False), *cuts], [*cuts, (len(body), False)]):
        entry = body[start:end].rstrip("\n").replace("\n", " ")
        author = re.match(AUTHOR_PART, entries[-1]) if same_author else None
        entries.append(f"{author[1].strip()} {entry.lstrip('_—–-. ')}" if author else entry)
    return [e for e in entries if e]


def journal_at_end(text: str) -> str | None:
    """The journal named at the end of a text: its last sentence, with the abbreviations before it that belong to it."""
    words = text.strip().rstrip(",;").split()
    starts = [i for i in range(len(words)) if i == 0 or words[i - 1][-1] in ".?!"]
    short = [bool(_SHORT.match(w)) for w in words]
    while len(starts) > 1:
        here, before = starts[-1], starts[-2]
        initial = here - before == 1 and re.fullmatch(r"[A-Z]\.", words[before])
        if not all(short[before:here]) or not (short[here] or initial):
            break
        starts.pop()
    name = " ".join(words[starts[-1] :]).strip(" .,;") if starts else ""
    return name if re.search("[A-Za-z]{2,}", name) and not _YEAR.fullmatch(name) else None


def read_entry(text: str) -> dict:
    """doi, year, volume, first_page and journal of an entry: ``volume, page-page, year`` if it is written so, else the first ``volume(issue):page`` that a journal stands before."""
    doi = _DOI.search(text)
    found = {"doi": doi and doi[1].rstrip(".,;)").lower(), "year": None, "volume": None, "first_page": None, "journal": None, "text": text}
    placed = _COMMA.search(text)
    if placed:
        found["year"], found["journal"] = int(placed["year"]), journal_at_end(text[: placed.start()])
    else:
        year = _YEAR.search(text[:YEAR_WITHIN]) or _YEAR.search(text)
        found["year"] = year and int(year[1])
        named = ((m, journal_at_end(text[: m.start()])) for m in _COLON.finditer(text))
        placed, found["journal"] = next(((m, j) for m, j in named if j), (None, None))
    if placed:
        found["volume"], found["first_page"] = placed["volume"], placed["page"]
    return found


def entries_of(text: str, by_paragraph: bool) -> list[dict] | None:
    """The reference list of a document; none (not empty) where it has none."""
    lines = text.splitlines()
    section = headed_section(lines)
    if section is None:
        section = [] if by_paragraph else numbered_section(lines) or []
    found = (by_paragraphs if by_paragraph else by_starts)(section)
    return [read_entry(e) for e in found if len(e) >= LEAST_ENTRY] or None


def references_of(text: Column, by_paragraph: bool) -> Column:
    """array<ENTRY> of a text's reference list; null where it has none."""

    @F.pandas_udf(f"array<{ENTRY}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: entries_of(t, by_paragraph) if isinstance(t, str) else None)

    return run(text)


def page_references(html: Column) -> Column:
    """array<ENTRY> of a web page: of the section under its last reference heading, or of the whole page where no heading element reads so."""
    section = html_reference_section(html)
    return references_of(F.when(section.isNotNull(), F.concat(F.lit("References\n\n"), html_text(section))).otherwise(html_text(html)), True)


def _pdf_texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    try:
        from pypdf import PdfReader
        from pypdf.errors import PyPdfError
    except ImportError as missing:
        raise RuntimeError("reading PDF text needs pypdf on the executors") from missing

    def read(content, first, last) -> str | None:
        if content is None:
            return None
        try:
            pages = PdfReader(io.BytesIO(bytes(content))).pages
            start = 0 if pd.isna(first) else max(int(first), 1) - 1
            return "\n".join(p.extract_text() or "" for p in pages[start : len(pages) if pd.isna(last) else int(last)])
        except PyPdfError:
            return None  # a damaged file

    for content, first, last in batches:
        yield pd.Series([read(*x) for x in zip(content, first, last)], dtype=object)


def pdf_text(content: Column, first_page: Column | None = None, last_page: Column | None = None) -> Column:
    """The text layer of PDF bytes, of some pages (counted from 1) or all; null for null and damaged ones. Raises where no PDF reader is installed."""
    none = F.lit(None).cast("int")
    return F.pandas_udf(_pdf_texts, "string")(content, none if first_page is None else first_page, none if last_page is None else last_page)
