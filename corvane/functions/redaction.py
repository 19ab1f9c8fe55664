"""Redaction of contexts by dictionaries (TXT11, SRT05): one alternation, a group for each entry, and a table of what the groups stand for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of redacted entries.
PLACEHOLDERS = {"terms": "[TERM]", "names": "[NAME]", "places": "[PLACE]", "organisations": "[ORG]"}
GAP = r"[\s-]+"


def entries(dictionaries: list[dict]) -> dict[str, str]:
    """Placeholder by entry, lower-cased, spaces squeezed; the first dictionary that has an entry decides."""
    listed = [(" ".join(str(raw).lower().split()), kind) for d in dictionaries for kind in PLACEHOLDERS for raw in d.get(kind) or []]
    if empty := [kind for entry, kind in listed if not entry.strip("* ")]:
        raise ValueError(f"empty entry under {empty[0]!r}")
    return {entry: PLACEHOLDERS[kind] for entry, kind in reversed(listed)}


def compiled(known: dict[str, str]) -> tuple[re.Pattern, list[str]] | None:
    """(pattern, placeholder of each of its groups); of entries that begin at one place the longest wins. Entries that end in * are stems."""
    if not known:
        return None
    order = sorted(known, key=lambda e: (-len(e.rstrip("*")), e))
    stems = {e.rstrip("*").strip(): p for e, p in known.items() if e.endswith("*")}

    def stands_for(entry: str) -> str:
        # A hyphen matches as a space does, so an entry is looked up as it is read.
        read = re.sub(GAP, " ", entry.rstrip("*"))
        if not entry.endswith("*") and read in known:
            return known[read]
        longest = max((stem for stem in stems if read.startswith(stem)), key=len, default=None)
        return stems.get(longest, PLACEHOLDERS["terms"])

    def expression(entry: str) -> str:
        return rf"\b{GAP.join(map(re.escape, entry.rstrip('*').split()))}" + (r"\w*" if entry.endswith("*") else r"\b")

    return re.compile("|".join(f"({expression(e)})" for e in order), re.IGNORECASE), [stands_for(e) for e in order]


def redacted(text: str, rules: tuple[re.Pattern, list[str]] | None) -> str:
    return rules[0].sub(lambda m: rules[1][m.lastindex - 1], text) if rules else text


def redact(text: Column, dictionaries: list[dict]) -> Column:
    rules = compiled(entries(dictionaries))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else redacted(t, rules))

    return run(text)
