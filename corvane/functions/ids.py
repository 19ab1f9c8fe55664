"""Identifiers, names and hashed keys as column expressions (SCA01-SCA09, NUM01-NUM02, TXT15)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLVER = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"

#: Latin letters with their plain forms, for folding names in the JVM.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def short_id(x: Column) -> Column:
    """Last path segment; null for null and empty values."""
    return F.when(F.length(x) > 0, F.regexp_extract(F.regexp_replace(x, "/+$", ""), "[^/]*$", 0))


def normalize_doi(x: Column) -> Column:
    """Lower-case DOI without one resolver prefix; blank is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(x), RESOLVER, ""))), F.lit(""))


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def run_id(started: Column, stage: Column, subject: Column) -> Column:
    return F.concat_ws("-", F.date_format(started, "yyyy-MM-dd'T'HHmm'Z'"), slug(stage), slug(subject))


def frame_id(lineage: Column, start: Column) -> Column:
    return F.concat(lineage, F.lit("@"), start.cast("string"))


def frame_lineage(frame: Column) -> Column:
    return F.regexp_extract(frame, r"^(.*)@(\d+)$", 1)


def frame_start(frame: Column) -> Column:
    return F.regexp_extract(frame, r"^(.*)@(\d+)$", 2).cast("int")


def fold(x: Column) -> Column:
    """Letters only, lower case, accents of Latin letters removed."""
    return F.regexp_replace(F.lower(F.translate(x, ACCENTED, PLAIN)), "[^a-z]", "")


def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re
    import unicodedata

    for batch in batches:
        yield batch.map(lambda s: None if s is None else re.sub("[^a-z]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()))


def fold_unicode(x: Column) -> Column:
    """``fold`` for every script: compatibility decomposition, then ASCII letters only."""
    return F.pandas_udf(_folded, "string")(x)


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.translate(F.coalesce(name, F.lit("")), ",", " ")), r"\s+"), lambda w: F.btrim(w, F.lit(".")) != "")


def name_key(name: Column) -> Column:
    """family:initials of a display name; null without a family name of letters."""
    words = name_words(name)
    family = fold(F.element_at(words, -1))
    given = F.slice(words, F.lit(1), F.size(words) - 1)
    parts = F.flatten(F.transform(given, lambda w: F.split(F.translate(w, ".", " "), " ")))
    initials = F.array_join(F.transform(parts, lambda p: F.substring(fold(p), 1, 1)), "")
    return F.when((F.size(words) > 0) & (family != ""), F.concat(family, F.lit(":"), initials))


def node_key(author_id: Column, name: Column, by_name: bool) -> Column:
    """The graph node of an author: the id itself, or family name and first initial."""
    if not by_name:
        return author_id
    key = name_key(name)
    short = F.concat(F.substring_index(key, ":", 1), F.lit(":"), F.substring(F.substring_index(key, ":", -1), 1, 1))
    return F.when(F.startswith(author_id, F.lit("name:")), F.substring(author_id, 6, 1 << 20)).otherwise(short)


def listed_author_id(given: Column, family: Column) -> Column:
    """name:family:i of an author known by name only."""
    return F.concat(F.lit("name:"), fold(family), F.lit(":"), F.substring(fold(given), 1, 1))


def stable_key(x: Column) -> Column:
    """The first four bytes of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long")


def request_key(source: Column, url: Column, params: Column) -> Column:
    """A key of a request that does not depend on the order of its parameters (a map)."""
    return F.sha2(F.to_json(F.struct(source.alias("source"), url.alias("url"), F.array_sort(F.map_entries(params)).alias("params"))), 256)


def work_type(section: Column, names: dict[str, str], patterns: list[tuple[str, str]], default: str) -> Column:
    """The type of a section: by exact name without case, else by the first pattern, else the default."""
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.trim(section))) if names else F.lit(None).cast("string")
    found = exact
    for pattern, kind in patterns:
        found = F.coalesce(found, F.when(section.rlike(f"(?i){pattern}"), F.lit(kind)))
    return F.coalesce(found, F.lit(default))


def decimal_year(iso: Column) -> Column:
    """A partial ISO date, read at the end of its period, as a decimal year."""
    year = F.substring(iso, 1, 4).cast("int")
    day = (
        F.when(F.length(iso) == 4, F.make_date(year, F.lit(12), F.lit(31)))
        .when(F.length(iso) == 7, F.last_day(F.concat(iso, F.lit("-01")).cast("date")))
        .otherwise(iso.cast("date"))
    )
    return year + (F.dayofyear(day) - 1) / F.lit(365.25)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap_coefficient(shared: Column, a: Column, b: Column) -> Column:
    return F.try_divide(shared.cast("double"), F.least(a, b).cast("double"))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string("%.1f%%", x * 100))


def interval_text(point: Column, lower: Column, upper: Column) -> Column:
    return F.when(point.isNull(), F.lit("—")).otherwise(F.format_string("%.3f [%.3f, %.3f]", point, lower, upper))


def short_hash(x: Column) -> Column:
    return F.substring(x, 1, 12)
