"""Bibliographic references: volumes, pages, journals, kinds and matching rules (TXT01-TXT05, JOIN07-JOIN09).

Values below that must be as they are for right results are marked; the cascades over
them are ordered ``when`` columns, so references are classified inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a reference.
REFERENCE = "struct<doi:string,year:int,volume:string,first_page:string,journal:string,article_title:string,series_title:string,volume_title:string,text:string>"

#: Patterns of volumes, pages and citation layouts (volume, page and year groups in the order given).
VOLUME = r"^[A-Za-z]{0,2}\s?(\d{1,4})[A-Za-z]?$"
PAGE = r"^([A-Za-z]?\d{1,6}[A-Za-z]?)(?:\s*(?:ff\.?|[-–]\s*[A-Za-z]?\d+))?$"
LAYOUTS = (
    (r"\b([A-Z]{0,2}\d{1,4}[A-Z]?)\s*[,:]?\s+([A-Za-z]?\d{1,6})(?:\s*[-–]\s*[A-Za-z]?\d+)?\s*\(\s*((?:18|19|20)\d{2})[a-z]?\s*\)", 1, 2, 3),
    (r"\b([A-Z]{0,2}\d{1,4}[A-Z]?)\s*[,:]\s*([A-Za-z]?\d{1,6})(?:\s*[-–]\s*[A-Za-z]?\d+)?\s*\(\s*((?:18|19|20)\d{2})[a-z]?\s*\)", 1, 2, 3),
    (r"\b([A-Z]{0,2}\d{1,4}[A-Z]?)\s*\(\s*((?:18|19|20)\d{2})[a-z]?\s*\)\s*,?\s*(?:p+\.\s*)?([A-Za-z]?\d{1,6})", 1, 3, 2),
    (r"\b((?:18|19|20)\d{2})[a-z]?\s*[.;,]\s*(\d{1,4})(?:\s*\(\d+\))?\s*:\s*(?:p+\.\s*)?([A-Za-z]?\d{1,6})", 2, 3, 1),
)
#: Words that journal names may lack.
STOPWORDS = ("of", "the", "and", "for", "in", "on", "a", "an", "section", "der", "die", "und", "de", "la")
#: What tells the kinds of references apart.
THESIS = r"(?i)\b(?:thesis|dissertation|ph\.?\s?d\b|m\.?\s?sc\b|diplomarbeit)"
UNPUBLISHED = r"(?i)\b(?:to be published|in press|submitted|unpublished|private communication|personal communication|in preparation|arxiv|preprint)"
PROCEEDINGS = r"(?i)\b(?:proc\.|proceedings|conference|conf\.|symposium|workshop|colloquium|iccf)"
REPORT = r"(?i)\b(?:[A-Z]{2,}[- ]?(?:PUB|REP|TH|EP|PH|TM)[- ]?\d|CERN[- ]\d|DOE/|LA-UR\b|UCRL\b|ORNL\b|technical report|tech\. rep|report (?:no|number|of|to)\b|memorandum)"
WEB = r"(?i)https?://|www\.|available (?:at|from)\b"
BOOK = r"(?i)\((?:eds?|editors?)\.?\)|\beds?\.\s*\)|\b(?:university )?press\b|\bpublishers?\b|\bverlag\b|\bisbn\b|\b\d(?:st|nd|rd|th) ed(?:ition|\.)"
PUBLISHER_CITY = r"(?U)\((?:[A-Z][\w.&'-]*\s)*[A-Z][\w.&'-]*\s?,\s*[A-Z][\w .'-]+,\s*(?:18|19|20)\d\d\)"
NEWS = r"(?i)\b(?:new scientist|newspaper|magazine)\b"
#: Fixed values of the rescue rule: kinds of candidates, words of a title, of a strong one, and its share.
RESCUE_TYPES = ("journal-article", "proceedings-article")
MIN_TITLE_WORDS, STRONG_TITLE_WORDS, STRONG_TITLE_SHARE = 5, 7, 0.85
ANY_YEAR = r"\b((?:18|19|20)\d{2})\b"


def _group(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), pattern, group), F.lit(""))


def volume(x: Column) -> Column:
    """The number of a volume, section letters dropped."""
    return _group(F.trim(x), VOLUME, 1)


def page(x: Column) -> Column:
    """The first page, its letter kept."""
    return _group(F.trim(x), PAGE, 1)


def _present(x: Column) -> Column:
    return F.coalesce(F.length(x) > 0, F.lit(False))


def biblio_of(ref: Column) -> Column:
    """struct<year, volume, first_page, journal> from the fields, else from the text; null where unreadable."""
    fielded = F.coalesce(ref["year"] != 0, F.lit(False)) & _present(ref["volume"]) & _present(ref["first_page"])

    def of(year: Column, vol: Column, first: Column) -> Column:
        return F.when(vol.isNotNull() & first.isNotNull(), F.struct(year.cast("int").alias("year"), vol.alias("volume"), first.alias("first_page"), ref["journal"].alias("journal")))

    from_text = [of(_group(ref["text"], p, y), volume(_group(ref["text"], p, v)), page(_group(ref["text"], p, g))) for p, v, g, y in LAYOUTS]
    return F.when(fielded, of(ref["year"], volume(ref["volume"]), page(ref["first_page"]))).otherwise(F.coalesce(*from_text))


def journal_words(name: Column) -> Column:
    main = F.lower(F.substring_index(F.coalesce(name, F.lit("")), ":", 1))
    return F.filter(F.regexp_extract_all(main, F.lit("([a-z0-9]+)")), lambda w: ~w.isin(*STOPWORDS))


def journal_compatible(cited: Column, candidate: Column) -> Column:
    """Word by word, each word of the cited name opens the candidate's."""
    a, b = journal_words(cited), journal_words(candidate)
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.startswith(z["b"], z["a"]))


def journal_contained(cited: Column, candidate: Column) -> Column:
    """As ``journal_compatible``, the candidate's further words passed over in order."""
    a, b = journal_words(cited), journal_words(candidate)
    reached = F.aggregate(b, F.lit(0), lambda at, w: F.when((at < F.size(a)) & F.startswith(w, F.get(a, at)), at + 1).otherwise(at))
    return (F.size(a) > 0) & (reached == F.size(a))


def content_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def share_in(words: Column, pool: Column) -> Column:
    """The share of words, repeats counted, that the pool holds; 0 without words."""
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(pool, w))).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def reference_kind(ref: Column) -> Column:
    """paper, excluded or unclassifiable."""
    text = F.concat_ws(" ", *[F.nullif(ref[c], F.lit("")) for c in ("text", "journal", "series_title", "volume_title", "article_title")])
    rules = [
        (_present(ref["doi"]), "paper"),
        (text.rlike(THESIS) | text.rlike(UNPUBLISHED) | text.rlike(NEWS), "excluded"),
        (_present(ref["series_title"]) | text.rlike(PROCEEDINGS), "paper"),
        (text.rlike(REPORT) | text.rlike(WEB), "excluded"),
        (_present(ref["volume_title"]) & ~_present(ref["journal"]), "excluded"),
        (text.rlike(BOOK) | F.coalesce(ref["text"], F.lit("")).rlike(PUBLISHER_CITY), "excluded"),
        (_present(ref["journal"]) | biblio_of(ref).isNotNull(), "paper"),
    ]
    kind = F.lit("unclassifiable")
    for test, name in reversed(rules):
        kind = F.when(test, F.lit(name)).otherwise(kind)
    return kind


def rescue_query(ref: Column) -> Column:
    """What to search a reference by: its text or its fields, 300 characters of it; null under 20."""
    fields = F.concat_ws(" ", *[F.nullif(ref[c], F.lit("")) for c in ("article_title", "journal", "volume", "first_page")], F.when(ref["year"] != 0, ref["year"].cast("string")))
    query = F.trim(F.when(_present(ref["text"]), ref["text"]).otherwise(fields))
    return F.when(F.length(query) >= 20, F.substring(query, 1, 300))


def _title_overlap(ref: Column, candidate: Column, share: float) -> tuple[Column, Column]:
    """(the titles agree, they agree strongly): content words of the candidate's title in the reference, and of the cited title in the candidate's."""
    everything = F.concat_ws(" ", *[F.nullif(ref[c], F.lit("")) for c in ("text", "article_title", "journal", "series_title")])
    found, cited = content_words(candidate["title"]), content_words(ref["article_title"])
    there = share_in(found, content_words(everything))
    agree = (F.size(found) >= MIN_TITLE_WORDS) & (there >= share) & ((F.size(cited) == 0) | (share_in(cited, found) >= share))
    return agree, agree & (F.size(found) >= STRONG_TITLE_WORDS) & (there >= STRONG_TITLE_SHARE)


def rescue_score(ref: Column, candidate: Column, title_share: float, year_tolerance: int) -> Column:
    """What speaks for a candidate: 2 a title, 1 numbers or a journal in a known year, 0 nothing; -1 where something speaks against it.

    Against it speak a year too far off, numbers that all differ (unless the titles agree strongly), and a
    journal article for what was cited from proceedings.
    """
    cited, year = biblio_of(ref), F.coalesce(ref["year"], _group(ref["text"], ANY_YEAR, 1).cast("int"))
    agree, strongly = _title_overlap(ref, candidate, title_share)
    theirs = F.array_compact(F.array(volume(candidate["volume"]), page(candidate["first_page"])))
    same_numbers = cited.isNotNull() & F.coalesce(F.arrays_overlap(theirs, F.array_compact(F.array(cited["volume"], cited["first_page"]))), F.lit(False))
    same_journal = _present(ref["journal"]) & _present(candidate["journal"]) & journal_contained(ref["journal"], candidate["journal"])
    apart = F.abs(candidate["year"] - year)
    of_proceedings = ref["series_title"].isNotNull() | F.concat_ws(" ", *[F.nullif(ref[c], F.lit("")) for c in ("text", "article_title", "journal", "series_title")]).rlike(PROCEEDINGS)
    against = [
        F.coalesce(apart > year_tolerance, F.lit(False)),
        cited.isNotNull() & (F.size(theirs) > 0) & ~same_numbers & ~strongly,
        of_proceedings & (candidate["kind"] == "journal-article") & ~F.coalesce(candidate["journal"], F.lit("")).rlike(PROCEEDINGS),
    ]
    score = F.when(agree, 2).when(apart.isNotNull() & (same_numbers | same_journal), 1).otherwise(0)
    for objection in against:
        score = F.when(objection, -1).otherwise(score)
    return score


def rescue_accepts(ref: Column, candidate: Column, min_score: float, title_share: float, year_tolerance: int) -> Column:
    """Whether a candidate (doi, score, year, volume, first_page, journal, title, kind) may be the cited paper."""
    offered = _present(candidate["doi"]) & candidate["kind"].isin(*RESCUE_TYPES) & (candidate["score"] >= min_score)
    return F.coalesce(offered & (rescue_score(ref, candidate, title_share, year_tolerance) > 0), F.lit(False))


def rescue_match(ref: Column, candidates: Column, min_score: float, title_share: float, year_tolerance: int) -> Column:
    """The DOI of the first candidate that is accepted, in the order given."""
    return F.get(F.filter(candidates, lambda c: rescue_accepts(ref, c, min_score, title_share, year_tolerance)), F.lit(0))["doi"]


def catalogue_accepts(ref: Column, entry: Column, opening: Column, year_tolerance: int) -> Column:
    """Whether a listed paper (aliases, year, volume, first_page, first_author) is the cited one.

    Volume equality is left to the join. ``opening``: the folded opening of the reference's text.
    """
    named = _present(ref["journal"]) & F.exists(entry["aliases"], lambda a: journal_compatible(ref["journal"], a))
    near = F.coalesce(F.abs(ref["year"] - entry["year"]) <= year_tolerance, F.lit(True))
    first = page(ref["first_page"])
    both = entry["first_page"].isNotNull() & first.isNotNull()
    by_author = _present(entry["first_author"]) & F.startswith(opening, entry["first_author"])
    return F.coalesce(named & near & F.when(both, entry["first_page"] == first).otherwise(by_author), F.lit(False))


def pages_match(n_candidates: Column, journal: Column, candidate_journals: Column) -> Column:
    """One work at a year, volume and page matches; of several, a journal must agree."""
    return (n_candidates == 1) | (journal.isNotNull() & F.exists(candidate_journals, lambda n: _present(n) & journal_compatible(journal, n)))
