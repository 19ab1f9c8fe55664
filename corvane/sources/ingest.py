"""Contents pages and exports of venues as rows (SRC17-SRC24).

A page is cut at its headings and entries by one split with a look-ahead, the pieces are
numbered, and a section is the last heading before a piece: a window over pieces, not a
parser with state. Adapters return venue, key, title, year, volume, issue, first_page,
authors (family, given), section and document_url; ``listed`` gives them types and keeps
the first of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ids import fold, listed_author_id, work_type
from corvane.functions.text import authors_of, fragment_text, html_text

AUTHORS = "array<struct<family:string,given:string>>"


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _pieces(pages: DataFrame, marks: str) -> DataFrame:
    return pages.select("url", "html", F.posexplode(F.split("html", f"(?is)(?={marks})")).alias("place", "piece"))


def _sectioned(pieces: DataFrame, heading: Column) -> DataFrame:
    w = Window.partitionBy("url").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def _entry(df: DataFrame, **columns: Column) -> DataFrame:
    names = ("key", "title", "year", "volume", "issue", "first_page", "authors", "section", "document_url")
    none = {"authors": F.array().cast(AUTHORS), "year": F.lit(None).cast("int")}
    return df.select("url", "place", *[columns.get(n, none.get(n, F.lit(None).cast("string"))).cast({"authors": AUTHORS, "year": "int"}.get(n, "string")).alias(n) for n in names])


def ojs(pages: DataFrame) -> DataFrame:
    """Issue pages of either layout: headings, then article blocks."""
    pieces = _pieces(pages, r'<h2[^>]*>|<h4 class="tocSectionTitle">|<div class="obj_article_summary">|<table class="tocArticle"')
    heading = F.when(F.col("piece").rlike(r"(?i)^<h[24]"), fragment_text(F.regexp_extract("piece", r"(?is)^<h[24][^>]*>(.*?)</h[24]>", 1)))
    label = fragment_text(F.concat_ws(" ", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)))
    rows = _sectioned(pieces.withColumn("label", label), heading)
    article = r'(?s)href="[^"]*/article/view/([^/"]+)"[^>]*>(.*?)</a>'
    rows = rows.where(F.col("piece").rlike(r"(?i)^<(?:div|table)") & F.col("piece").rlike(article))
    p = F.col("piece")
    galley = _found(p, r'(?is)href="([^"]*/article/view/[^/"]+/[^/"]+)"[^>]*>\s*PDF')
    return _entry(
        rows, key=_found(p, article), title=fragment_text(_found(p, article, 2)), year=F.coalesce(_found(F.col("label"), r"\(((?:18|19|20)\d{2})\)"), _found(F.col("label"), r"(?i)Vol\.?\s*((?:18|19|20)\d{2})\b")),
        volume=_found(F.col("label"), r"(?i)Vol\.?\s*(\d+)"), issue=_found(F.col("label"), r"(?i)Vol\.?\s*\d+\s*No\.?\s*([\w-]+)"), first_page=_found(p, r'(?s)class="(?:pages|tocPages)"[^>]*>\s*0*(\d+)'),
        authors=authors_of(fragment_text(_found(p, r'(?s)class="(?:authors|tocAuthors)"[^>]*>(.*?)</(?:div|td)>'))), section=F.col("section"), document_url=F.replace(galley, F.lit("/article/view/"), F.lit("/article/download/")),
    )


def bepress(pages: DataFrame) -> DataFrame:
    pieces = _pieces(pages, r'<h2[^>]*>|<div class="doc">')
    heading = F.when(F.col("piece").rlike(r"(?i)^<h2"), fragment_text(F.regexp_extract("piece", r"(?is)^<h2[^>]*>(.*?)</h2>", 1)))
    rows = _sectioned(pieces.withColumn("label", fragment_text(F.col("html"))), heading)
    issue = r"(?i)Volume\s*(\d+),\s*Issue\s*(\d+)\s*\((\d{4})\)"
    article = r'(?s)href="[^"]*/vol\d+/iss\d+/(\d+)/?"[^>]*>(.*?)</a>'
    rows = rows.where(F.col("piece").rlike(r"(?i)^<div") & F.col("piece").rlike(article) & F.col("label").rlike(issue))
    p, label = F.col("piece"), F.col("label")
    vol, no = _found(label, issue), _found(label, issue, 2)
    return _entry(
        rows, key=F.concat(F.lit("v"), vol, F.lit("-i"), no, F.lit("-"), _found(p, article)), title=fragment_text(_found(p, article, 2)), year=_found(label, issue, 3), volume=vol, issue=no,
        authors=authors_of(fragment_text(_found(p, r'(?s)<span class="auth">(.*?)</span>'))), section=F.col("section"), document_url=F.replace(_found(p, r'href="([^"]*viewcontent\.cgi\?[^"]+)"'), F.lit("&amp;"), F.lit("&")),
    )


def cards(pages: DataFrame, first_volume_year: int, base: str) -> DataFrame:
    """Volume pages (url, html, number) of paper cards."""
    rows = pages.select("url", "number", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<article class="paper-card">(.*?)</article>'), F.lit(1))).alias("place", "piece"))
    title = r'(?s)<h4>\s*<a href="(/[^"]+)"[^>]*>(.*?)</a>'
    rows = rows.where(F.col("piece").rlike(title))
    p = F.col("piece")
    names = F.flatten(F.transform(F.regexp_extract_all(p, F.lit(r'(?s)<span class="contribName">(.*?)</span>'), F.lit(1)), lambda c: F.split(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"(?i),?\s*et\.?\s*al\.?", ""), r",|\band\b|&")))
    words = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.split(F.trim(n), r"\s+"))
    people = F.transform(words, lambda w: F.struct(F.element_at(w, -1).alias("family"), F.nullif(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.lit("")).alias("given")))
    return _entry(
        rows, key=F.btrim(_found(p, title), F.lit("/")), title=fragment_text(_found(p, title, 2)), year=F.col("number") + first_volume_year - 1, volume=F.col("number"), first_page=_found(p, r"pp\.\s*(\d+)"), authors=people,
        document_url=F.concat(F.lit(base), _found(p, title)),
    )


def toc(pages: DataFrame) -> DataFrame:
    """Contents pages whose PDF links belong to the last anchor before them (an as-of join by place)."""
    link = r'<a[^>]*href="(?:[^"]*/)?pdf/\d{4}-v\d+n\d+-p\d+\.pdf"'
    bare = pages.withColumn("html", F.regexp_replace("html", r"(?s)<!--.*?-->", " "))
    pieces = _pieces(bare, rf'<a\s+name="[\w-]+"[^>]*>|{link}')
    p = F.col("piece")
    anchor = F.lower(_found(p, r'(?is)^<a\s+name="([\w-]+)"[^>]*>'))
    rows = _sectioned(pieces, anchor)
    before = Window.partitionBy("url").orderBy("place")
    # What stands before a link is what its last piece holds after its own mark; an anchor's first line is its heading.
    rest = F.regexp_replace(F.regexp_replace(p, r'(?is)^<a\s+name="[\w-]+"[^>]*>', ""), rf"(?is)^{link}[^>]*>.*?</a>", "")
    rows = rows.withColumn("lead", F.lag(rest).over(before)).withColumn("headed", F.lag(anchor.isNotNull()).over(before))
    stem = r'(?is)^<a[^>]*href="((?:[^"]*/)?pdf/((\d{4})-v(\d+)n(\d+)-p(\d+))\.pdf)"'
    rows = rows.where(p.rlike(stem) & F.col("section").isNotNull())
    lines = F.filter(F.split(html_text(F.col("lead")), "\n"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("lines", lines)
    rows = rows.withColumn("lines", F.when(F.col("headed"), F.slice("lines", 2, 1000)).otherwise(F.col("lines")))
    upto = F.coalesce(F.get(F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"(?i)^Page\s*\d+"), i)), lambda i: i.isNotNull()), F.lit(0)), F.size("lines"))
    rows = rows.withColumn("head", F.slice("lines", F.lit(1), upto))
    n = F.size("head")
    return _entry(
        rows, key=_found(p, stem, 2), title=F.array_join(F.when(n >= 2, F.slice("head", F.lit(1), n - 1)).otherwise(F.col("head")), " "), year=_found(p, stem, 3), volume=_found(p, stem, 4).cast("int"), issue=_found(p, stem, 5).cast("int"),
        first_page=_found(p, stem, 6).cast("int"), authors=F.when(n >= 2, authors_of(F.element_at("head", -1))).otherwise(F.array().cast(AUTHORS)), section=F.col("section"),
        document_url=F.concat(F.regexp_replace("url", "/[^/]*$", ""), F.lit("/"), _found(p, stem)),
    )


EXPORT = "array<struct<eprintid:string,title:string,date:string,type:string,publication:string,volume:string,number:string,pagerange:string,creators:array<struct<name:struct<family:string,given:string>>>,documents:array<struct<format:string,files:array<struct<uri:string>>>>>>"


def eprints(pages: DataFrame, aliases: list[str]) -> DataFrame:
    """JSON exports (url, html: the JSON)."""
    rows = pages.select("url", F.posexplode(F.from_json("html", EXPORT)).alias("place", "e"))
    e = F.col("e")
    rows = rows.where(F.coalesce(e["publication"], F.lit("")).isin("", *aliases))
    pdfs = F.filter(e["documents"], lambda d: d["format"] == "application/pdf")
    uris = F.filter(F.flatten(F.transform(pdfs, lambda d: F.transform(d["files"], lambda f: f["uri"]))), lambda u: u.isNotNull())
    people = F.filter(F.transform(e["creators"], lambda c: F.struct(F.trim(c["name"]["family"]).alias("family"), F.nullif(c["name"]["given"], F.lit("")).alias("given"))), lambda a: F.coalesce(a["family"], F.lit("")) != "")
    return _entry(
        rows, key=e["eprintid"], title=F.trim(F.regexp_replace(F.coalesce(e["title"], F.lit("")), r"\s+", " ")), year=_found(e["date"], r"^(\d{4})"), volume=e["volume"], issue=e["number"], first_page=_found(e["pagerange"], r"^\s*(\d+)"),
        authors=F.coalesce(people, F.array().cast(AUTHORS)), section=e["type"], document_url=F.get(uris, F.lit(0)),
    )


def endnote_records(lines: DataFrame) -> DataFrame:
    """(url, record, fields) of tagged lines (url, place, line): a record starts at %0; fields map tags to values in order."""
    tagged = lines.select("url", "place", F.regexp_extract("line", r"^%(\S) ?(.*)$", 1).alias("tag"), F.trim(F.regexp_extract("line", r"^%(\S) ?(.*)$", 2)).alias("value")).where("tag != ''")
    w = Window.partitionBy("url").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("record", F.sum((F.col("tag") == "0").cast("int")).over(w)).where("record > 0 and value != ''")
    fields = tagged.groupBy("url", "record", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    return fields.groupBy("url", "record").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("fields"))


def endnote(lines: DataFrame, record_pattern: str, last_year: int | None) -> DataFrame:
    """Works of an export; a PDF that several records point into is a volume, each with the pages up to the next start."""
    rows = endnote_records(lines).withColumnRenamed("record", "place")
    tag = lambda t: F.coalesce(F.try_element_at("fields", F.lit(t)), F.array().cast("array<string>"))
    one = lambda t: F.get(tag(t), F.lit(0))
    rows = rows.withColumn("year", _found(one("D"), r"^(\d{4})").cast("int")).where(F.exists(tag("B"), lambda b: b.rlike(f"(?i){record_pattern}")))
    if last_year is not None:
        rows = rows.where(F.col("year") <= last_year)
    link = F.regexp_replace(one("U"), "#.*$", "")
    rows = rows.withColumn("base", F.when(F.lower(link).endswith(".pdf"), link)).withColumn("page", _found(one("U"), r"#page=(\d+)").cast("int"))
    rows = rows.withColumn("uses", F.when(link.isNotNull(), F.count("*").over(Window.partitionBy(link))))
    starts = rows.where("base is not null and page is not null and uses > 1").select("base", "page").distinct()
    starts = starts.withColumn("until", F.lead("page").over(Window.partitionBy("base").orderBy("page")) - 1)
    rows = rows.join(starts, ["base", "page"], "left")
    ranged = F.concat(F.col("base"), F.lit("#pages="), F.col("page").cast("string"), F.lit("-"), F.coalesce(F.col("until").cast("string"), F.lit("")))
    document = F.when(F.col("uses") > 1, ranged).otherwise(F.col("base"))
    title = F.trim(F.regexp_replace(F.coalesce(one("T"), F.lit("")), r"\s+", " "))
    people = F.transform(tag("A"), lambda a: F.struct(F.trim(F.substring_index(a, ",", 1)).alias("family"), F.nullif(F.trim(F.regexp_replace(a, "^[^,]*,?", "")), F.lit("")).alias("given")))
    people = F.filter(people, lambda a: fold(a["family"]) != "")
    basis = F.concat_ws("|", F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lower(title), F.coalesce(fold(F.get(people, F.lit(0))["family"]), F.lit("")))
    return _entry(rows, key=F.substring(F.sha2(basis, 256), 1, 12), title=title, year=F.col("year"), volume=one("V"), first_page=_found(one("P"), r"^\s*(\d+)"), authors=people, section=one("0"), document_url=document)


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"ojs_v1": ojs, "bepress_v1": bepress, "arj_volumes_v1": cards, "orthomolecular_toc_v2": toc, "eprints_json_v1": eprints, "endnote_v1": endnote}


def list_works(adapter: str, pages: DataFrame, start: int, end: int, **options) -> DataFrame:
    """Works that an adapter lists, in the years; an unknown adapter raises."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}")
    return ADAPTERS[adapter](pages, **options).where(F.col("year").between(start, end))


def listed(entries: DataFrame, venue: str, name: str, names: dict[str, str], patterns: list[tuple[str, str]], default: str) -> dict[str, DataFrame]:
    """The four tables of listed works: the first entry of a key stands."""
    w = Window.partitionBy("key").orderBy("url", "place")
    rows = entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("work_id", F.concat(F.lit(f"X:{venue}:"), F.col("key")))
    kind = work_type(F.coalesce("section", F.lit("")), names, patterns, default)
    none = F.lit(None).cast("string")
    people = rows.select("work_id", F.size("authors").alias("n"), F.posexplode("authors").alias("i", "a"))
    ident = listed_author_id(F.coalesce("a.given", F.lit("")), F.col("a.family"))
    position = F.when(F.col("i") == 0, "first").when(F.col("i") == F.col("n") - 1, "last").otherwise("middle")
    return {
        "works": rows.select("work_id", none.alias("doi"), "title", "year", F.lit(f"X:{venue}").alias("venue_id"), F.lit(name).alias("venue_name"), kind.alias("type"), F.lit(None).cast("bigint").alias("cited_by_count"), F.lit(venue).alias("source")),
        "authors": people.select(ident.alias("author_id"), F.concat_ws(" ", "a.given", "a.family").alias("display_name"), F.lit("name").alias("disambiguation_source"), F.lit(None).cast("double").alias("confidence")).distinct(),
        "authorships": people.select("work_id", ident.alias("author_id"), position.alias("position"), F.array().cast("array<string>").alias("institution_ids")),
        "ingested": rows.select("work_id", F.lit(venue).alias("venue"), "volume", "issue", "first_page", fold(F.get("authors", F.lit(0))["family"]).alias("first_author"), "document_url"),
    }


def split_pages(url: Column) -> Column:
    """struct<url, first, last> of a document link with a page range."""
    pattern = r"^(.*)#pages=(\d+)-(\d*)$"
    return F.struct(F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1)).otherwise(url).alias("url"), _found(url, pattern, 2).cast("int").alias("first"), _found(url, pattern, 3).cast("int").alias("last"))


def issue_links(pages: DataFrame, pattern: str) -> DataFrame:
    """Distinct links of index pages that match, in order of their first place."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("place", "link"))
    return rows.groupBy("link").agg(F.min(F.struct("url", "place")).alias("at")).orderBy("at").select("link")
