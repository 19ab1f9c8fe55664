"""Bibliographic sources as nested columns: works, contexts, reference lists, candidates (SRC06, SRC11-SRC16, PRJ01-PRJ10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.biblio import REFERENCE
from corvane.functions.ids import blank_to_null, normalize_doi, short_id

#: Shapes of the archived answers.
WORK = (
    "struct<id:string,doi:string,display_name:string,publication_year:int,type:string,cited_by_count:bigint,biblio:struct<volume:string,first_page:string>,"
    "primary_location:struct<source:struct<id:string,display_name:string>>,authorships:array<struct<author_position:string,author:struct<id:string,display_name:string>,"
    "institutions:array<struct<id:string>>>>,referenced_works:array<string>,abstract_inverted_index:map<string,array<int>>>"
)
PAGE = f"struct<meta:struct<count:int,next_cursor:string>,results:array<{WORK}>>"
CITATION = "struct<contexts:array<string>,intents:array<string>,isInfluential:boolean,citingPaper:struct<paperId:string,externalIds:map<string,string>,title:string,year:int>>"
ENTRY = "struct<key:string,DOI:string,unstructured:string,year:string,volume:string,`first-page`:string,`journal-title`:string,`article-title`:string,`series-title`:string,`volume-title`:string>"
CANDIDATE = "struct<DOI:string,score:double,issued:struct<`date-parts`:array<array<int>>>,volume:string,page:string,`container-title`:array<string>,title:array<string>,type:string>"


def pages_to_works(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per listed work; the pages of a listing are rows, so paging is no loop."""
    return pages.select(F.explode(F.col(body)["results"]).alias("work"))


def works(df: DataFrame, source: str) -> DataFrame:
    w = F.col("work")
    place = w["primary_location"]["source"]
    return df.select(
        short_id(w["id"]).alias("work_id"), normalize_doi(w["doi"]).alias("doi"), w["display_name"].alias("title"), w["publication_year"].alias("year"), short_id(place["id"]).alias("venue_id"),
        place["display_name"].alias("venue_name"), w["type"].alias("type"), w["cited_by_count"].alias("cited_by_count"), F.lit(source).alias("source"),
    )


def _signed(df: DataFrame) -> DataFrame:
    rows = df.select(short_id(F.col("work.id")).alias("work_id"), F.explode("work.authorships").alias("a"))
    return rows.withColumn("author_id", short_id(F.col("a.author.id"))).where("author_id is not null")


def authors(df: DataFrame) -> DataFrame:
    return _signed(df).select("author_id", F.col("a.author.display_name").alias("display_name"), F.lit("openalex").alias("disambiguation_source"), F.lit(None).cast("double").alias("confidence"))


def authorships(df: DataFrame) -> DataFrame:
    ids = F.array_sort(F.filter(F.transform(F.coalesce("a.institutions", F.array().cast("array<struct<id:string>>")), lambda i: short_id(i["id"])), lambda x: x.isNotNull()))
    return _signed(df).select("work_id", "author_id", F.col("a.author_position").alias("position"), ids.alias("institution_ids"))


def citations(df: DataFrame) -> DataFrame:
    rows = df.select(short_id(F.col("work.id")).alias("citing_work"), F.explode(F.array_distinct(F.transform("work.referenced_works", short_id))).alias("cited_work"))
    return rows.where("cited_work is not null").select(F.concat_ws(":", "citing_work", "cited_work").alias("citation_id"), "citing_work", "cited_work")


def in_frame(df: DataFrame, cites: list[str] | None, venues: list[str] | None, start: int, end: int) -> DataFrame:
    """Works of a frame: those that cite a seed, or of a venue, published in the years. The filters reach the scan of a table source."""
    w = F.col("work")
    rows = df.where(w["publication_year"].between(start, end))
    if cites:
        rows = rows.where(F.arrays_overlap(F.transform(w["referenced_works"], short_id), F.array(*[F.lit(c) for c in cites])))
    if venues:
        rows = rows.where(short_id(w["primary_location"]["source"]["id"]).isin(*venues))
    return rows


def lookup(keys: DataFrame, works_table: DataFrame, on: str) -> DataFrame:
    """Rows of the table under the keys, distinct keys once; the first row of a key by work_id."""
    wanted = keys.select(normalize_doi(F.col(on)).alias(on) if on == "doi" else F.col(on)).where(F.col(on).isNotNull()).distinct()
    met = works_table.join(wanted, on)
    rest = [c for c in works_table.columns if c != on]
    return met.groupBy(on).agg(F.min_by(F.struct(*rest), "work_id").alias("r")).select(on, "r.*") if "work_id" in rest else met


def title_search(works_table: DataFrame, text: str, most: int = 5) -> DataFrame:
    """A drafting aid: works whose title holds a text, most cited first."""
    return works_table.where(F.lower("title").contains(text.lower())).orderBy(F.desc("cited_by_count"), "work_id").limit(most)


def contexts(df: DataFrame, source: str) -> DataFrame:
    """Rows (cited_work, item) of citation answers to context rows."""
    item = F.col("item")
    rows = df.select("cited_work", item.alias("item"), F.posexplode(item["contexts"]).alias("context_index", "text"))
    item = F.col("item")
    return rows.select(
        "cited_work", normalize_doi(F.try_element_at(item["citingPaper"]["externalIds"], F.lit("DOI"))).alias("citing_doi"), item["citingPaper"]["paperId"].alias("citing_s2_id"), "context_index", "text",
        F.array_sort(F.coalesce(item["intents"], F.array().cast("array<string>"))).alias("intents"), F.coalesce(item["isInfluential"], F.lit(False)).alias("is_influential"), F.lit(source).alias("source"),
    )


def cut_listing(offset: Column, n: Column, limit: int, most: int) -> Column:
    """Whether a listing stopped at the offset that a source serves at most."""
    return (n == limit) & (offset + n >= most - 1)


def references(entries: Column) -> Column:
    """Typed references of a reference list; null (unmeasured) where the list is empty."""
    def of(e: Column) -> Column:
        return F.struct(
            normalize_doi(e["DOI"]).alias("doi"), F.nullif(F.regexp_extract(F.coalesce(e["year"], F.lit("")), r"^\s*(\d{4})", 1), F.lit("")).cast("int").alias("year"), blank_to_null(e["volume"]).alias("volume"),
            blank_to_null(e["first-page"]).alias("first_page"), blank_to_null(e["journal-title"]).alias("journal"), blank_to_null(e["article-title"]).alias("article_title"),
            blank_to_null(e["series-title"]).alias("series_title"), blank_to_null(e["volume-title"]).alias("volume_title"), blank_to_null(e["unstructured"]).alias("text"),
        ).cast(REFERENCE)

    return F.when(F.size(entries) > 0, F.transform(entries, of))


def doiless(refs: Column) -> Column:
    """Places of references without a DOI."""
    return F.filter(F.transform(refs, lambda r, i: F.when(r["doi"].isNull(), i)), lambda i: i.isNotNull())


def candidates(items: Column) -> Column:
    def of(c: Column) -> Column:
        return F.struct(
            normalize_doi(c["DOI"]).alias("doi"), c["score"].alias("score"), F.get(F.get(c["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), c["volume"].alias("volume"),
            F.nullif(F.split_part(F.coalesce(c["page"], F.lit("")), F.lit("-"), F.lit(1)), F.lit("")).alias("first_page"), F.get(c["container-title"], F.lit(0)).alias("journal"), F.get(c["title"], F.lit(0)).alias("title"), c["type"].alias("kind"),
        )

    return F.transform(items, of)


def label_rows(results: DataFrame, task: str, subject: str, span: str) -> DataFrame:
    """Label rows of coded items (item_id, work_id, coder_id, rep, value, missing); the span is the task's own field."""
    value = F.col("value")
    return results.select(F.lit(task).alias("task"), F.lit(subject).alias("subject"), "item_id", "work_id", "coder_id", "rep", value["label"].alias("label"), value[span].alias("span"), "missing")
