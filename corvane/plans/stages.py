"""The stages as DataFrame jobs: tables in, declared tables out (STG01-STG07, STG12, GRF09, AGG07).

A stage is a function of DataFrames; reading, writing and the run log are the caller's
(`sources/runs.py`), so stages compose lazily and Catalyst plans across them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import biblio
from corvane.functions.ids import frame_id, name_key, node_key
from corvane.operators import census as cs
from corvane.operators import core, graph, measures, social
from corvane.plans.textual import build_items
from corvane.sources import bibliographic as bib
from corvane.sources.tables import conform


@dataclass(frozen=True)
class Settings:
    """What the stages are run with."""

    start: int = 1990
    end: int = 1999
    window: int = 5
    per_year: int = 20
    per_work: int = 20
    seed: int = 7
    paper_types: tuple[str, ...] = ("article", "journal-article", "proceedings-article")
    year_tolerance: int = 1
    min_score: float = 40.0
    title_share: float = 0.8
    max_unmeasured: float = 0.2
    resolutions: tuple[float, ...] = (0.5, 1.0, 2.0)
    primary: float = 1.0
    least_overlap: float = 0.3
    least_members: int = 5
    m: int = 10
    v: int = 8
    r: float = 0.5
    lag: float = 5.0
    core_works: int = 3
    overlap: float = 0.1


def fetch(case: str, pages: dict[str, tuple[str, DataFrame]], source: str = "openalex") -> dict[str, DataFrame]:
    """S1: works, authors, authorships, citations and frames of listings; ``pages``: frame to (kind, rows with ``work``)."""
    frames = None
    every = None
    for frame, (kind, rows) in pages.items():
        part = bib.works(rows, source).select(F.lit(case).alias("case_id"), F.lit(frame).alias("frame_id"), F.lit(kind).alias("kind"), "work_id", "year")
        frames = part if frames is None else frames.unionByName(part)
        every = rows.select("work") if every is None else every.unionByName(rows.select("work"))
    return {
        "works": conform("works", bib.works(every, source).dropDuplicates(["work_id"])), "authors": conform("authors", bib.authors(every).dropDuplicates(["author_id"])),
        "authorships": conform("authorships", bib.authorships(every).distinct()), "citations": conform("citations", bib.citations(every).distinct()), "frames": conform("frames", frames.distinct()),
    }


def census(case: str, frames: DataFrame, works: DataFrame, references: DataFrame, doi_types: DataFrame, catalogue: DataFrame, candidates: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """S2: coverage and census_sample.

    ``references``: work_id, refs (array of references, null where unmeasured); ``doi_types``: doi, type; ``catalogue``:
    year, volume, first_page, journal of works that references may match; ``candidates``: ref_id, candidates of a query.
    """
    rows = cs.papers_and_excluded(frames, works, list(s.paper_types))
    papers = rows.where("is_paper and not is_undated")
    drawn = core.stratified_sample(papers.select("frame_id", "kind", "year", "work_id"), ["frame_id", "year"], "work_id", s.per_year, s.seed)
    lists = drawn.join(references, "work_id", "left")
    entries = lists.where("refs is not null").select("frame_id", "kind", "year", "work_id", F.posexplode_outer("refs").alias("place", "ref"))
    entries = entries.withColumn("ref_id", F.concat_ws("#", "work_id", F.col("place").cast("string"))).join(doi_types.select(F.col("doi").alias("known_doi"), F.col("type").alias("cited_type")), F.col("ref.doi") == F.col("known_doi"), "left")
    kind = biblio.reference_kind(F.col("ref"))
    status = F.when(F.col("ref").isNotNull(), cs.reference_status(F.col("known_doi").isNotNull(), F.col("ref.doi"), F.col("cited_type"), kind, list(s.paper_types)))
    entries = entries.withColumn("status", status)
    pool = entries.where("status = 'doiless'").select("work_id", "ref_id", "ref")
    sampled = core.stratified_sample(pool, ["work_id"], "ref_id", s.per_work, s.seed)
    matches = cs.match_references(sampled.select("ref_id", "ref"), catalogue, s.year_tolerance)
    rescued = sampled.join(candidates, "ref_id").select("ref_id", biblio.rescue_match(F.col("ref"), F.col("candidates"), s.min_score, s.title_share, s.year_tolerance).isNotNull().alias("rescued"))
    entries = entries.join(sampled.select("ref_id", F.lit(True).alias("sampled")), "ref_id", "left").join(matches, "ref_id", "left").join(rescued, "ref_id", "left")
    # A match found by the query counts as one.
    entries = entries.withColumn("match", F.when(F.coalesce("rescued", F.lit(False)), F.lit(True)).otherwise(F.col("match")))
    done = cs.outcomes(entries, ["frame_id", "kind", "year", "work_id"])
    keys = ["frame_id", "kind", "year"]
    counts = papers.groupBy(*keys).agg(F.count("*").alias("frame_works")).join(drawn.groupBy(*keys).agg(F.count("*").alias("sampled")), keys, "left")
    excluded = rows.where("not is_paper and not is_undated").groupBy(*keys).agg(F.count("*").alias("frame_works_excluded"))
    measured = done.groupBy(*keys).agg(F.count("*").alias("measured"), *[F.sum(c).alias(c) for c in cs.COUNTS])
    sample = drawn.join(done.drop("kind", "year"), ["frame_id", "work_id"], "left").withColumn("status", F.when(F.col("refs").isNull(), "unmeasured").otherwise("measured"))
    named = lambda df: df.withColumn("case_id", F.lit(case))
    return {"coverage": conform("coverage", named(cs.coverage(counts, excluded, measured))), "census_sample": conform("census_sample", named(sample))}


def overlap(subjects: DataFrame, authorships: DataFrame, authors: DataFrame, s: Settings) -> DataFrame:
    """S1-overlap: pairs of subjects by author id where both are indexed, else by name. ``subjects``: subject, kind, work_id."""
    named = authorships.join(authors.select("author_id", name_key(F.col("display_name")).alias("name_key")), "author_id")
    indexed = subjects.where("kind = 'community'").groupBy("subject").agg((~F.bool_or(F.startswith("work_id", F.lit("X:")))).alias("indexed"))
    by = {k: social.overlaps(social.core_authors(subjects, named, k, s.core_works), k, s.overlap).withColumn("basis", F.lit(b)) for k, b in (("author_id", "id"), ("name_key", "name"))}
    a, b = indexed.select(F.col("subject").alias("subject_a"), F.col("indexed").alias("ia")), indexed.select(F.col("subject").alias("subject_b"), F.col("indexed").alias("ib"))
    rows = by["author_id"].unionByName(by["name_key"]).join(a, "subject_a").join(b, "subject_b")
    return conform("overlap", rows.where((F.col("basis") == "id") == (F.col("ia") & F.col("ib"))))


def social_build(works: DataFrame, authorships: DataFrame, authors: DataFrame, citations: DataFrame, frames: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """S3: clusters and lineages. Only own works make nodes and ties where there are own works; authors and citations come from all."""
    own = social.own_works(frames)
    mine = works if own.isEmpty() else works.join(own, "work_id", "left_semi")
    by_name = not works.where(F.startswith("work_id", F.lit("X:"))).isEmpty()
    keys = authors.select("author_id", node_key(F.col("author_id"), F.col("display_name"), by_name).alias("node")).where("node is not null")
    signed = authorships.join(keys, "author_id").select("work_id", F.col("node").alias("author_id"))
    links = citations.select(F.col("citing_work").alias("citing"), F.col("cited_work").alias("cited"))
    windows = core.sub_windows(works.sparkSession, s.start, s.end, s.window, True)
    found = graph.leiden(social.active_authors(mine, signed, windows), social.graph_edges(mine, signed, links, windows), list(s.resolutions), s.seed)
    end = (F.col("window_start") + s.window - 1).alias("window_end")
    clusters = found.select(F.lit("leiden").alias("method"), "resolution", "window_start", end, "cluster", F.col("author_id").alias("author"))
    steps = graph.lineages(found, s.least_overlap, s.least_members).select(F.lit("leiden").alias("method"), "*", end)
    return {"clusters": conform("clusters", clusters), "lineages": conform("lineages", steps)}


def lineage_members(clusters: DataFrame, lineages: DataFrame) -> DataFrame:
    """(resolution, lineage_id, window_start, window_end, author_id)."""
    keys = ["resolution", "window_start", "window_end", "cluster"]
    return lineages.select(*keys, "lineage_id").join(clusters.select(*keys, F.col("author").alias("author_id")), keys).drop("cluster")


def eligibility(clusters: DataFrame, lineages: DataFrame, works: DataFrame, authorships: DataFrame, citations: DataFrame, frames: DataFrame, anchors: DataFrame, events: list[float], coverage: DataFrame, rule: str, s: Settings) -> DataFrame:
    """S4: the checks of every lineage and window, at every resolution. ``coverage``: lineage_id, window_start, coverage."""
    links = citations.select(F.col("citing_work").alias("citing"), F.col("cited_work").alias("cited"))
    seeds = anchors.select("work_id").union(frames.where("kind = 'bearing'").select("work_id")).distinct()
    credited = social.lineage_works(rule, works, authorships, social.own_works(frames))
    bearing = social.bearing(seeds, links)
    members = lineage_members(clusters, lineages)
    rows = None
    for r in s.resolutions:
        mine = members.where(F.col("resolution") == r).drop("resolution")
        part = social.eligibility(social.on_claim(mine, credited, links, bearing), coverage, events, s.m, s.v, s.r, s.lag).withColumn("resolution", F.lit(float(r)))
        rows = part if rows is None else rows.unionByName(part)
    return conform("eligibility", rows)


def cluster_scope(eligible: DataFrame, clusters: DataFrame, lineages: DataFrame, credited: DataFrame, s: Settings) -> DataFrame:
    """S2C: the frames (case rows) that a census of lineages' papers has to cover."""
    needed = social.needed_windows(eligible, s.primary)
    members = lineage_members(clusters, lineages).where(F.abs(F.col("resolution") - s.primary) < 1e-9).select("lineage_id", "window_start", "author_id")
    rows = social.cluster_frames(needed, members, credited)
    return rows.select(frame_id(F.col("lineage_id"), F.col("window_start")).alias("frame_id"), F.lit("community").alias("kind"), "work_id", "year")


def coding_items(contexts: DataFrame, first_authors: DataFrame, positions: DataFrame, dictionaries: list[dict]) -> DataFrame:
    """S8: items from member contexts; ``first_authors``: work_id, family, year; ``positions``: citing_work, cited_work, positions, list_length."""
    rows = contexts.join(first_authors.select(F.col("work_id").alias("cited_work"), "family", "year"), "cited_work", "left").join(positions, ["citing_work", "cited_work"], "left")
    rows = rows.select("cited_work", F.coalesce("citing_doi", "citing_work", F.lit("")).alias("source"), "text", "family", "year", "positions", "list_length")
    items = build_items(rows, dictionaries).where("reason is null")
    return conform("items", items.withColumnRenamed("cited_work", "work_id"))


def pilot(stances: DataFrame, directions: DataFrame, subject: str, side: str) -> DataFrame:
    """S9: shares of stances per coder and direction; ``stances``: coder_id, work_id, label; ``directions``: coder_id, work_id, label."""
    rows = stances.join(directions.select("coder_id", "work_id", F.col("label").alias("direction")), ["coder_id", "work_id"])
    shares = measures.pilot_shares(rows.select(F.col("coder_id").alias("coder"), "direction", F.col("label").alias("stance")))
    return conform("pilot", shares.select(F.lit(subject).alias("subject"), F.lit(side).alias("side"), F.col("coder").alias("coder_id"), "direction", "stance", "share", "items"))
