"""Stages end to end on a small world and on a planted network."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import social
from corvane.plans import simulation, stages
from corvane.sources import bibliographic as bib
from corvane.sources import runs, tables


def work(n, year, venue="S1", cites=(), doi=True, kind="article", authors=("A1",)):
    return {
        "id": f"https://openalex.org/W{n}", "doi": f"https://doi.org/10.1/{n}" if doi else None, "display_name": f"Title {n}", "publication_year": year, "type": kind, "cited_by_count": 1,
        "primary_location": {"source": {"id": f"https://openalex.org/{venue}", "display_name": venue}}, "authorships": [{"author_position": "first", "author": {"id": f"https://openalex.org/{a}", "display_name": f"Ann {a}"}, "institutions": []} for a in authors],
        "referenced_works": [f"https://openalex.org/W{c}" for c in cites],
    }


def pages(spark, works):
    df = spark.createDataFrame([(json.dumps({"results": works}),)], "j string")
    return bib.pages_to_works(df.select(F.from_json("j", bib.PAGE).alias("body")))


def test_fetch_and_census(spark):
    citing = [work(10 + i, 1990 + i % 2, cites=(1,), authors=(f"A{i}", "A1")) for i in range(10)] + [work(2, 1990, cites=(1,))]
    venue = [work(30 + i, 1995, venue="S5", kind="editorial" if i == 3 else "article") for i in range(4)]
    out = stages.fetch("case", {"citing": ("mainstream", pages(spark, citing)), "venue": ("community", pages(spark, venue)), "again": ("bearing", pages(spark, citing[:1]))})
    assert out["works"].count() == 15 and out["citations"].count() == 11
    assert out["frames"].where("frame_id = 'citing'").count() == 11 and out["frames"].count() == 16
    assert {n: df.columns for n, df in out.items()} == {n: [c.split()[0] for c in tables.SCHEMAS[n].split(", ")] for n in out}

    none = {k: None for k in ("doi", "year", "volume", "first_page", "journal", "article_title", "series_title", "volume_title", "text")}
    refs = [none | {"doi": "10.1/1"}, none | {"doi": "10.9/absent"}, none | {"year": 1986, "volume": "56", "first_page": "3", "journal": "Phys. Rev. Lett."}, none | {"year": 1986, "volume": "57", "first_page": "9", "journal": "Nature"}, none | {"text": "A thesis."}]
    names = list(none)
    measured = [(f"W{10 + i}", [tuple(r[k] for k in names) for r in refs]) for i in range(8)] + [("W18", None)]
    from corvane.functions.biblio import REFERENCE

    references = spark.createDataFrame(measured, f"work_id string, refs array<{REFERENCE}>")
    types = spark.createDataFrame([("10.1/1", "article")], "doi string, type string")
    catalogue = spark.createDataFrame([(1986, "56", "3", "Physical Review Letters")], "year int, volume string, first_page string, journal string")
    candidates = spark.createDataFrame([], "ref_id string, candidates array<struct<doi:string,score:double,year:int,volume:string,first_page:string,journal:string,title:string,kind:string>>")
    result = stages.census("case", out["frames"], out["works"], references, types, catalogue, candidates, stages.Settings())
    rows = {(r.frame_id, r.year): r for r in result["coverage"].collect()}
    r = rows["citing", 1991]
    assert (r.frame_works, r.sampled, r.measured, r.unmeasured) == (5, 5, 4, 1)
    assert (r.refs, r.resolved, r.refs_excluded, r.doiless, r.doiless_sampled, r.doiless_matched) == (16, 4, 4, 8, 8, 4) and r.resolved_estimated == 8.0
    assert (rows["venue", 1995].frame_works, rows["venue", 1995].frame_works_excluded, rows["venue", 1995].unmeasured) == (3, 1, 3)
    sample = {r.work_id: (r.status, r.refs) for r in result["census_sample"].where("frame_id = 'citing'").collect()}
    assert sample["W10"] == ("measured", 4) and sample["W18"] == ("unmeasured", None)


def test_social_stages(spark):
    works, signed, cited = simulation.planted_network(spark, 2, 25, range(1990, 1998), 12, 7)
    works = works.select("work_id", "year")
    authors = signed.select("author_id", F.col("author_id").alias("display_name")).distinct()
    links = cited.select(F.col("citing").alias("citing_work"), F.col("cited").alias("cited_work"))
    frames = works.select(F.lit("community").alias("kind"), "work_id", F.lit("f").alias("frame_id"), "year")
    s = stages.Settings(start=1990, end=1997, window=5, resolutions=(1.0,), least_members=5, m=5, v=2)
    out = stages.social_build(works, signed, authors, links, frames, s)
    clusters, lineages = (out[n].cache() for n in ("clusters", "lineages"))
    long = [r for r in lineages.groupBy("lineage_id").agg(F.count("*").alias("n"), F.max("members").alias("m")).collect() if r.n == 4 and r.m >= 20]
    assert len(long) == 2
    anchors = works.where("work_id in ('W1', 'W13')").select("work_id")
    cover = lineages.select("lineage_id", "window_start", F.lit(0.9).alias("coverage")).distinct()
    found = stages.eligibility(clusters, lineages, works, signed, links, frames, anchors, [1991.0], cover, "own_frames_v1", s)
    rows = found.collect()
    assert found.columns == [c.split()[0] for c in tables.SCHEMAS["eligibility"].split(", ")] and rows
    assert any(r.meets_m and r.meets_v and r.meets_r and not r.closed for r in rows)
    scope = stages.cluster_scope(found, clusters, lineages, social.lineage_works("own_frames_v1", works, signed, social.own_works(frames)), s)
    assert scope.count() > 0 and scope.where("not frame_id rlike '^L[0-9]+@[0-9]{4}$'").count() == 0
    subjects = frames.select(F.when(F.col("year") < 1994, "a").otherwise("b").alias("subject"), "kind", "work_id")
    over = stages.overlap(subjects, signed, authors, s).collect()
    assert [(r.subject_a, r.subject_b, r.basis) for r in over] == [("a", "b", "id")] and 0 < over[0].coefficient <= 1


def test_coding_and_pilot(spark):
    text = "The effect that was reported by the earlier group (Lee, 1990) has not been seen in this work."
    contexts = spark.createDataFrame([("C1", "W1", "10.1/c", text)], "citing_work string, cited_work string, citing_doi string, text string")
    first = spark.createDataFrame([("W1", "Lee", 1990)], "work_id string, family string, year int")
    places = spark.createDataFrame([], "citing_work string, cited_work string, positions array<int>, list_length int")
    items = stages.coding_items(contexts, first, places, [{"names": ["group"]}]).collect()
    assert len(items) == 1 and "[CITED]" in items[0].text and "[NAME]" in items[0].text and items[0].work_id == "W1"
    stances = spark.createDataFrame([("c", "W1", "x"), ("c", "W1", "+"), ("c", "W2", "+")], "coder_id string, work_id string, label string")
    ways = spark.createDataFrame([("c", "W1", "against"), ("c", "W2", "for")], "coder_id string, work_id string, label string")
    got = {(r.direction, r.stance): (r.share, r.items) for r in stages.pilot(stances, ways, "s", "p").collect()}
    assert got == {("against", "x"): (0.5, 1), ("against", "+"): (0.5, 1), ("for", "+"): (1.0, 1)}


def test_runs(spark, tmp_path):
    log, root = str(tmp_path / "runs"), str(tmp_path / "derived")
    df = spark.createDataFrame([("W2", "a"), ("W1", "b")], "work_id string, abstract string")
    for fail in (False, True):
        try:
            with runs.Run(spark, log, "s1", "case", "train", {"x": "1", "a": "2"}) as run:
                path = run.store("abstracts", df, root)
                if fail:
                    raise RuntimeError("stop")
        except RuntimeError:
            pass
    every = runs.read_runs(spark, log)
    assert every.count() == 2 and {r.status for r in every.collect()} == {"done", "failed"}
    last = runs.latest_run(every, "s1", "case", "train", {"a": "2", "x": "1"}).collect()
    assert len(last) == 1 and last[0].status == "done" and last[0].outputs[0].rows == 2
    assert runs.latest_run(every, "s1", "case", "train", {"a": "2"}).count() == 0
    assert runs.verify_run(spark, every, last[0].run_id) == [] and runs.recent_runs(every, 1).count() == 1
    assert tables.read_table(spark, "abstracts", path).count() == 2
    (tmp_path / "s.json").write_text('{"start": 1980, "m": 3}')
    assert runs.load_settings(stages.Settings, str(tmp_path / "s.json")).start == 1980
    (tmp_path / "t.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        runs.load_settings(stages.Settings, str(tmp_path / "t.json"))
