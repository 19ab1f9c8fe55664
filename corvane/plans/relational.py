"""Queries over the bound views, each with its SQL: census, social, measures, windows, sets.

The name of each query says what it does; the ids of the operators it covers are in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import biblio
from corvane.operators import census, core, measures, social
from corvane.plans.bind import PAPER_TYPES, Views, counted, sql
from corvane.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, plain: bool = False):
    """Register a function of ``Views``; ``body`` is its SQL over the views (``plain``: over the tables)."""

    def held(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if body:
            ORACLE_SQL[f.__name__] = counted(body if plain else sql(body))
        return f

    return held


# ---- social


EDGES = """--also team AS (SELECT work_id, count(*) AS k FROM authorships GROUP BY work_id),
co AS (SELECT window_start, a.author_id AS src, b.author_id AS dst, 1.0 / (k - 1) AS w FROM authorships a JOIN authorships b ON a.work_id = b.work_id AND a.author_id < b.author_id JOIN team t ON t.work_id = a.work_id JOIN works x ON x.work_id = a.work_id JOIN windows ON year BETWEEN window_start AND window_end),
active AS (SELECT DISTINCT window_start, author_id FROM authorships JOIN works USING (work_id) JOIN windows ON year BETWEEN window_start AND window_end),
ci AS (SELECT w.window_start, least(a.author_id, b.author_id) AS src, greatest(a.author_id, b.author_id) AS dst, 1.0 / (ta.k * tb.k) AS w FROM citations c JOIN works x ON x.work_id = c.citing JOIN windows w ON year BETWEEN w.window_start AND w.window_end JOIN authorships a ON a.work_id = c.citing JOIN authorships b ON b.work_id = c.cited JOIN team ta ON ta.work_id = c.citing JOIN team tb ON tb.work_id = c.cited JOIN active v ON v.window_start = w.window_start AND v.author_id = b.author_id WHERE a.author_id <> b.author_id AND c.citing <> c.cited)
"""


@query(EDGES + "SELECT window_start, src, dst, round(sum(w), 6) AS weight FROM (SELECT * FROM co UNION ALL SELECT * FROM ci) GROUP BY ALL")
def author_graph_edges(v: Views) -> DataFrame:
    """GRF01, WIN04, JOIN02, JOIN10, JOIN11, AGG12, AGG13."""
    edges = social.graph_edges(v.works, v.authorships, v.citations, v.windows)
    return edges.withColumn("weight", F.round("weight", 6))


@query("SELECT DISTINCT window_start, author_id FROM authorships JOIN works USING (work_id) JOIN windows ON year BETWEEN window_start AND window_end")
def author_graph_nodes(v: Views) -> DataFrame:
    """WIN04, FLT07, GRF01."""
    return social.active_authors(v.works, v.authorships, v.windows)


@query("SELECT work_id, list_sort(list(DISTINCT author_id)) AS team FROM authorships GROUP BY work_id")
def authors_by_work(v: Views) -> DataFrame:
    """AGG12."""
    return v.authorships.groupBy("work_id").agg(F.array_sort(F.collect_set("author_id")).alias("team"))


@query("SELECT work_id FROM bearing")
def bearing_set(v: Views) -> DataFrame:
    """JOIN05, SET02."""
    return social.bearing(v.anchors, v.citations)


@query("SELECT work_id FROM bearing UNION SELECT citing FROM citations JOIN bearing ON cited = work_id")
def bearing_two_hop(v: Views) -> DataFrame:
    """JOIN05 applied to the anchors and the bearing frame."""
    return social.bearing(social.bearing(v.anchors, v.citations), v.citations)


@query(
    """--also own AS (SELECT DISTINCT work_id FROM frames WHERE kind <> 'bearing'), sig AS (SELECT DISTINCT author_id FROM authorships JOIN own USING (work_id))
SELECT rule, count(*) AS pairs, count(DISTINCT work_id) AS works FROM (
SELECT 'own' AS rule, work_id, author_id FROM authorships WHERE work_id IN (SELECT work_id FROM own)
UNION ALL SELECT 'member', work_id, author_id FROM authorships WHERE work_id IN (SELECT work_id FROM own) OR author_id IN (SELECT author_id FROM sig)) GROUP BY rule"""
)
def lineage_works_rule(v: Views) -> DataFrame:
    """STG06 lineage_works, FLT02, JOIN16."""
    own, signed = social.own_works(v.frames), v.authorships
    rows = [social.lineage_works(r, v.works, signed, own).select(F.lit(n).alias("rule"), "work_id", "author_id") for n, r in (("own", "own_frames_v1"), ("member", "member_works_v1"))]
    return rows[0].union(rows[1]).groupBy("rule").agg(F.count("*").alias("pairs"), F.countDistinct("work_id").alias("works"))


@query("SELECT cluster, author_id, count(*) AS works FROM (SELECT DISTINCT nation AS cluster, work_id, author_id FROM authorships JOIN authors USING (author_id) JOIN frames USING (work_id) WHERE kind = 'community') GROUP BY ALL HAVING count(*) >= 12".replace("cluster", "subject"))
def core_authors(v: Views) -> DataFrame:
    """AGG10, FLT05, JOIN03."""
    frames = v.frames.where("kind = 'community'").join(v.authorships, "work_id").join(v.authors, "author_id").select(F.col("nation").alias("subject"), "kind", "work_id", "author_id")
    return social.core_authors(frames.select("subject", "kind", "work_id").distinct(), v.authorships.join(v.authors, "author_id").select("work_id", "author_id", F.col("nation").alias("own")), "author_id", 12).join(
        v.authors.select("author_id", "nation"), "author_id"
    ).where("subject = nation").select("subject", "author_id", "works")


@query(
    """--also core AS (SELECT frame_id AS subject, author_id FROM (SELECT DISTINCT frame_id, work_id, author_id FROM frames JOIN authorships USING (work_id) WHERE kind = 'community') GROUP BY ALL HAVING count(*) >= 60),
n AS (SELECT subject, count(*) AS n FROM core GROUP BY subject), s AS (SELECT a.subject AS x, b.subject AS y, count(*) AS shared FROM core a JOIN core b USING (author_id) WHERE a.subject < b.subject GROUP BY ALL)
SELECT p.subject AS subject_a, q.subject AS subject_b, p.n AS authors_a, q.n AS authors_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / least(p.n, q.n), 9) AS coefficient, coalesce(shared, 0) / least(p.n, q.n) > 0.5 AS exceeds
FROM n p JOIN n q ON p.subject < q.subject LEFT JOIN s ON x = p.subject AND y = q.subject"""
)
def overlap_pairs(v: Views) -> DataFrame:
    """JOIN12, AGG10, AGG11, STG04."""
    frames = v.frames.withColumn("subject", F.col("frame_id"))
    found = social.overlaps(social.core_authors(frames, v.authorships, "author_id", 60), "author_id", 0.5)
    return found.select("subject_a", "subject_b", "authors_a", "authors_b", "shared", F.round("coefficient", 9).alias("coefficient"), "exceeds")


@query(
    """--also n AS (SELECT window_start, cluster, count(*) AS n FROM members GROUP BY ALL),
s AS (SELECT a.window_start, a.cluster, b.cluster AS predecessor, count(*) AS k FROM members a JOIN members b ON a.author_id = b.author_id AND b.window_start = a.window_start - 1 GROUP BY ALL),
j AS (SELECT s.*, k / (a.n + b.n - k) AS overlap FROM s JOIN n a USING (window_start, cluster) JOIN n b ON b.window_start = s.window_start - 1 AND b.cluster = predecessor)
SELECT window_start, cluster, predecessor, round(overlap, 9) AS overlap FROM j WHERE overlap >= 0.3 QUALIFY row_number() OVER (PARTITION BY window_start, cluster ORDER BY overlap DESC, predecessor) = 1"""
)
def lineage_argmax_predecessor(v: Views) -> DataFrame:
    """JOIN14, NUM02."""
    return social.predecessors(v.members, 0.3).withColumn("overlap", F.round("overlap", 9))


ELIGIBLE = """--also lm AS (SELECT 'L' || cluster AS lineage_id, window_start, window_end, author_id FROM members),
cites AS (SELECT DISTINCT citing AS work_id, cited FROM citations WHERE citing <> cited AND cited IN (SELECT work_id FROM bearing)),
hit AS (SELECT lineage_id, window_start, count(DISTINCT cited) AS on_claim FROM lm JOIN authorships USING (author_id) JOIN works USING (work_id) JOIN cites USING (work_id) WHERE year BETWEEN window_start AND window_end GROUP BY ALL),
raw AS (SELECT lineage_id, window_start, window_end, count(DISTINCT author_id) AS members, coalesce(max(on_claim), 0) AS citations_on_claim FROM lm LEFT JOIN hit USING (lineage_id, window_start) GROUP BY ALL),
cov AS (SELECT lineage_id, window_start, CASE WHEN CAST(substr(lineage_id, 2) AS INTEGER) % 4 = 0 THEN NULL ELSE CAST(substr(lineage_id, 2) AS INTEGER) / 25.0 END AS coverage FROM raw),
el AS (SELECT r.*, coverage, coalesce(window_start > max(CASE WHEN citations_on_claim >= 8 THEN window_start END) OVER (PARTITION BY lineage_id), false) AS closed, CAST((CASE WHEN 1990.5 + 8 <= window_end + 1 THEN 1 ELSE 0 END) + (CASE WHEN 1991.25 + 8 <= window_end + 1 THEN 1 ELSE 0 END) AS INTEGER) AS disconfirmations, members >= 2 AS meets_m, citations_on_claim >= 8 AS meets_v, coverage >= 0.5 AS meets_r FROM raw r JOIN cov USING (lineage_id, window_start))
"""


def _lineage_members(v: Views) -> DataFrame:
    return v.members.select(F.concat(F.lit("L"), F.col("cluster").cast("string")).alias("lineage_id"), "window_start", "window_end", "author_id")


def _eligible(v: Views) -> DataFrame:
    credited = v.works.join(v.authorships, "work_id").select("work_id", "year", "author_id")
    rows = social.on_claim(_lineage_members(v), credited, v.citations, social.bearing(v.anchors, v.citations))
    number = F.substring("lineage_id", 2, 9).cast("int")
    coverage = rows.select("lineage_id", "window_start", F.when(number % 4 != 0, number / F.lit(25.0)).alias("coverage"))
    return social.eligibility(rows, coverage, [1990.5, 1991.25], 2, 8, 0.5, 8)


@query(ELIGIBLE + "SELECT lineage_id, window_start, window_end, members, citations_on_claim, round(CAST(coverage AS DOUBLE), 9) AS coverage, closed, disconfirmations, meets_m, meets_v, meets_r FROM el")
def eligibility_windows(v: Views) -> DataFrame:
    """AGG14, WIN07, WIN20, JOIN06, JOIN15, STG06."""
    return _eligible(v).withColumn("coverage", F.round("coverage", 9))


@query(ELIGIBLE + "SELECT lineage_id, window_start, window_end FROM el WHERE meets_m AND meets_v AND NOT closed")
def needed_windows(v: Views) -> DataFrame:
    """FLT03."""
    return social.needed_windows(_eligible(v).withColumn("resolution", F.lit(1.0)), 1.0)


@query(ELIGIBLE + "SELECT lineage_id, window_start, window_end FROM el WHERE meets_m AND meets_v AND coalesce(meets_r, false) AND NOT closed")
def eligible_windows(v: Views) -> DataFrame:
    """FLT04."""
    return social.eligible_windows(_eligible(v).withColumn("resolution", F.lit(1.0)), 1.0)


FRAMES = ELIGIBLE + ", fr AS (SELECT DISTINCT lineage_id, window_start, work_id, year FROM lm JOIN authorships USING (author_id) JOIN works USING (work_id) WHERE year BETWEEN window_start AND window_end)"


def _cluster_frames(v: Views) -> DataFrame:
    members = _lineage_members(v)
    credited = v.works.join(v.authorships, "work_id").select("work_id", "year", "author_id")
    return social.cluster_frames(members.select("lineage_id", "window_start", "window_end").distinct(), members.select("lineage_id", "window_start", "author_id"), credited)


@query(FRAMES + " SELECT lineage_id || '@' || window_start AS frame_id, year, count(*) AS works FROM fr GROUP BY ALL")
def cluster_frames(v: Views) -> DataFrame:
    """JOIN06, SCA06, GRF09, AGG01."""
    from corvane.functions.ids import frame_id

    rows = _cluster_frames(v).select(frame_id(F.col("lineage_id"), F.col("window_start")).alias("frame_id"), "year", "work_id")
    return rows.groupBy("frame_id", "year").agg(F.count("*").alias("works"))


@query(FRAMES + " SELECT DISTINCT lineage_id, window_start, citing, c.cited FROM fr JOIN citations c ON citing = fr.work_id WHERE citing <> c.cited AND c.cited IN (SELECT work_id FROM bearing)")
def scope_citations(v: Views) -> DataFrame:
    """JOIN06, SET07, STG02."""
    return social.scope_citations(_cluster_frames(v), v.citations, social.bearing(v.anchors, v.citations))


@query("SELECT window_start, count(DISTINCT cluster) AS clusters, max(n) AS largest FROM (SELECT window_start, cluster, count(*) AS n FROM members GROUP BY ALL) GROUP BY ALL")
def social_summary(v: Views) -> DataFrame:
    """AGG39."""
    sizes = v.members.groupBy("window_start", "cluster").agg(F.count("*").alias("members"))
    rows = social.social_summary(sizes.withColumn("resolution", F.col("window_start")).withColumn("lineage_id", F.col("cluster")))
    return rows.select(F.col("resolution").alias("window_start"), F.col("lineages").alias("clusters"), "largest")


@query("SELECT window_start, cluster, CAST(row_number() OVER (PARTITION BY window_start ORDER BY n DESC, first) - 1 AS INTEGER) AS number FROM (SELECT window_start, cluster, count(*) AS n, min(author_id) AS first FROM members GROUP BY ALL)")
def cluster_numbering(v: Views) -> DataFrame:
    """WIN13."""
    sizes = v.members.groupBy("window_start", "cluster").agg(F.count("*").alias("n"), F.min("author_id").alias("first"))
    return sizes.select("window_start", "cluster", (F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), "first")) - 1).alias("number"))


@query(
    "WITH RECURSIVE down(lineage_id) AS (SELECT 'R0' UNION SELECT p.child FROM down d JOIN (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier) p ON p.parent = d.lineage_id) SELECT lineage_id FROM down",
    plain=True,
)
def lineage_descendants(v: Views) -> DataFrame:
    """GRF03, GRF04."""
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    parents = link(v.t("nation"), "N", "n_nationkey", "R", "n_regionkey").union(link(v.t("supplier"), "S", "s_suppkey", "N", "s_nationkey"))
    return social.descendants(parents, "R0")


# ---- census


REFS = """--also refs AS (SELECT l_orderkey AS work_id, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS doi, p_type AS cited_type, p_partkey IS NOT NULL AS known, CASE WHEN l_linestatus = 'F' THEN 'paper' WHEN l_quantity < 25 THEN 'excluded' ELSE 'unclassifiable' END AS kind, l_linenumber <= 4 AS sampled, CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity < 30 END AS match, l_tax = 0 AS rescued FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 40),
st AS (SELECT *, CASE WHEN doi IS NOT NULL AND NOT known THEN 'unresolved' WHEN doi IS NOT NULL THEN CASE WHEN coalesce(cited_type IN ('PROMO', 'LARGE', 'SMALL'), false) THEN 'resolved' ELSE 'excluded' END WHEN kind = 'paper' THEN 'doiless' ELSE kind END AS status FROM refs),
oc AS (SELECT work_id, count_if(status IN ('resolved', 'unresolved', 'doiless')) AS refs, count_if(status = 'resolved') AS resolved, count_if(status = 'excluded') AS refs_excluded, count_if(status = 'unclassifiable') AS refs_unclassifiable, count_if(status = 'doiless') AS doiless, count_if(status = 'doiless' AND sampled) AS doiless_sampled, count_if(status = 'doiless' AND sampled AND coalesce(match, false)) AS doiless_matched, count_if(status = 'doiless' AND sampled AND rescued) AS doiless_rescued, count_if(status = 'doiless' AND sampled AND match IS NULL) AS doiless_unparseable FROM st GROUP BY work_id),
fw AS (SELECT f.frame_id, f.kind, f.work_id, f.year, coalesce(type IN ('F', 'O'), false) AS is_paper FROM frames f LEFT JOIN works w USING (work_id) WHERE kind <> 'bearing'),
pap AS (SELECT frame_id, kind, year, count(*) AS frame_works, count_if(work_id % 3 = 0) AS sampled FROM fw WHERE is_paper GROUP BY ALL),
exc AS (SELECT frame_id, kind, year, count(*) AS frame_works_excluded FROM fw WHERE NOT is_paper GROUP BY ALL),
mea AS (SELECT frame_id, kind, year, count(*) AS measured, sum(refs) AS refs, sum(resolved) AS resolved, sum(refs_excluded) AS refs_excluded, sum(refs_unclassifiable) AS refs_unclassifiable, sum(doiless) AS doiless, sum(doiless_sampled) AS doiless_sampled, sum(doiless_matched) AS doiless_matched, sum(doiless_rescued) AS doiless_rescued, sum(doiless_unparseable) AS doiless_unparseable FROM fw JOIN oc USING (work_id) WHERE is_paper AND work_id % 3 = 0 GROUP BY ALL),
cv AS (SELECT frame_id, kind, year, CAST(coalesce(frame_works, 0) AS BIGINT) AS frame_works, CAST(coalesce(frame_works_excluded, 0) AS BIGINT) AS frame_works_excluded, CAST(coalesce(sampled, 0) AS BIGINT) AS sampled, CAST(coalesce(measured, 0) AS BIGINT) AS measured, CAST(coalesce(refs, 0) AS BIGINT) AS refs, CAST(coalesce(resolved, 0) AS BIGINT) AS resolved, CAST(coalesce(refs_excluded, 0) AS BIGINT) AS refs_excluded, CAST(coalesce(refs_unclassifiable, 0) AS BIGINT) AS refs_unclassifiable, CAST(coalesce(doiless, 0) AS BIGINT) AS doiless, CAST(coalesce(doiless_sampled, 0) AS BIGINT) AS doiless_sampled, CAST(coalesce(doiless_matched, 0) AS BIGINT) AS doiless_matched, CAST(coalesce(doiless_rescued, 0) AS BIGINT) AS doiless_rescued, CAST(coalesce(doiless_unparseable, 0) AS BIGINT) AS doiless_unparseable,
CAST(coalesce(sampled, 0) - coalesce(measured, 0) AS BIGINT) AS unmeasured, CAST(round(coalesce(resolved, 0) + coalesce(doiless, 0) * coalesce(CAST(doiless_matched AS DOUBLE) / nullif(doiless_sampled, 0), 0), 6) AS DOUBLE) AS resolved_estimated FROM pap FULL JOIN exc USING (frame_id, kind, year) LEFT JOIN mea USING (frame_id, kind, year)),
su AS (SELECT frame_id, kind, sum(unmeasured)::DOUBLE / nullif(sum(sampled), 0) AS unmeasured_share, sum(resolved_estimated) / nullif(sum(refs), 0) AS coverage, CAST(sum(frame_works) AS BIGINT) AS frame_works, CAST(sum(sampled) AS BIGINT) AS sampled, CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(unmeasured) AS BIGINT) AS unmeasured, CAST(sum(refs) AS BIGINT) AS refs FROM cv GROUP BY ALL)
"""


def _references(v: Views) -> DataFrame:
    parts = v.t("part").where("p_size < 40").select("p_partkey", "p_type")
    rows = v.t("lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"), "left")
    kind = F.when(F.col("l_linestatus") == "F", "paper").when(F.col("l_quantity") < 25, "excluded").otherwise("unclassifiable")
    doi = F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))
    status = census.reference_status(F.col("p_partkey").isNotNull(), doi, F.col("p_type"), kind, ["PROMO", "LARGE", "SMALL"])
    return rows.select(
        F.col("l_orderkey").alias("work_id"), status.alias("status"), (F.col("l_linenumber") <= 4).alias("sampled"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity") < 30).alias("match"), (F.col("l_tax") == 0).alias("rescued")
    )


def _coverage(v: Views) -> DataFrame:
    rows = census.papers_and_excluded(v.frames, v.works, PAPER_TYPES)
    keys = ["frame_id", "kind", "year"]
    papers = rows.where("is_paper")
    drawn = papers.where("work_id % 3 = 0")
    counts = papers.groupBy(*keys).agg(F.count("*").alias("frame_works"), F.count_if(F.col("work_id") % 3 == 0).alias("sampled"))
    excluded = rows.where("not is_paper").groupBy(*keys).agg(F.count("*").alias("frame_works_excluded"))
    done = drawn.join(census.outcomes(_references(v), ["work_id"]), "work_id")
    measured = done.groupBy(*keys).agg(F.count("*").alias("measured"), *[F.sum(c).alias(c) for c in census.COUNTS])
    return census.coverage(counts, excluded, measured)


@query(REFS + "SELECT * FROM oc")
def reference_outcomes(v: Views) -> DataFrame:
    """JOIN19, AGG04."""
    return census.outcomes(_references(v), ["work_id"])


@query(REFS + "SELECT * FROM cv")
def coverage_by_year(v: Views) -> DataFrame:
    """AGG05, AGG07, FLT01, JOIN01, STG03."""
    return _coverage(v)


@query(REFS + "SELECT frame_id, kind, frame_works, sampled, measured, unmeasured, refs, round(coverage, 9) AS coverage, round(unmeasured_share, 9) AS unmeasured_share, coverage IS NOT NULL AND coalesce(unmeasured_share <= 0.2, false) AS measurable FROM su")
def coverage_summary(v: Views) -> DataFrame:
    """AGG06."""
    rows = census.summary(_coverage(v), ["frame_id", "kind"], 0.2)
    return rows.select("frame_id", "kind", "frame_works", "sampled", "measured", "unmeasured", "refs", F.round("coverage", 9).alias("coverage"), F.round("unmeasured_share", 9).alias("unmeasured_share"), "measurable")


@query(REFS + "SELECT frame_id, round(min(resolved_estimated), 6) AS least, round(list_sort(list(resolved_estimated))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 6) AS upper_median, round(max(resolved_estimated), 6) AS most FROM cv GROUP BY frame_id")
def coverage_extremes(v: Views) -> DataFrame:
    """AGG08."""
    x = F.col("resolved_estimated")
    return _coverage(v).groupBy("frame_id").agg(F.round(F.min(x), 6).alias("least"), F.round(census.upper_median(x), 6).alias("upper_median"), F.round(F.max(x), 6).alias("most"))


@query(REFS + "SELECT frame_id, year, round(resolved_estimated / nullif(refs, 0), 9) AS coverage FROM cv ORDER BY resolved_estimated / nullif(refs, 0) NULLS LAST, frame_id, year LIMIT 10")
def lowest_coverage(v: Views) -> DataFrame:
    """AGG09, SRT01: the limit is the report's own."""
    rows = _coverage(v).withColumn("coverage", F.try_divide(F.col("resolved_estimated"), F.col("refs").cast("double")))
    return census.lowest(rows, "coverage", 10, ["frame_id", "year"]).select("frame_id", "year", F.round("coverage", 9).alias("coverage"))


@query(REFS + "SELECT frame_id, year, count(*) AS works, count_if(is_paper) AS papers, count_if(NOT is_paper) AS others FROM fw GROUP BY ALL")
def frame_papers_and_excluded(v: Views) -> DataFrame:
    """FLT01, JOIN01, AGG01."""
    rows = census.papers_and_excluded(v.frames, v.works, PAPER_TYPES)
    return rows.groupBy("frame_id", "year").agg(F.count("*").alias("works"), F.count_if("is_paper").alias("papers"), F.count_if(~F.col("is_paper")).alias("others"))


@query("SELECT frame_id, year, work_id FROM frames QUALIFY row_number() OVER (PARTITION BY frame_id, year ORDER BY sha256(concat_ws(':', '7', frame_id, CAST(year AS VARCHAR), CAST(work_id AS VARCHAR))), work_id) <= 20")
def census_sample(v: Views) -> DataFrame:
    """WIN14 by hashed ranks: the size of a stratum's sample is the feature."""
    return core.stratified_sample(v.frames.select("frame_id", "year", "work_id"), ["frame_id", "year"], "work_id", 20, 7)


@query("SELECT frame_id, year, CAST(least(count(*), 20) AS BIGINT) AS drawn FROM frames GROUP BY ALL")
def census_sample_exact(v: Views) -> DataFrame:
    """WIN14 by numpy's seeded choice; sizes are compared, the draw itself is tested."""
    rows = v.frames.select("frame_id", "year", F.col("work_id").cast("string").alias("work_id"))
    return core.exact_sample(rows, "case", 20, 7).groupBy("frame_id", "year").agg(F.count("*").alias("drawn"))


@query("SELECT work_id, l_linenumber FROM (SELECT DISTINCT l_orderkey AS work_id, l_linenumber FROM lineitem WHERE l_returnflag = 'N') QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY sha256(concat_ws(':', '7', CAST(work_id AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_linenumber) <= 2")
def reference_sample(v: Views) -> DataFrame:
    """WIN15."""
    pool = v.t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("work_id"), "l_linenumber").distinct()
    return core.stratified_sample(pool, ["work_id"], "l_linenumber", 2, 7)


@query("SELECT doc_id FROM documents ORDER BY sha256(concat_ws(':', '5', CAST(doc_id AS VARCHAR))), doc_id LIMIT 40", plain=True)
def audit_draw(v: Views) -> DataFrame:
    """WIN16: a seeded draw of a stated size over all."""
    draw = F.sha2(F.concat_ws(":", F.lit("5"), F.col("doc_id").cast("string")), 256)
    return v.t("documents").select("doc_id").orderBy(draw, "doc_id").limit(40)


@query("SELECT CASE WHEN value IS NULL THEN 'undated' ELSE CAST(CAST(floor(value / 10) * 10 AS INTEGER) AS VARCHAR) || 's' END AS decade, count(*) AS n, count_if(event_type = 'view') AS with_context FROM events GROUP BY ALL", plain=True)
def decade_context_share(v: Views) -> DataFrame:
    """AGG02."""
    rows = v.t("events").select(census.decade(F.col("value").cast("double")).alias("decade"), "event_type")
    rows = rows.withColumn("decade", F.regexp_replace("decade", r"\.0", ""))
    return rows.groupBy("decade").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("with_context"))


@query(
    """--also p AS (SELECT CAST(year // 10 * 10 AS VARCHAR) || 's' AS decade, type, venue FROM works)
SELECT slice, count(*) AS works, count_if(type = 'P') AS open_works FROM (SELECT decade AS slice, type FROM p UNION ALL SELECT 'all', type FROM p UNION ALL SELECT 'own venues', type FROM p WHERE venue = '1-URGENT') GROUP BY slice"""
)
def overlapping_groups(v: Views) -> DataFrame:
    """AGG03: one pass, each row under all of its slices."""
    decade = F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s"))
    slices = F.array_compact(F.array(decade, F.lit("all"), F.when(F.col("venue") == "1-URGENT", F.lit("own venues"))))
    return v.works.select(F.explode(slices).alias("slice"), "type").groupBy("slice").agg(F.count("*").alias("works"), F.count_if(F.col("type") == "P").alias("open_works"))


@query(
    """WITH n AS (SELECT a.p_partkey AS ref, count(b.p_partkey) AS candidates FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 1 GROUP BY ALL),
c AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS class FROM part WHERE p_partkey IS NOT NULL GROUP BY ALL),
l AS (SELECT a.p_partkey AS ref, coalesce(min(class) FILTER (c.p_size = a.p_size), a.p_partkey) AS class_id, coalesce(list_sort(list(DISTINCT class) FILTER (class IS NOT NULL)), []) AS links FROM part a LEFT JOIN c ON a.p_brand = c.p_brand AND a.p_type = c.p_type AND abs(a.p_size - c.p_size) <= 1 GROUP BY a.p_partkey)
SELECT n.ref, candidates, class_id, links FROM n JOIN l ON n.ref IS NOT DISTINCT FROM l.ref""",
    plain=True,
)
def biblio_range_match(v: Views) -> DataFrame:
    """JOIN07, SRC13: the number of candidates, and which they are: the parts of all classes in ``links``.

    Parts of equal brand, type and size are one class, called by its smallest key; one without any of these is alone and has no links.
    """
    parts = v.t("part").select("p_partkey", "p_brand", "p_type", "p_size")
    found = census.range_counts(parts, parts, ["p_brand", "p_type"], "p_size", 1, "p_partkey").groupBy(F.col("p_partkey").alias("ref"))
    links = F.array_sort(F.array_distinct(F.flatten(F.collect_set("links"))))
    return found.agg(F.sum("candidates").alias("candidates"), F.min("class_id").alias("class_id"), links.alias("links")).withColumn("class_id", F.coalesce("class_id", "ref"))


@query("SELECT DISTINCT a.l_orderkey AS work_id FROM lineitem a JOIN part p ON a.l_linenumber = p.p_size AND abs(year(a.l_shipdate) - 1995) <= 1 AND starts_with(p.p_name, 'red')", plain=True)
def catalogue_semi_match(v: Views) -> DataFrame:
    """JOIN08: references that a catalogue lists, by volume, then year, journal and the author that the text opens with."""
    line = v.t("lineitem")
    known = {"year": F.year("l_shipdate"), "volume": F.col("l_linenumber").cast("string"), "journal": F.lit("Annals of Red Parts"), "text": F.concat(F.lit("Redson, A. "), F.col("l_orderkey").cast("string"))}
    kinds = dict(x.split(":", 1) for x in biblio.REFERENCE.removeprefix("struct<").removesuffix(">").split(","))
    ref = F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    listed = v.t("part").where(F.startswith("p_name", F.lit("red"))).select(F.col("p_size").cast("string").alias("volume")).distinct()
    entries = listed.select("volume", F.array(F.lit("Annals of Red Parts")).alias("aliases"), F.lit(1995).alias("year"), F.lit(None).cast("string").alias("first_page"), F.lit("redson").alias("first_author"))
    return census.catalogue_matches(line.select(F.col("l_orderkey").alias("ref_id"), ref.alias("ref")), entries, 1).select(F.col("ref_id").alias("work_id"))


# ---- measures


RES = """--also r AS (SELECT l_suppkey AS community, l_orderkey * 10 + l_linenumber AS result_id, CASE l_returnflag WHEN 'A' THEN 'p' ELSE 'not_p' END AS supports, l_extendedprice AS prominence, l_linestatus = 'F' AS cited, CASE WHEN l_quantity < 15 THEN 'discount' WHEN l_quantity < 35 THEN 'support' ELSE 'none' END AS stance, 'F' || (l_partkey % 4) AS filter_used FROM lineitem)
"""


def _results(v: Views) -> DataFrame:
    q = F.col("l_quantity")
    return v.t("lineitem").select(
        F.col("l_suppkey").alias("community"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.when(F.col("l_returnflag") == "A", "p").otherwise("not_p").alias("supports"),
        F.col("l_extendedprice").alias("prominence"), (F.col("l_linestatus") == "F").alias("cited"), F.when(q < 15, "discount").when(q < 35, "support").otherwise("none").alias("stance"), F.concat(F.lit("F"), (F.col("l_partkey") % 4).cast("string")).alias("filter_used"),
    )


DELTA = (
    RES
    + """, f AS (SELECT * FROM (VALUES ('F0', true), ('F1', true), ('F2', false)) t(filter_id, checkable)),
c AS (SELECT r.*, filter_id, checkable, CASE WHEN (result_id + length(filter_id) + CAST(substr(filter_id, 2) AS INTEGER)) % 3 <> 0 THEN 'yes' ELSE 'no' END AS applies, stance = 'discount' AND filter_used = filter_id AS disc FROM r, f WHERE cited),
g AS (SELECT community, filter_id, checkable, count_if(supports <> 'p' AND applies = 'yes') AS a, count_if(supports = 'p' AND applies = 'yes') AS b, count_if(supports <> 'p' AND applies = 'yes' AND disc) AS ah, count_if(supports = 'p' AND applies = 'yes' AND disc) AS bh, count_if(supports <> 'p') AS u, count_if(supports <> 'p' AND disc) AS uh, count_if(supports = 'p' AND NOT checkable AND disc) AS fu FROM c GROUP BY ALL),
h AS (SELECT *, CASE WHEN checkable THEN CASE WHEN a > 0 AND b > 0 THEN a + b END WHEN u > 0 THEN u END AS w FROM g)
"""
)


def _cited_filters(v: Views) -> tuple[DataFrame, DataFrame]:
    filters = v.spark.sql("SELECT * FROM VALUES ('F0', true), ('F1', true), ('F2', false) AS t(filter_id, checkable)")
    rows = _results(v).where("cited").crossJoin(F.broadcast(filters.select("filter_id")))
    applies = F.when((F.col("result_id") + F.length("filter_id") + F.substring("filter_id", 2, 1).cast("int")) % 3 != 0, "yes").otherwise("no")
    return rows.withColumn("applies", applies).withColumn("discounted", (F.col("stance") == "discount") & (F.col("filter_used") == F.col("filter_id"))), filters


@query(DELTA + "SELECT community, round(sum(CASE WHEN w IS NULL THEN NULL WHEN checkable THEN (ah / nullif(a, 0) - bh / nullif(b, 0)) * w ELSE CAST(uh AS DOUBLE) END) / sum(w), 9) AS delta FROM h GROUP BY community")
def delta_by_reason(v: Views) -> DataFrame:
    """AGG17."""
    cited, filters = _cited_filters(v)
    return measures.delta(cited, filters, ["community"], "p").withColumn("delta", F.round("delta", 9))


@query(DELTA + "SELECT community, CAST(sum(fu) AS BIGINT) AS uses FROM h GROUP BY community")
def uncheckable_uses(v: Views) -> DataFrame:
    """AGG18."""
    cited, filters = _cited_filters(v)
    return measures.uncheckable_uses(cited, filters, ["community"], "p")


OMEGA = RES + ", s AS (SELECT *, least(CAST(floor((row_number() OVER (PARTITION BY community ORDER BY prominence, result_id) - 1) * 5 / count(*) OVER (PARTITION BY community)) AS BIGINT), 4) AS stratum FROM r)"


@query(OMEGA + " SELECT community, round(avg(d), 9) AS omega FROM (SELECT community, stratum, avg(CASE WHEN supports = 'p' THEN CAST(cited AS INTEGER) END) - avg(CASE WHEN supports <> 'p' THEN CAST(cited AS INTEGER) END) AS d FROM s GROUP BY ALL) GROUP BY community")
def omega_by_strata(v: Views) -> DataFrame:
    """AGG19, WIN03, WIN12."""
    return measures.omega(_results(v), ["community"], "p", 5).withColumn("omega", F.round("omega", 9))


@query(OMEGA + " SELECT community, CAST(stratum AS BIGINT) AS stratum, count(*) AS n FROM s GROUP BY ALL")
def prominence_strata(v: Views) -> DataFrame:
    """WIN03: floor-rank strata, not ntile."""
    placed = _results(v).withColumn("stratum", measures.stratum(["community"], 5, ["prominence", "result_id"]).cast("long"))
    return placed.groupBy("community", "stratum").agg(F.count("*").alias("n"))


@query(RES + ", c AS (SELECT community, count_if((stance = 'support' AND supports = 'p') OR (stance = 'discount' AND supports = 'not_p')) AS p, count_if((stance = 'support' AND supports = 'not_p') OR (stance = 'discount' AND supports = 'p')) AS not_p FROM r WHERE cited GROUP BY community) SELECT community, p, not_p, CASE WHEN p = not_p THEN 'both' WHEN p > not_p THEN 'p' ELSE 'not_p' END AS side FROM c")
def favoured_side(v: Views) -> DataFrame:
    """AGG20, NUM06."""
    return measures.favoured_side(_results(v), ["community"])


@query("SELECT l_suppkey AS community, round(b, 9) AS after_breaks, round(o, 9) AS baseline, round(b / nullif(o, 0), 9) AS tau FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity - l_linenumber END) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS b, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity - l_linenumber END) / nullif(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0) AS o FROM lineitem GROUP BY l_suppkey)", plain=True)
def tie_retention(v: Views) -> DataFrame:
    """AGG21."""
    rows = v.t("lineitem").select(F.col("l_suppkey").alias("community"), (F.col("l_quantity") - F.col("l_linenumber")).alias("kept"), F.col("l_quantity").alias("before"), (F.col("l_returnflag") == "R").alias("is_break"))
    return measures.tie_retention(rows, ["community"]).select("community", *[F.round(c, 9).alias(c) for c in ("after_breaks", "baseline", "tau")])


@query("SELECT l_suppkey AS community, round(avg(CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_linestatus = 'F' AS INTEGER) END), 9) AS honoured FROM lineitem GROUP BY ALL", plain=True)
def honoured_share(v: Views) -> DataFrame:
    """AGG22."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F")
    return v.t("lineitem").groupBy(F.col("l_suppkey").alias("community")).agg(F.round(measures.honoured_share(flag), 9).alias("honoured"))


@query("SELECT l_suppkey AS community, round(CASE WHEN l_suppkey % 10 / 10.0 >= 0.5 THEN count_if(l_returnflag = 'A') / count(*) END, 9) AS chi FROM lineitem GROUP BY l_suppkey", plain=True)
def engagement(v: Views) -> DataFrame:
    """AGG23."""
    rows = v.t("lineitem").groupBy(F.col("l_suppkey").alias("community")).agg(F.count_if(F.col("l_returnflag") == "A").alias("out"), F.count("*").alias("total"))
    return rows.select("community", F.round(measures.engagement(F.col("out"), F.col("total"), F.col("community") % 10 / F.lit(10.0), 0.5), 9).alias("chi"))


CODES = """--also fc AS (SELECT user_id, ts, event_id, at_risk, CASE WHEN code = 'B' THEN CASE CAST(floor(value) AS INTEGER) % 4 WHEN 0 THEN 'B_RESOLVED' WHEN 1 THEN 'B_TO_C' WHEN 2 THEN CASE WHEN 2000 - (1980 + CAST(floor(value) AS INTEGER) % 30) >= 10 THEN 'B_TO_C' ELSE 'B_OPEN' END END ELSE code END AS code FROM ledger)
"""


def _codes(v: Views) -> DataFrame:
    from corvane.functions.decision import final_code

    kind = F.floor("value").cast("int") % 4
    outcome = F.when(kind == 0, "success").when(kind == 1, "fail_no_debit").otherwise("open")
    opened = (1980 + F.floor("value").cast("int") % 30).cast("double")
    named = F.when(kind != 3, F.lit(True))
    code = final_code(F.col("code"), outcome, named, opened, F.lit(None).cast("double"), F.lit(2000.0), 10, "exclude")
    return v.ledger.select("user_id", "ts", "event_id", "at_risk", F.when(F.col("code").isNotNull(), code).alias("code"))


@query(CODES + "SELECT event_id, code FROM fc")
def final_codes(v: Views) -> DataFrame:
    """NUM03."""
    return _codes(v).select("event_id", "code")


@query(CODES + "SELECT user_id, round(avg(CASE WHEN code IS NOT NULL THEN CAST(code IN ('C', 'D', 'B_TO_C') AS INTEGER) END), 9) AS share FROM fc GROUP BY user_id")
def insulating_share(v: Views) -> DataFrame:
    """AGG24."""
    return _codes(v).groupBy("user_id").agg(F.round(measures.insulating_share(F.col("code")), 9).alias("share"))


@query(
    CODES
    + """, k AS (SELECT *, coalesce(code IN ('C', 'D', 'B_TO_C'), false) AND NOT at_risk AS ins FROM fc WHERE code IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN ins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT user_id, max(n) AS loop_length FROM (SELECT user_id, island, count_if(ins) AS n FROM i GROUP BY ALL) GROUP BY user_id"""
)
def loop_length(v: Views) -> DataFrame:
    """WIN08."""
    return measures.loop_length(_codes(v), ["user_id"], ["ts", "event_id"])


TRAJ = "--also d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM ledger GROUP BY ALL)"


@query(TRAJ + " SELECT user_id, day, n, coalesce(max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 9 AND max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 9, false) AS closed FROM d")
def trajectory_closed(v: Views) -> DataFrame:
    """WIN06."""
    days = v.ledger.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("closed", social.trajectory_closed(F.col("n"), 9, ["user_id"], "day"))


@query("SELECT lang AS item, quality AS label, n FROM (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, quality) = 1", plain=True)
def majority_label(v: Views) -> DataFrame:
    """AGG15."""
    votes = v.t("documents").join(v.t("labels"), "doc_id").select(F.col("lang").alias("item"), F.col("quality").alias("label"))
    return measures.majority(votes, ["item"], "label")


@query("SELECT source AS item, quality AS label, round(n, 6) AS n FROM (SELECT source, quality, sum(CASE lang WHEN 'en' THEN 0.5::DOUBLE ELSE 1.25::DOUBLE END) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, quality) = 1", plain=True)
def weighted_majority(v: Views) -> DataFrame:
    """AGG16."""
    votes = v.t("documents").join(v.t("labels"), "doc_id").select(F.col("source").alias("item"), F.col("quality").alias("label"), "lang")
    rows = measures.majority(votes, ["item"], "label", F.when(F.col("lang") == "en", 0.5).otherwise(1.25))
    return rows.withColumn("n", F.round("n", 6))


CODERS = "WITH b AS (SELECT doc_id AS item, 'A' AS coder, quality AS label FROM labels UNION ALL SELECT doc_id, 'B', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'C', CAST(doc_id % 2 AS INTEGER) FROM labels WHERE doc_id % 3 = 0) "


def _coders(v: Views) -> DataFrame:
    rows = v.t("labels")
    a = rows.select(F.col("doc_id").alias("item"), F.lit("A").alias("coder"), F.col("quality").alias("label"))
    b = rows.select("doc_id", F.lit("B"), 1 - F.col("toxic"))
    c = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("C"), (F.col("doc_id") % 2).cast("int"))
    return a.union(b).union(c)


@query(CODERS + "SELECT round(avg(r), 9) AS disagreement FROM (SELECT item, avg(CAST(x.label <> y.label AS INTEGER)) AS r FROM b x JOIN b y USING (item) WHERE x.coder < y.coder GROUP BY item)", plain=True)
def observed_disagreement(v: Views) -> DataFrame:
    """AGG25."""
    return measures.disagreement(_coders(v), "item", "coder", "label").withColumn("disagreement", F.round("disagreement", 9))


@query(
    CODERS
    + """, p AS (SELECT x.coder AS coder_a, y.coder AS coder_b, count(*) AS items, avg(CAST((x.label = 1) = (y.label = 1) AS INTEGER)) AS o, avg(CAST(x.label = 1 AS INTEGER)) AS share_a, avg(CAST(y.label = 1 AS INTEGER)) AS share_b FROM b x JOIN b y USING (item) WHERE x.coder < y.coder GROUP BY ALL),
e AS (SELECT *, share_a * share_b + (1 - share_a) * (1 - share_b) AS ex FROM p) SELECT coder_a, coder_b, items, round(CASE WHEN ex = 1 THEN 1.0 ELSE (o - ex) / (1 - ex) END, 9) AS kappa, round(share_a, 9) AS share_a, round(share_b, 9) AS share_b FROM e""",
    plain=True,
)
def cohens_kappa(v: Views) -> DataFrame:
    """AGG26, SET05."""
    rows = measures.kappa(_coders(v), "item", "coder", F.col("label") == 1)
    return rows.select("coder_a", "coder_b", "items", *[F.round(c, 9).alias(c) for c in ("kappa", "share_a", "share_b")])


RETEST = "WITH l AS (SELECT doc_id AS item, lang AS coder, doc_id % 2 AS rep, quality AS label FROM documents JOIN labels USING (doc_id)), q AS (SELECT item // 2 AS item, coder, rep, CAST(label AS VARCHAR) AS label FROM l), pr AS (SELECT coder, item, max(CASE WHEN rep = 0 THEN label END) AS a, max(CASE WHEN rep = 1 THEN label END) AS b FROM q GROUP BY ALL) "


def _reps(v: Views) -> DataFrame:
    rows = v.t("documents").join(v.t("labels"), "doc_id")
    return rows.select(F.expr("doc_id div 2").alias("item"), F.col("lang").alias("coder"), (F.col("doc_id") % 2).alias("rep"), F.col("quality").cast("string").alias("label"))


@query(RETEST + "SELECT coder, count(*) AS pairs, count_if(a <> b) AS changed, round(count_if(a <> b) / count(*), 9) AS share FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY coder", plain=True)
def retest_share(v: Views) -> DataFrame:
    """JOIN17."""
    return measures.retest(_reps(v), "coder", "item", "rep", "label").withColumn("share", F.round("share", 9))


@query(
    RETEST
    + """, x AS (SELECT coder, item, CASE a WHEN '1' THEN 'x' ELSE '+' END AS a, CASE b WHEN '1' THEN 'x' ELSE '-' END AS b, item % 2 = 0 AS pseudo FROM pr WHERE a IS NOT NULL AND b IS NOT NULL),
y AS (SELECT *, CASE WHEN pseudo THEN a ELSE b END AS ap, CASE WHEN pseudo THEN b ELSE a END AS asc_ FROM x), r AS (SELECT coder, count_if(a <> b) / count(*) AS rs FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY coder)
SELECT coder, count(*) AS pairs, count_if(a <> b) AS changed, count_if(ap = 'x' AND asc_ <> 'x') AS more_x, count_if(asc_ = 'x' AND ap <> 'x') AS fewer_x, round(max(rs), 9) AS retest_share, round(count_if(a <> b) / count(*), 9) AS share, round(count_if(a <> b) / count(*) - max(rs), 9) AS excess, count_if(a <> b) / count(*) - max(rs) <= 0.1 AS passes FROM y JOIN r USING (coder) GROUP BY coder""",
    plain=True,
)
def symmetry_audit(v: Views) -> DataFrame:
    """AGG27."""
    reps = _reps(v)
    marks = reps.select("coder", F.col("item").alias("pair_id"), F.when(F.col("rep") == 0, "true").otherwise("swapped").alias("version"), F.when(F.col("label") == "1", "x").when(F.col("rep") == 0, "+").otherwise("-").alias("label"))
    sides = reps.select(F.col("item").alias("pair_id")).distinct().withColumn("side", F.when(F.col("pair_id") % 2 == 0, "pseudoscience").otherwise("science"))
    rows = measures.symmetry(marks, sides, measures.retest(reps, "coder", "item", "rep", "label"), 0.1)
    return rows.select("coder", "pairs", "changed", "more_x", "fewer_x", *[F.round(c, 9).alias(c) for c in ("retest_share", "share", "excess")], "passes")


LEAK = "WITH g AS (SELECT source AS coder, lang AS actual, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE lang END AS guess FROM documents) "


def _guesses(v: Views) -> DataFrame:
    k = F.col("doc_id") % 7
    return v.t("documents").select(F.col("source").alias("coder"), F.col("lang").alias("actual"), F.when(k == 1, "en").when(k == 2, "fr").when(k != 0, F.col("lang")).alias("guess"))


@query(LEAK + "SELECT coder, count(guess) AS answered, count(*) - count(guess) AS missing, round(avg(CASE WHEN guess IS NOT NULL THEN CAST(guess = actual AS INTEGER) END), 9) AS accuracy FROM g GROUP BY coder", plain=True)
def leakage_accuracy(v: Views) -> DataFrame:
    """AGG28; points above chance are tested."""
    return measures.leakage(_guesses(v), 4, 40.0).select("coder", "answered", "missing", F.round("accuracy", 9).alias("accuracy"))


@query(LEAK + "SELECT coder, actual, guess, count(*) AS n FROM g WHERE guess IS NOT NULL GROUP BY ALL", plain=True)
def leakage_confusion(v: Views) -> DataFrame:
    """AGG28."""
    return measures.confusion(_guesses(v))


PILOT = "WITH s AS (SELECT lang AS coder, CASE doc_id % 3 WHEN 0 THEN 'for' WHEN 1 THEN 'against' ELSE 'unclear' END AS direction, CASE CAST(n_chars AS BIGINT) % 4 WHEN 0 THEN '+' WHEN 1 THEN 'x' WHEN 2 THEN '-' ELSE 'none' END AS stance FROM documents), c AS (SELECT coder, direction, stance, count(*) AS items FROM s WHERE direction <> 'unclear' GROUP BY ALL) "


def _stances(v: Views) -> DataFrame:
    d, s = F.col("doc_id") % 3, F.col("n_chars") % 4
    return v.t("documents").select("doc_id", F.col("lang").alias("coder"), F.when(d == 0, "for").when(d == 1, "against").otherwise("unclear").alias("direction"), F.when(s == 0, "+").when(s == 1, "x").when(s == 2, "-").otherwise("none").alias("stance"))


@query(PILOT + "SELECT coder, direction, stance, items, round(items / sum(items) OVER (PARTITION BY coder, direction), 9) AS share FROM c", plain=True)
def pilot_shares(v: Views) -> DataFrame:
    """AGG30, JOIN18."""
    return measures.pilot_shares(_stances(v)).withColumn("share", F.round("share", 9))


@query(PILOT + ", p AS (SELECT coder, sum(CASE WHEN stance = 'x' AND direction = 'against' THEN items ELSE 0 END) / sum(CASE WHEN direction = 'against' THEN items END) - sum(CASE WHEN stance = 'x' AND direction = 'for' THEN items ELSE 0 END) / sum(CASE WHEN direction = 'for' THEN items END) AS d, sum(CASE WHEN stance = '+' AND direction = 'for' THEN items ELSE 0 END) / sum(CASE WHEN direction = 'for' THEN items END) - sum(CASE WHEN stance = '+' AND direction = 'against' THEN items ELSE 0 END) / sum(CASE WHEN direction = 'against' THEN items END) AS a FROM c GROUP BY coder) SELECT round(avg(d), 9) AS d0, round(avg(a), 9) AS a0 FROM p", plain=True)
def pilot_points(v: Views) -> DataFrame:
    """AGG30, STG07."""
    return measures.pilot_points(_stances(v)).select(F.round("d0", 9).alias("d0"), F.round("a0", 9).alias("a0"))


BOOT = """WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id % 10 < 10),
s AS (SELECT event_type, CAST(d AS INTEGER) AS draw, CAST(('0x' || substr(md5(concat_ws(':', '11', event_type, CAST(d AS VARCHAR), CAST(rk AS VARCHAR))), 1, 12)) AS BIGINT) % n AS rk FROM r, generate_series(0, 19) t(d)),
m AS (SELECT s.event_type, draw, avg(r.value) AS m FROM s JOIN r ON r.event_type = s.event_type AND r.rk = s.rk GROUP BY ALL) """


@query(BOOT + "SELECT event_type, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, count(*) AS n FROM m GROUP BY event_type", plain=True)
def bootstrap_interval(v: Views) -> DataFrame:
    """AGG31, GRF07."""
    events = v.t("events").select("event_type", "event_id", "value")
    drawn = measures.bootstrap_draws(events, ["event_type"], "event_id", 20, 11, ["value"])
    means = drawn.groupBy("event_type", "draw").agg(F.avg("value").alias("m"))
    lower, upper = measures.percentile_interval(F.col("m"), 0.95)
    return means.groupBy("event_type").agg(F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"), F.count("*").alias("n"))


@query("SELECT event_type, v[len(v) - CAST(floor(len(v) * 0.05) AS BIGINT)] AS threshold FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)", plain=True)
def order_statistic_thresholds(v: Views) -> DataFrame:
    """AGG32."""
    return measures.order_statistic(v.t("events"), ["event_type"], "value", 0.05)


@query("SELECT event_type, min(CASE WHEN rate >= 0.5 THEN user_id END) AS least_size FROM (SELECT event_type, user_id, avg(CAST(value < 60 AS INTEGER)) AS rate FROM events GROUP BY ALL) GROUP BY event_type", plain=True)
def sizes_by_power(v: Views) -> DataFrame:
    """AGG33, AGG34."""
    return measures.size_by_power(v.t("events"), ["event_type"], "user_id", F.col("value") < 60, 0.5)


VERD = "WITH v AS (SELECT o_custkey AS field, o_orderpriority AS lineage_id, CASE o_orderstatus WHEN 'F' THEN 'healthy' WHEN 'O' THEN 'insulated' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'closed' ELSE 'indeterminate' END END AS verdict, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'unstable' ELSE 'reading_unclear' END END AS reason, o_orderkey FROM orders) "


def _verdicts(v: Views) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.when(status == "F", "healthy").when(status == "O", "insulated").when(key % 5 == 0, "closed").otherwise("indeterminate")
    reason = F.when((status == "P") & (key % 5 != 0), F.when(key % 2 == 0, "unstable").otherwise("reading_unclear"))
    return v.t("orders").select(F.col("o_custkey").alias("field"), F.col("o_orderpriority").alias("lineage_id"), kind.alias("verdict"), reason.alias("reason"), "o_orderkey")


@query(VERD + ", s AS (SELECT field, count(DISTINCT CASE WHEN verdict = 'healthy' THEN lineage_id END) AS h, count(DISTINCT CASE WHEN verdict = 'insulated' THEN lineage_id END) AS i, count(DISTINCT CASE WHEN verdict IN ('healthy', 'insulated') THEN lineage_id END) AS u FROM v GROUP BY field) SELECT field, CASE WHEN h = 0 AND i = 0 THEN 'undetermined' WHEN h = 0 OR i = 0 THEN 'uniform' WHEN u > 1 THEN 'split' ELSE 'shifted' END AS summary FROM s", plain=True)
def field_summary(v: Views) -> DataFrame:
    """AGG36."""
    return measures.field_summary(_verdicts(v), ["field"])


@query(VERD + "SELECT field, CASE WHEN count(DISTINCT verdict || coalesce(reason, '')) = 1 THEN min(verdict) ELSE 'indeterminate' END AS verdict, CASE WHEN count(DISTINCT verdict || coalesce(reason, '')) = 1 THEN min(reason) ELSE 'unstable' END AS reason FROM v GROUP BY field", plain=True)
def stable_verdict(v: Views) -> DataFrame:
    """AGG37."""
    return measures.stable_verdict(_verdicts(v), ["field"])


@query(
    VERD
    + """, s AS (SELECT *, CASE WHEN field % 2 = 0 THEN 'science' ELSE 'pseudoscience' END AS truth FROM v WHERE verdict <> 'closed'), t1 AS (SELECT avg(CAST((truth = 'science' AND verdict = 'insulated') OR (truth <> 'science' AND verdict = 'healthy') AS INTEGER)) AS e, avg(CAST(verdict = 'indeterminate' AS INTEGER)) AS i FROM s WHERE field % 7 <> 0)
SELECT 1 AS trigger, e > 0.2 OR i > 0.4 AS fired FROM t1 UNION ALL SELECT 5, count_if(coalesce(reason, '') = 'unstable') / count(*) > 0.5 FROM s""",
    plain=True,
)
def revision_triggers(v: Views) -> DataFrame:
    """AGG35."""
    rows = _verdicts(v).withColumn("truth", F.when(F.col("field") % 2 == 0, "science").otherwise("pseudoscience")).withColumn("replaced", F.col("field") % 7 == 0)
    one = measures.calibration_trigger(rows, 0.2, 0.4).select(F.lit(1).alias("trigger"), "fired")
    return one.union(measures.instability_trigger(rows).select(F.lit(5), "fired"))


@query(VERD + "SELECT verdict, reason, count(*) AS n FROM v GROUP BY ALL", plain=True)
def verdict_counts(v: Views) -> DataFrame:
    """AGG34."""
    return _verdicts(v).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


# ---- keyed tables, windows, sets


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", plain=True)
def keep_first_by_key(v: Views) -> DataFrame:
    """SRC02, WIN01."""
    return core.keep_first(v.t("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT 'c' || o_custkey AS citation_id, 'W' || min(o_orderkey) AS citing_work, CAST(NULL AS VARCHAR) AS cited_work FROM orders GROUP BY o_custkey", plain=True)
def keyed_table(v: Views) -> DataFrame:
    """SRC02: a declared table's columns in order, the first row of each key, what is not declared dropped."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = v.t("orders").select("o_orderkey", tag("W", "o_orderkey").alias("citing_work"), tag("c", "o_custkey").alias("citation_id"))
    return tables.keyed("citations", rows, ["o_orderkey"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", plain=True)
def latest_by_key(v: Views) -> DataFrame:
    """WIN02, WIN21, FLT10."""
    rows = v.t("events").select("user_id", "event_id", "event_type").withColumn("at", F.col("event_id"))
    return core.keep_latest(rows, ["user_id"], "at").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, o_orderdate FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS o_orderdate FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON o_custkey = c_custkey ORDER BY o_orderdate DESC NULLS FIRST, c_custkey LIMIT 25", plain=True)
def nulls_topk(v: Views) -> DataFrame:
    """SRT01, SRT02: a report of the first rows."""
    firsts = v.t("orders").where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("o_orderdate"))
    return v.t("customer").select("c_custkey").join(firsts, "c_custkey", "left").orderBy(F.col("o_orderdate").desc_nulls_first(), "c_custkey").limit(25)


@query("SELECT CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 16) AS BIGINT) AS chunk, s_suppkey FROM supplier", plain=True)
def fixed_chunks(v: Views) -> DataFrame:
    """WIN19."""
    return core.chunked(v.t("supplier").select("s_suppkey"), ["s_suppkey"], 16)


@query("WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256(concat_ws(':', '3:0', CAST(s_suppkey AS VARCHAR))), s_suppkey) AS rk FROM supplier) SELECT CAST(floor((rk - 1) / 8) AS BIGINT) AS batch, array_to_string(list(CAST(s_suppkey AS VARCHAR) ORDER BY rk), ',') AS ids FROM r GROUP BY ALL", plain=True)
def seeded_batches(v: Views) -> DataFrame:
    """WIN18, WIN17."""
    rows = core.batches(v.t("supplier"), "s_suppkey", 8, 3, 0)
    return rows.select(F.col("batch").cast("long").alias("batch"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT CAST(l AS INTEGER) AS length, CAST(s AS INTEGER) AS shift, CAST(w AS INTEGER) AS window_start, CAST(w + l - 1 AS INTEGER) AS window_end FROM generate_series(3, 5) a(l), generate_series(0, 2) b(s), generate_series(1990, 1999) c(w) WHERE w >= 1990 + s AND w <= 1999 - l + 1", plain=True)
def window_variants(v: Views) -> DataFrame:
    """WIN05."""
    return core.window_variants(v.spark, 1990, 1999, 3, 5, 2)


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events", plain=True)
def next_start(v: Views) -> DataFrame:
    """WIN10."""
    return v.t("events").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events", plain=True)
def last_section(v: Views) -> DataFrame:
    """WIN11, JOIN21."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.t("events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1", plain=True)
def union_all(v: Views) -> DataFrame:
    """SET01, PRJ08."""
    n = v.t("nation")
    return n.select(F.col("n_name").alias("name")).unionByName(v.t("region").select(F.col("r_name").alias("name"))).unionByName(n.where("n_regionkey = 1").select(F.col("n_name").alias("name")))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier", plain=True)
def union_first(v: Views) -> DataFrame:
    """SET02."""
    a = v.t("customer").select(F.col("c_nationkey").alias("nation")).distinct()
    return core.union_first([a, v.t("supplier").select(F.col("s_nationkey").alias("nation")).distinct()], ["nation"]).select("nation")


@query("WITH a AS (SELECT 'k' || s_suppkey AS path, md5(s_name) AS sha256 FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT 'k' || s_suppkey AS path, CASE WHEN s_suppkey % 5 = 0 THEN md5('x') ELSE md5(s_name) END AS sha256 FROM supplier WHERE s_suppkey % 11 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256", plain=True)
def table_diff(v: Views) -> DataFrame:
    """SET03, SET04, STG11."""
    rows = v.t("supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("path"), F.md5("s_name").alias("sha256"), "s_suppkey")
    found = rows.where("s_suppkey % 11 != 0").withColumn("sha256", F.when(F.col("s_suppkey") % 5 == 0, F.md5(F.lit("x"))).otherwise(F.col("sha256")))
    return core.table_diff(rows.where("s_suppkey % 7 != 0"), found)


@query("WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY user_id) SELECT event_type, user_id, CAST(t - n AS BIGINT) AS rest FROM c JOIN t USING (user_id) WHERE t - n > 0", plain=True)
def multiset_rest(v: Views) -> DataFrame:
    """SET06."""
    return core.multiset_rest(v.t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "event_type", "user_id")


@query("SELECT l_orderkey AS work_id, l_partkey AS cited, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", plain=True)
def duplicate_values(v: Views) -> DataFrame:
    """SET08."""
    return core.duplicates(v.t("lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("cited")), "work_id", "cited")


@query("SELECT count(*) AS unused FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", plain=True)
def unused_items(v: Views) -> DataFrame:
    """JOIN16."""
    used = v.t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return v.t("orders").join(used, "o_orderkey", "left_anti").agg(F.count("*").alias("unused"))


@query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_quantity > 45", plain=True)
def directed_only(v: Views) -> DataFrame:
    """FLT08."""
    cited = v.t("lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return v.t("orders").join(cited, "o_orderkey", "left_semi").select("o_orderkey")


@query("WITH n AS (SELECT citing, cited, row_number() OVER (PARTITION BY cited ORDER BY citing DESC) AS r FROM (SELECT o_orderkey AS citing, o_custkey AS cited FROM orders)) SELECT cited, citing FROM n WHERE r = 1", plain=True)
def inverse_lookup(v: Views) -> DataFrame:
    """JOIN04: of several works under one key the last one holds."""
    rows = v.t("orders").select(F.col("o_custkey").alias("cited"), F.col("o_orderkey").alias("citing"))
    return rows.groupBy("cited").agg(F.max("citing").alias("citing"))


@query("SELECT s_suppkey AS ref, coalesce(a.n_name, b.r_name) AS found FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_suppkey LEFT JOIN region b ON b.r_regionkey = s_nationkey", plain=True)
def resolve_refs(v: Views) -> DataFrame:
    """JOIN20, SRC12: by id, else by the other key."""
    a, b = v.t("nation").select("n_nationkey", "n_name"), v.t("region").select("r_regionkey", "r_name")
    rows = v.t("supplier").join(a, F.col("n_nationkey") == F.col("s_suppkey"), "left").join(b, F.col("r_regionkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("s_suppkey").alias("ref"), F.coalesce("n_name", "r_name").alias("found"))


@query("WITH l AS (SELECT l_orderkey AS citing, l_partkey AS cited, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, count(*) OVER (PARTITION BY l_orderkey) AS list_length FROM lineitem) SELECT citing, cited, CAST(position AS INTEGER) AS position, list_length FROM l", plain=True)
def reference_positions(v: Views) -> DataFrame:
    """JOIN22."""
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lists = v.t("lineitem").groupBy(F.col("l_orderkey").alias("citing")).agg(F.array_sort(F.collect_list(entry)).alias("refs"))
    rows = lists.select("citing", F.posexplode("refs").alias("p", "r"), F.size("refs").cast("long").alias("list_length"))
    return rows.select("citing", F.col("r.l_partkey").alias("cited"), (F.col("p") + 1).alias("position"), "list_length")


@query("SELECT a.o_custkey AS case_id, a.o_orderkey AS run, b.o_orderkey AS upstream FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate WHERE a.o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) = 1", plain=True)
def run_graph(v: Views) -> DataFrame:
    """JOIN23, FLT10: the newest earlier run of the case, by a lookup over ordered rows instead of a self join."""
    o = v.t("orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = o.withColumn("at", at)
    w = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct("at", "o_orderkey")).over(w)
    rows = rows.withColumn("best", best).where("o_orderstatus = 'F' and best is not null")
    return rows.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run"), F.col("best.o_orderkey").alias("upstream"))


@query("SELECT c_nationkey AS source, o_orderpriority AS kind, count(*) AS n, CAST(ceil(count(*) / 50) AS BIGINT) AS pages, round(ceil(count(*) / 50) * 0.0025, 6) AS usd FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL", plain=True)
def projected_calls(v: Views) -> DataFrame:
    """AGG40, AGG41, SRC10."""
    rows = v.t("orders").join(v.t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("source"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    pages = F.ceil(F.col("n") / 50)
    return rows.select("source", "kind", "n", pages.cast("long").alias("pages"), F.round(pages * F.lit(0.0025), 6).alias("usd"))


@query("WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS spent FROM events) SELECT event_id, round(spent, 6) AS spent FROM u WHERE spent <= 200 + 1e-9", plain=True)
def within_cap(v: Views) -> DataFrame:
    """SRC10: calls under a day's cap."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = v.t("events").withColumn("spent", F.sum("value").over(w))
    return rows.where(F.col("spent") <= 200 + 1e-9).select("event_id", F.round("spent", 6).alias("spent"))
