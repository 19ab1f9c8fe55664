"""Author graphs, bearing sets, lineages and eligibility (JOIN02-JOIN06, JOIN10-JOIN15, AGG10-AGG14, AGG39, WIN06-WIN09, GRF01-GRF03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ids import overlap_coefficient


def teams(authorships: DataFrame) -> DataFrame:
    """(work_id, author_id, team): distinct authors of works with the size of the team."""
    pairs = authorships.where("author_id is not null").select("work_id", "author_id").distinct()
    return pairs.join(pairs.groupBy("work_id").agg(F.count("*").alias("team")), "work_id")


def in_windows(dated: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with every window that holds their year. Windows are few: one row a year and length."""
    return dated.join(F.broadcast(windows), (F.col("year") >= F.col("window_start")) & (F.col("year") <= F.col("window_end")))


def active_authors(works: DataFrame, authorships: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_start, author_id): the nodes of each window's graph, isolated ones included."""
    return in_windows(works, windows).join(authorships, "work_id").select("window_start", "author_id").distinct()


def graph_edges(works: DataFrame, authorships: DataFrame, citations: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_start, src, dst, weight) of the author graphs of all windows, src < dst.

    Two authors of a work of k authors are tied by 1/(k-1); an author of a citing work of the
    window and an active author of the cited one by 1 over the product of the whole teams.
    Citations are weighted before they meet the windows, so each is expanded once, and
    weights are summed before the shuffle.
    """
    staff = teams(authorships)
    one, two = staff.select("work_id", F.col("author_id").alias("a"), "team"), staff.select("work_id", F.col("author_id").alias("b"))
    pairs = one.join(two, "work_id").where("a < b").select("work_id", F.col("a").alias("src"), F.col("b").alias("dst"), (F.lit(1.0) / (F.col("team") - 1)).alias("w"))
    dated = works.where("year is not null").select("work_id", "year")
    coauthors = in_windows(pairs.join(dated, "work_id"), windows).select("window_start", "src", "dst", "w")
    citing = staff.select(F.col("work_id").alias("citing"), F.col("author_id").alias("a"), F.col("team").alias("ta"))
    cited = staff.select(F.col("work_id").alias("cited"), F.col("author_id").alias("b"), F.col("team").alias("tb"))
    ties = citations.where("citing != cited").join(citing, "citing").join(cited, "cited").where("a != b")
    ties = ties.select(F.col("citing").alias("work_id"), "a", "b", (F.lit(1.0) / (F.col("ta") * F.col("tb"))).alias("w")).join(dated, "work_id")
    ties = in_windows(ties, windows).select("window_start", "a", "b", "w")
    active = active_authors(works, authorships, windows)
    # Citing authors of the window are active by their own work; cited ones have to be checked.
    ties = ties.join(active.select("window_start", F.col("author_id").alias("b")), ["window_start", "b"], "left_semi")
    ties = ties.select("window_start", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w")
    return coauthors.union(ties).groupBy("window_start", "src", "dst").agg(F.sum("w").alias("weight"))


def bearing(anchors: DataFrame, citations: DataFrame) -> DataFrame:
    """work_id of the anchors and of the works that cite one: one hop."""
    citing = citations.join(anchors.select(F.col("work_id").alias("cited")), "cited", "left_semi").select(F.col("citing").alias("work_id"))
    return anchors.select("work_id").union(citing).distinct()


def own_works(frames: DataFrame) -> DataFrame:
    return frames.where("kind != 'bearing'").select("work_id").distinct()


def lineage_works(rule: str, works: DataFrame, authorships: DataFrame, own: DataFrame) -> DataFrame:
    """(work_id, year, author_id) that members can be credited with, by the named rule.

    own_frames_v1: works of the own frames. member_works_v1: all works; outside the own
    frames only by authors who sign one of the own works.
    """
    pairs = works.join(authorships, "work_id").select("work_id", "year", "author_id")
    if own.isEmpty():
        return pairs
    if rule == "own_frames_v1":
        return pairs.join(own, "work_id", "left_semi")
    if rule != "member_works_v1":
        raise ValueError(f"unknown rule {rule!r}")
    signers = authorships.join(own, "work_id", "left_semi").select("author_id").distinct()
    return pairs.join(signers, "author_id", "left_semi").select("work_id", "year", "author_id").union(pairs.join(own, "work_id", "left_semi")).distinct()


def core_authors(frames: DataFrame, authorships: DataFrame, key: str, least: int) -> DataFrame:
    """(subject, key, works) of authors with ``least`` works or more in a subject's community frames."""
    community = frames.where("kind = 'community'").select("subject", "work_id").distinct()
    signed = community.join(authorships.select("work_id", key).where(F.col(key).isNotNull()).distinct(), "work_id")
    return signed.groupBy("subject", key).agg(F.count("*").alias("works")).where(F.col("works") >= least)


def overlaps(core: DataFrame, key: str, threshold: float) -> DataFrame:
    """(subject_a, subject_b, authors_a, authors_b, shared, coefficient, exceeds) of all pairs of subjects, a < b.

    Shared authors are counted by an equi join on the author; only the few subjects are paired freely.
    """
    sizes = core.groupBy("subject").agg(F.count("*").alias("n"))
    a = core.select(F.col("subject").alias("subject_a"), key)
    b = core.select(F.col("subject").alias("subject_b"), key)
    shared = a.join(b, key).where("subject_a < subject_b").groupBy("subject_a", "subject_b").agg(F.count("*").alias("shared"))
    left = sizes.select(F.col("subject").alias("subject_a"), F.col("n").alias("authors_a"))
    right = sizes.select(F.col("subject").alias("subject_b"), F.col("n").alias("authors_b"))
    pairs = left.join(right, F.col("subject_a") < F.col("subject_b")).join(shared, ["subject_a", "subject_b"], "left")
    pairs = pairs.withColumn("shared", F.coalesce("shared", F.lit(0)))
    coefficient = overlap_coefficient(F.col("shared"), F.col("authors_a"), F.col("authors_b"))
    return pairs.withColumn("coefficient", coefficient).withColumn("exceeds", F.coalesce(coefficient > threshold, F.lit(False)))


def predecessors(members: DataFrame, least_overlap: float) -> DataFrame:
    """(window_start, cluster, predecessor, overlap): of the clusters a window before, the one with the greatest Jaccard overlap.

    ``members``: window_start, cluster, author_id. Ties go to the lower cluster; below ``least_overlap`` there is none.
    """
    sizes = members.groupBy("window_start", "cluster").agg(F.count("*").alias("n"))
    before = members.select((F.col("window_start") + 1).alias("window_start"), F.col("cluster").alias("predecessor"), "author_id")
    shared = members.join(before, ["window_start", "author_id"]).groupBy("window_start", "cluster", "predecessor").agg(F.count("*").alias("shared"))
    old = sizes.select((F.col("window_start") + 1).alias("window_start"), F.col("cluster").alias("predecessor"), F.col("n").alias("m"))
    scored = shared.join(sizes, ["window_start", "cluster"]).join(old, ["window_start", "predecessor"])
    scored = scored.withColumn("overlap", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("overlap") >= least_overlap)
    best = F.row_number().over(Window.partitionBy("window_start", "cluster").orderBy(F.desc("overlap"), "predecessor"))
    return scored.withColumn("_r", best).where("_r = 1").select("window_start", "cluster", "predecessor", "overlap")


def on_claim(lineage_members: DataFrame, credited: DataFrame, citations: DataFrame, bearing_works: DataFrame) -> DataFrame:
    """(lineage_id, window_start, window_end, members, citations_on_claim).

    Distinct bearing works that members' works of the window cite. ``lineage_members``:
    lineage_id, window_start, window_end, author_id; ``credited``: work_id, year, author_id.
    """
    cites = citations.where("citing != cited").join(bearing_works.select(F.col("work_id").alias("cited")), "cited", "left_semi").select(F.col("citing").alias("work_id"), "cited").distinct()
    # Works that cite nothing bearing cannot count, so they leave before the windows multiply them.
    useful = credited.where("year is not null").join(cites, "work_id").select("author_id", "year", "cited").distinct()
    hit = lineage_members.join(useful, "author_id").where("year between window_start and window_end")
    counts = hit.groupBy("lineage_id", "window_start", "window_end").agg(F.countDistinct("cited").alias("citations_on_claim"))
    sizes = lineage_members.groupBy("lineage_id", "window_start", "window_end").agg(F.countDistinct("author_id").alias("members"))
    return sizes.join(counts, ["lineage_id", "window_start", "window_end"], "left").withColumn("citations_on_claim", F.coalesce("citations_on_claim", F.lit(0)))


def closed_after(rows: DataFrame, v: int) -> DataFrame:
    """Add closed: the window starts after the lineage's last one with ``v`` citations or more."""
    last = F.max(F.when(F.col("citations_on_claim") >= v, F.col("window_start"))).over(Window.partitionBy("lineage_id"))
    return rows.withColumn("closed", F.coalesce(F.col("window_start") > last, F.lit(False)))


def eligibility(rows: DataFrame, coverage: DataFrame, event_years: list[float], m: int, v: int, r: float, lag: float) -> DataFrame:
    """Add disconfirmations, coverage and the checks; meets_r is null without coverage."""
    old = F.lit(0)
    for d in event_years:
        old = old + F.when(F.lit(d + lag) <= F.col("window_end") + 1, 1).otherwise(0)
    rows = closed_after(rows, v).join(coverage, ["lineage_id", "window_start"], "left")
    return rows.select("*", old.alias("disconfirmations"), (F.col("members") >= m).alias("meets_m"), (F.col("citations_on_claim") >= v).alias("meets_v"), (F.col("coverage") >= r).alias("meets_r"))


def needed_windows(rows: DataFrame, resolution: float) -> DataFrame:
    """(lineage_id, window_start, window_end) that a census has to cover: the resolution within 1e-9."""
    need = rows.where((F.abs(F.col("resolution") - resolution) < 1e-9) & F.col("meets_m") & F.col("meets_v") & ~F.col("closed"))
    return need.groupBy("lineage_id", "window_start").agg(F.max("window_end").alias("window_end"))


def eligible_windows(rows: DataFrame, resolution: float) -> DataFrame:
    """Windows that pass every check at exactly the resolution."""
    good = (F.col("resolution") == resolution) & F.col("meets_m") & F.col("meets_v") & F.col("meets_r").eqNullSafe(True) & ~F.col("closed")
    return rows.where(good).select("lineage_id", "window_start", "window_end").distinct()


def cluster_frames(windows: DataFrame, members: DataFrame, credited: DataFrame) -> DataFrame:
    """(lineage_id, window_start, work_id, year): members' works in each window."""
    met = windows.join(members, ["lineage_id", "window_start"]).join(credited.where("year is not null"), "author_id")
    return met.where("year between window_start and window_end").select("lineage_id", "window_start", "work_id", "year").distinct()


def scope_citations(frames: DataFrame, citations: DataFrame, bearing_works: DataFrame) -> DataFrame:
    """(lineage_id, window_start, citing, cited): citations of bearing works by works of the frames."""
    cites = citations.where("citing != cited").join(bearing_works.select(F.col("work_id").alias("cited")), "cited", "left_semi")
    return frames.select("lineage_id", "window_start", F.col("work_id").alias("citing")).join(cites, "citing").select("lineage_id", "window_start", "citing", "cited").distinct()


def trajectory_closed(count: Column, v: int, partition: list[str], order: str) -> Column:
    """Engaged before the row, and below ``v`` from it on."""
    w = Window.partitionBy(*partition).orderBy(order)
    before = F.max(count).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(count).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce((before >= v) & (after < v), F.lit(False))


def social_summary(lineages: DataFrame) -> DataFrame:
    return lineages.groupBy("resolution").agg(F.countDistinct("lineage_id").alias("lineages"), F.max("members").alias("largest"))


def descendants(parents: DataFrame, root: str) -> DataFrame:
    """lineage_id of the root and of all that descend from it, however deep; ``parents``: child, parent."""
    from corvane.operators.graph import FRONT

    spark = parents.sparkSession
    links = parents.where("child is not null and parent is not null").select("child", F.col("parent").alias("lineage_id"))
    found = front = spark.createDataFrame([(root,)], "lineage_id string")
    while True:
        front = links.join(front, "lineage_id", "left_semi").select(F.col("child").alias("lineage_id")).distinct().join(found, "lineage_id", "left_anti")
        front = spark.createDataFrame(front.toArrow()) if front.limit(FRONT + 1).count() <= FRONT else front.checkpoint()
        if front.isEmpty():
            return found
        found = found.union(front)
