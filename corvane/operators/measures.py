"""Asymmetry, omission, agreement and interval measures (AGG15-AGG37, WIN03, WIN08, JOIN17, JOIN18, GRF07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.decision import INSULATING, opposite
from corvane.operators.core import ranked


def majority(votes: DataFrame, item: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """(item, label, n): the label with most votes; ties go to the least label."""
    n = F.sum(weight) if weight is not None else F.count("*")
    counted = votes.where(F.col(label).isNotNull()).groupBy(*item, label).agg(n.alias("n"))
    best = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("n"), label))
    return counted.withColumn("_r", best).where("_r = 1").drop("_r")


def delta(cited: DataFrame, filters: DataFrame, by: list[str], side: str) -> DataFrame:
    """Reason-by-reason asymmetry per group.

    ``cited``: one row per cited result and filter: by, result_id, supports, filter_id,
    applies (yes or not), discounted (by this filter). ``filters``: filter_id, checkable. A
    checkable filter weighs the results it applies to in both lanes, an uncheckable one the unfavourable results.
    """
    favoured = F.col("supports") == side
    applies = F.coalesce(F.col("applies") == "yes", F.lit(False))
    hit = F.coalesce("discounted", F.lit(False))
    rows = cited.join(F.broadcast(filters), "filter_id").groupBy(*by, "filter_id", "checkable").agg(
        F.count_if(~favoured & applies).alias("against"),
        F.count_if(favoured & applies).alias("for"),
        F.count_if(~favoured & applies & hit).alias("against_hit"),
        F.count_if(favoured & applies & hit).alias("for_hit"),
        F.count_if(~favoured).alias("unfavourable"),
        F.count_if(~favoured & hit).alias("unfavourable_hit"),
    )
    both = (F.col("against") > 0) & (F.col("for") > 0)
    weight = F.when(F.col("checkable"), F.when(both, F.col("against") + F.col("for"))).otherwise(F.when(F.col("unfavourable") > 0, F.col("unfavourable")))
    rates = F.try_divide(F.col("against_hit").cast("double"), F.col("against").cast("double")) - F.try_divide(F.col("for_hit").cast("double"), F.col("for").cast("double"))
    value = F.when(F.col("checkable"), rates * weight).otherwise(F.col("unfavourable_hit").cast("double"))
    rows = rows.withColumn("weight", weight).withColumn("value", F.when(weight.isNotNull(), value))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("value"), F.sum("weight").cast("double")).alias("delta"))


def uncheckable_uses(cited: DataFrame, filters: DataFrame, by: list[str], side: str) -> DataFrame:
    """Uses of uncheckable filters against a side's own results."""
    rows = cited.join(F.broadcast(filters), "filter_id")
    return rows.groupBy(*by).agg(F.count_if((F.col("supports") == side) & ~F.col("checkable") & F.coalesce("discounted", F.lit(False))).alias("uses"))


def stratum(by: list[str], strata: int, order: list[str]) -> Column:
    """Equal-count stratum by rank: floor(rank * strata / n), which ntile is not."""
    w = Window.partitionBy(*by)
    return F.least(F.floor((F.row_number().over(w.orderBy(*order)) - 1) * strata / F.count("*").over(w)), F.lit(strata - 1))


def omega(results: DataFrame, by: list[str], side: str, strata: int) -> DataFrame:
    """Omission asymmetry: mean over strata with both kinds of (cited share of favourable - of unfavourable)."""
    placed = results.withColumn("stratum", stratum(by, strata, ["prominence", "result_id"]))
    cited = F.col("cited").cast("double")
    favoured = F.col("supports") == side
    rates = placed.groupBy(*by, "stratum").agg(F.avg(F.when(favoured, cited)).alias("f"), F.avg(F.when(~favoured, cited)).alias("u"))
    return rates.groupBy(*by).agg(F.avg(F.col("f") - F.col("u")).alias("omega"))


def favoured_side(stances: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, not_p, side) from cited results: supports, stance."""
    toward = F.when(F.col("stance") == "support", F.col("supports")).when(F.col("stance") == "discount", opposite(F.col("supports")))
    counts = stances.where("cited").groupBy(*by).agg(F.count_if(toward == "p").alias("p"), F.count_if(toward == "not_p").alias("not_p"))
    return counts.withColumn("side", F.when(F.col("p") == F.col("not_p"), "both").when(F.col("p") > F.col("not_p"), "p").otherwise("not_p"))


def retention(kept: Column, before: Column) -> Column:
    return F.try_divide(F.sum(kept).cast("double"), F.sum(before).cast("double"))


def tie_retention(events: DataFrame, by: list[str]) -> DataFrame:
    """Retention after breaks relative to that after other changes; null where either cannot be taken."""
    of = lambda q: F.try_divide(F.sum(F.when(q, F.col("kept"))).cast("double"), F.sum(F.when(q, F.col("before"))).cast("double"))
    rows = events.groupBy(*by).agg(of(F.col("is_break")).alias("after_breaks"), of(~F.col("is_break")).alias("baseline"))
    return rows.withColumn("tau", F.try_divide(F.col("after_breaks"), F.col("baseline")))


def honoured_share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def engagement(out: Column, total: Column, coverage: Column, least: float) -> Column:
    return F.when((coverage >= least) & (total > 0), out.cast("double") / total)


def insulating_share(code: Column) -> Column:
    """Share of insulating codes among those that are not excluded (null)."""
    return F.avg(code.isin(*INSULATING).cast("double"))


def loop_length(entries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Longest run of insulating entries; other codes and entries at risk end a run, null codes are passed over."""
    insulating = F.col("code").isin(*INSULATING) & ~F.col("at_risk")
    counted = entries.where("code is not null").withColumn("in_run", insulating)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = counted.withColumn("island", F.sum((~F.col("in_run")).cast("int")).over(w))
    runs = islands.groupBy(*by, "island").agg(F.count_if("in_run").alias("run"))
    return runs.groupBy(*by).agg(F.max("run").alias("loop_length"))


def disagreement(labels: DataFrame, item: str, family: str, label: str) -> DataFrame:
    """One row: mean over items with two families or more of the share of pairs that disagree (null is a label).

    Pairs are counted from label counts, so an item with many labels is one group, not its square.
    """
    counts = labels.groupBy(item, label).agg(F.count("*").alias("c"))
    rates = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same")).where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1)
    return rates.agg(F.coalesce(F.avg((pairs - (F.col("same") - F.col("n"))) / pairs), F.lit(0.0)).alias("disagreement"))


def kappa(labels: DataFrame, item: str, coder: str, positive: Column) -> DataFrame:
    """(coder_a, coder_b, items, kappa, share_a, share_b) on a binary label, over items both labelled."""
    rows = labels.select(F.col(item).alias("i"), F.col(coder).alias("c"), positive.alias("x")).where("x is not null")
    a, b = rows.select("i", F.col("c").alias("coder_a"), F.col("x").alias("xa")), rows.select("i", F.col("c").alias("coder_b"), F.col("x").alias("xb"))
    met = a.join(b, "i").where("coder_a < coder_b")
    sums = met.groupBy("coder_a", "coder_b").agg(
        F.count("*").alias("items"), F.avg((F.col("xa") == F.col("xb")).cast("double")).alias("observed"), F.avg(F.col("xa").cast("double")).alias("share_a"), F.avg(F.col("xb").cast("double")).alias("share_b")
    )
    expected = F.col("share_a") * F.col("share_b") + (1 - F.col("share_a")) * (1 - F.col("share_b"))
    value = F.when(expected == 1, F.lit(1.0)).otherwise((F.col("observed") - expected) / (1 - expected))
    return sums.select("coder_a", "coder_b", "items", value.alias("kappa"), "share_a", "share_b")


def retest(labels: DataFrame, coder: str, item: str, rep: str, label: str) -> DataFrame:
    """(coder, pairs, changed, share) over items labelled in both repetitions 0 and 1."""
    first, second = (F.max(F.when(F.col(rep) == k, F.col(label))) for k in (0, 1))
    pairs = labels.groupBy(coder, item).agg(first.alias("a"), second.alias("b")).where("a is not null and b is not null")
    changed = F.count_if(F.col("a") != F.col("b"))
    return pairs.groupBy(coder).agg(F.count("*").alias("pairs"), changed.alias("changed"), (changed.cast("double") / F.count("*")).alias("share"))


def symmetry(labels: DataFrame, sides: DataFrame, retests: DataFrame, most: float) -> DataFrame:
    """Per coder: pairs whose label changed with the stated area, the excess over the retest share, and moves of x.

    ``labels``: coder, pair_id, version (true or swapped), label; ``sides``: pair_id, side.
    """
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("label")))
    pairs = labels.groupBy("coder", "pair_id").agg(of("true").alias("a"), of("swapped").alias("b")).where("a is not null and b is not null").join(sides, "pair_id")
    pseudo = F.col("side") == "pseudoscience"
    as_pseudo, as_science = F.when(pseudo, F.col("a")).otherwise(F.col("b")), F.when(pseudo, F.col("b")).otherwise(F.col("a"))
    out = pairs.groupBy("coder").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("a") != F.col("b")).alias("changed"),
        F.count_if((as_pseudo == "x") & (as_science != "x")).alias("more_x"),
        F.count_if((as_science == "x") & (as_pseudo != "x")).alias("fewer_x"),
    )
    out = out.join(retests.select("coder", F.col("share").alias("retest_share")), "coder", "left").withColumn("share", F.col("changed").cast("double") / F.col("pairs"))
    excess = F.col("share") - F.col("retest_share")
    return out.withColumn("excess", excess).withColumn("passes", F.coalesce(excess <= most, F.lit(False)))


def leakage(guesses: DataFrame, subjects: int, most_pp: float) -> DataFrame:
    """(coder, answered, missing, accuracy, above_chance_pp, passes) of guesses (coder, actual, guess; null: missing)."""
    said = F.col("guess").isNotNull()
    right = F.regexp_replace("guess", "_", "-") == F.col("actual")
    rows = guesses.groupBy("coder").agg(F.count_if(said).alias("answered"), F.count_if(~said).alias("missing"), F.avg(F.when(said, right.cast("double"))).alias("accuracy"))
    above = F.bround(100 * (F.col("accuracy") - F.lit(1.0 / subjects)), 1)
    return rows.withColumn("above_chance_pp", above).withColumn("passes", F.coalesce(above <= most_pp, F.lit(False)))


def confusion(guesses: DataFrame) -> DataFrame:
    return guesses.where("guess is not null").groupBy("coder", "actual", "guess").agg(F.count("*").alias("n"))


def distinctive_terms(tokens: DataFrame, group: str, top: int, min_count: int, min_z: float, prior_total: float = 500.0) -> DataFrame:
    """(group, word, n, score, z, place): words over-represented in a group by log-odds with a Dirichlet prior; z is the score rounded.

    ``tokens``: one row per token (group, word). Counts are summed before they are shuffled; totals are
    one small row per group, the prior one row per word. Ties in z go by word.
    """
    counts = tokens.groupBy(group, "word").agg(F.count("*").alias("n"))
    by_word, by_group = Window.partitionBy("word"), Window.partitionBy(group)
    sums = counts.groupBy(group).agg(F.sum("n").alias("n_i"))
    whole = counts.agg(F.sum("n").alias("alpha"))
    rows = counts.withColumn("everywhere", F.sum("n").over(by_word)).where(F.col("n") >= min_count)
    rows = rows.join(F.broadcast(sums), group).crossJoin(F.broadcast(whole))
    a = F.col("everywhere") / F.col("alpha") * prior_total
    y_j = F.col("everywhere") - F.col("n")
    n_j = F.col("alpha") - F.col("n_i")
    odds = F.ln((F.col("n") + a) / (F.col("n_i") + prior_total - F.col("n") - a)) - F.ln((y_j + a) / (n_j + prior_total - y_j - a))
    z = odds / F.sqrt(1 / (F.col("n") + a) + 1 / (y_j + a))
    scored = rows.select(group, "word", "n", z.alias("score")).where(F.col("score") >= min_z).withColumn("z", F.bround("score", 2))
    return scored.withColumn("place", F.row_number().over(by_group.orderBy(F.desc("z"), "word"))).where(F.col("place") <= top)


def pilot_shares(rows: DataFrame) -> DataFrame:
    """(coder, direction, stance, items, share) of stance rows (coder, direction, stance)."""
    known = rows.where(F.col("direction").isin("for", "against") & F.col("stance").isin("+", "x", "-", "none"))
    counts = known.groupBy("coder", "direction", "stance").agg(F.count("*").alias("items"))
    return counts.withColumn("share", F.col("items") / F.sum("items").over(Window.partitionBy("coder", "direction")))


def pilot_points(rows: DataFrame, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """d0 and a0 (means over coders, nulls passed over) per group."""
    w = weight if weight is not None else F.lit(1.0)
    known = rows.where(F.col("direction").isin("for", "against") & F.col("stance").isin("+", "x", "-", "none"))
    of = lambda s, d: F.try_divide(F.sum(F.when((F.col("stance") == s) & (F.col("direction") == d), w).otherwise(0.0)), F.sum(F.when(F.col("direction") == d, w)))
    per = known.groupBy(*by, "coder").agg((of("x", "against") - of("x", "for")).alias("d"), (of("+", "for") - of("+", "against")).alias("a"))
    return per.groupBy(*by).agg(F.avg("d").alias("d0"), F.avg("a").alias("a0"))


def percentile_interval(x: Column, level: float) -> tuple[Column, Column]:
    tail = (1 - level) / 2
    return F.percentile(x, tail), F.percentile(x, 1 - tail)


def bootstrap_draws(items: DataFrame, by: list[str], ident: str, draws: int, seed: int, carry: list[str] = ()) -> DataFrame:
    """(by, draw, ident, carry): items drawn with replacement by hashed positions; the same for any partitioning.

    Each group of n items gives n positions a draw; position k takes the item of rank hash(k) mod n. Ranks are places in
    the whole order less the group's first, so no task holds a group. Items are joined by place alone and by sorting: both
    sides grow with the items, so neither may be broadcast. Groups named null give nothing.
    """
    placed = ranked(items.select(*by, ident, *carry).dropna(subset=list(by)) if by else items.select(ident, *carry), [*by, ident], "_place")
    groups = placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    spread = placed.select(*by, "_place").join(groups, list(by)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"), (F.col("_place") - F.col("_first")).cast("string")))
    picked = F.col("_first") + F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("_n"))
    targets = spread.select("draw", picked.alias("_place"))
    return targets.hint("merge").join(placed, "_place").select(*by, "draw", ident, *carry)


def order_statistic(rows: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    """The value of index n - floor(alpha * n) - 1 of each group in ascending order."""
    whole = Window.partitionBy(*by)
    known = rows.where(F.col(value).isNotNull())
    placed = known.select(*by, F.col(value).alias("threshold"), (F.row_number().over(whole.orderBy(value)) - 1).alias("at"), F.count("*").over(whole).alias("n"))
    return placed.where(F.col("at") == F.col("n") - F.floor(F.col("n") * F.lit(alpha)) - 1).select(*by, "threshold")


def size_by_power(rows: DataFrame, by: list[str], size: str, passed: Column, power: float) -> DataFrame:
    """The least size whose rate of passes is ``power`` or more; null if none."""
    rates = rows.groupBy(*by, size).agg(F.avg(passed.cast("double")).alias("rate"))
    return rates.groupBy(*by).agg(F.min(F.when(F.col("rate") >= power, F.col(size))).alias("least_size"))


def field_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """uniform, split, shifted or undetermined from (by, lineage_id, verdict)."""
    of = lambda v: F.collect_set(F.when(F.col("verdict") == v, F.col("lineage_id")))
    rows = verdicts.groupBy(*by).agg(of("healthy").alias("h"), of("insulated").alias("i"))
    apart = (F.size(F.array_union("h", "i")) > 1)
    summary = (
        F.when((F.size("h") == 0) & (F.size("i") == 0), "undetermined").when((F.size("h") == 0) | (F.size("i") == 0), "uniform").when(apart, "split").otherwise("shifted")
    )
    return rows.select(*by, summary.alias("summary"))


def stable_verdict(variants: DataFrame, by: list[str]) -> DataFrame:
    """The verdict and reason if all variants agree and none is null, else indeterminate and unstable."""
    rows = variants.groupBy(*by).agg(F.bool_or(F.col("verdict").isNull()).alias("lost"), F.countDistinct(F.struct("verdict", F.coalesce("reason", F.lit("")))).alias("kinds"), F.min("verdict").alias("v"), F.min("reason").alias("r"))
    same = ~F.col("lost") & (F.col("kinds") == 1)
    return rows.select(*by, F.when(same, F.col("v")).otherwise("indeterminate").alias("verdict"), F.when(same, F.col("r")).otherwise("unstable").alias("reason"))


def calibration_trigger(verdicts: DataFrame, e: float, i: float) -> DataFrame:
    """Trigger 1: (scored, error_share, indeterminate_share, fired) of (truth, verdict, replaced); null where nothing is scored."""
    scored = verdicts.where(~F.col("replaced") & ~F.col("verdict").isin("closed", "out_of_scope"))
    wrong = ((F.col("truth") == "science") & (F.col("verdict") == "insulated")) | ((F.col("truth") == "pseudoscience") & (F.col("verdict") == "healthy"))
    rows = scored.agg(F.count("*").alias("scored"), F.avg(wrong.cast("double")).alias("error_share"), F.avg((F.col("verdict") == "indeterminate").cast("double")).alias("indeterminate_share"))
    return rows.withColumn("fired", (F.col("error_share") > e) | (F.col("indeterminate_share") > i))


def instability_trigger(verdicts: DataFrame) -> DataFrame:
    """Trigger 5: more than half of the scored verdicts are unstable."""
    scored = verdicts.where(~F.col("verdict").isin("closed", "out_of_scope"))
    rows = scored.agg(F.count("*").alias("scored"), F.count_if(F.col("reason").eqNullSafe("unstable")).alias("unstable"))
    return rows.withColumn("fired", F.try_divide(F.col("unstable").cast("double"), F.col("scored").cast("double")) > 0.5)


def reliability_trigger(kappa_value: Column, pool: Column, least: float) -> Column:
    """Trigger 2, null where neither is known."""
    return F.when(kappa_value.isNotNull() | pool.isNotNull(), F.coalesce(kappa_value < least, F.lit(False)) | F.coalesce(~pool, F.lit(False)))


def separation_trigger(pairs: DataFrame) -> DataFrame:
    """Trigger 4: (pairs, not_separated, fired) of (pair_id, predicted, actual)."""
    missed = pairs.groupBy("pair_id").agg(F.bool_or(~F.col("actual").eqNullSafe(F.col("predicted")) | F.col("actual").eqNullSafe("undetermined")).alias("missed"))
    rows = missed.agg(F.count("*").alias("pairs"), F.count_if("missed").alias("not_separated"))
    return rows.withColumn("fired", F.when(F.col("pairs") > 0, F.col("not_separated") > 0))


def check_trigger(checks: DataFrame, depth: tuple[float, float], deletion: tuple[float, float]) -> DataFrame:
    """Trigger 6: more than half of the measurable insulated verdicts lie within a consensus range."""
    known = checks.where("depth_ratio is not null or deletion_rate is not null")
    within = F.coalesce(F.col("depth_ratio").between(*depth), F.lit(False)) | F.coalesce(F.col("deletion_rate").between(*deletion), F.lit(False))
    rows = known.agg(F.count("*").alias("measurable"), F.count_if(within).alias("within"))
    return rows.withColumn("fired", F.try_divide(F.col("within").cast("double"), F.col("measurable").cast("double")) > 0.5)
