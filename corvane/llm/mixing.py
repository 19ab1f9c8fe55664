"""Mix sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slot i of the schedule lies at the golden-ratio point frac(i * 0.618...) of the unit
interval, which the sources' target shares divide; slots are ranked per source. Each
source's documents are shuffled by a hash, and its running words, three passes over them
at most, are cut into blocks of equally many words. The slot of rank r takes block r of
its source, and what no slot takes is not in the mix: the schedule alone decides what is
taken and when. A source is thus given its share to within a few blocks, in every prefix too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import before_part, in_order, with_row_id, word_count, written

#: Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots of a schedule at least, and words of a block at most: a larger corpus has more slots.
LEAST_SLOTS, MOST_WORDS = 1 << 18, 1024
#: Slots whose ranks are counted together, and slots that meet the sources' shares in one cell.
RUN, CELL = 1 << 14, 64
#: Most times that a document's words may be taken.
MOST_PASSES = 3
#: Rows in a part of a source's shuffled order, about; running sums are taken within parts, then over parts.
PART_ROWS, LEAST_PARTS = 20_000, 256


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_PASSES) -> DataFrame:
    """One row per source (source, source_size) with source_no, weight and target, and ``part`` and ``place`` of its number.

    Sources go by code point, null last; weights repeat ``cycle``. The targets share the
    sum of all sizes by weight, none above ``most`` times its source's size: the excess is
    reshared by weight until none is above. Each resharing is one sum over the sources.
    """
    named = in_order(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "sources")
    number = F.col("place") + F.col("ahead")
    named = named.join(before_part(named, F.lit(1), "ahead"), "part").withColumn("source_no", number.cast("long")).drop("ahead")
    weight = F.get(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("source_no") % len(cycle)).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    total = named.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.col("cap") > F.col("weight") * level
        held = named.agg(F.sum(F.when(~free, F.col("cap"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("weights")).first()
        if not held.weights or (now := (total - (held.full or 0.0)) / held.weights) <= level:
            break
        level = now
    return named.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap")


def slot_count(words: int) -> int:
    return max(LEAST_SLOTS, -(-words // MOST_WORDS))


def points(spark, slots: int) -> DataFrame:
    """(slot, x): the golden-ratio point of each slot, by halves of the slot's number so that no digits are lost."""
    half = 1 << 20
    step = half * 0.6180339887498948482 % 1.0
    x = F.floor(F.col("id") / half) * F.lit(step) + F.col("id") % half * F.lit(GOLDEN)
    return spark.range(slots).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("x"))


def schedule(shares: DataFrame, slots: int, at: DataFrame | None = None) -> DataFrame:
    """(source_no, rank, slot): the slots of each source in order. ``shares`` is of ``targets``; ``at`` (slot, x) are the points.

    Ranks are counted in runs of slots and then over the runs, so a source with a third of all slots is no one task's work.
    """
    cells = max(1, slots // CELL)
    whole = shares.agg(F.sum("target")).first()[0] or 0.0
    if whole <= 0:
        return shares.select("source_no", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("slot")).limit(0)
    upto = Window.partitionBy("part").orderBy("place")
    ends = shares.join(before_part(shares, F.col("target"), "ahead"), "part")
    # A source ends where the next one begins, to the last digit: both are the same sum.
    high = (F.col("ahead") + F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, 0))) / whole
    low = (F.col("ahead") + F.coalesce(F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / whole
    last_no = shares.where("target > 0").agg(F.max("source_no")).first()[0]
    cuts = ends.select("source_no", "target", low.alias("low"), F.when(F.col("source_no") == last_no, 2.0).otherwise(high).alias("high")).where("target > 0")

    def cell(x: Column) -> Column:
        return F.least(F.floor(x * cells), F.lit(cells - 1).cast("long"))

    cuts = cuts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    at = (points(shares.sparkSession, slots) if at is None else at).withColumn("cell", cell(F.col("x")))
    hit = at.join(cuts, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("source_no", "slot", F.expr(f"slot div {RUN}").alias("run"))
    hit = written(hit, "slots")
    runs = hit.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_no", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    return hit.withColumn("within", within).join(runs, ["source_no", "run"]).select("source_no", (F.col("ahead") + F.col("within")).cast("long").alias("rank"), "slot")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str = "row_id", slots: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """(row, key, source, size, source_size, target, taken, first_slot) of each row that has ``row``, a unique id.

    size: words of the text (null: 0). taken: words that the mix takes, repeats counted: those
    of the blocks that slots of the document's source take, so a source's sum is within a few
    blocks of its target and a document's within three times its size. first_slot: the first
    slot that takes a word (null: none). A block may cut a document. The order depends on keys
    and texts alone, ties on the row id, so reruns agree. Sources that are null are one source;
    null keys and repeated rows are rows like others; no rows or no words: nothing is taken.
    ``slots`` and ``at`` replace the schedule's length and its points.
    """
    base = docs.select(
        F.col(row).alias("row_id"), F.col(key).alias("k"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("h")
    )
    base = written(base, "sizes")
    shares = written(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "shares")
    sums = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    slots = slots or slot_count(sums.words)
    block = max(1, -(-sums.words // slots))
    # So many slots as blocks make up all words: with a block rounded up there are fewer.
    slots = max(1, -(-sums.words // block))
    ordered = written(schedule(shares, slots, at), "schedule")
    given = ordered.groupBy("source_no").agg(F.count("*").alias("blocks"))
    facts = shares.join(given, "source_no", "left").select("source", "source_no", "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    facts = F.broadcast(facts) if facts.count() <= 100_000 else facts
    rows = max(1, base.count())
    bits = max(LEAST_PARTS - 1, rows // PART_ROWS).bit_length()
    placed = base.join(facts, base["source"].eqNullSafe(facts["source"])).select("row_id", "k", base["source"], "size", "h", "source_size", "source_no", "target", "blocks")
    placed = placed.withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_no", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("source_no", "part").orderBy("h", "k", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["source_no", "part"])
    start = F.col("part_start") + F.col("inner_start") + F.col("pass") * F.col("source_size")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))).otherwise(F.array(F.lit(0)))
    turns = placed.withColumn("pass", F.explode(passes)).withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    # Blocks that a source has no slot for find none in the join; those past its last slot are not even sent there.
    met = (F.col("size") > 0) & (F.expr(f"start div {block}") < F.col("blocks"))
    turns = turns.where(met | (F.col("pass") == 0))
    # Rows of which nothing is taken get ranks that no slot has, all different ones, so that they are dealt evenly.
    ranks = F.when(met, F.sequence(F.expr(f"start div {block}"), F.least(F.expr(f"(end - 1) div {block}"), F.col("blocks") - 1))).otherwise(F.array(-1 - F.shiftrightunsigned("h", 1)))
    pieces = turns.withColumn("rank", F.explode(ranks))
    words = F.least("end", (F.col("rank") + 1) * block) - F.greatest("start", F.col("rank") * block)
    slotted = pieces.withColumn("words", F.when(F.col("rank") >= 0, words)).join(ordered, ["source_no", "rank"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0))
    found = slotted.groupBy("row_id", "k", "source", "size", "source_size", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"))
    return found.withColumnRenamed("row_id", row).withColumnRenamed("k", key)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``mixed`` of documents without a row id; see there."""
    return mixed(with_row_id(docs.select(key, text, source), "_row"), key, text, source, "_row")
