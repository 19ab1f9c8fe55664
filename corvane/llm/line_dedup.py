"""Near-duplicate lines by a deletion-neighbourhood join. DataFrame functions only.

Lines are compared by their words. Lines with equal words are one class. Two classes of
``LEAST_WORDS`` words or more are near when one word substituted, inserted or deleted turns
one into the other (so they share 0.8 or more of their words). Only lines that may have a
near one are expanded: of two lines at distance one, whose shorter has L words, the first
or the last L div 2 words are equal, so lines that share no such half are left out
exactly. The rest emit all variants with one word deleted as hashed keys. Equal variants
with the deletion at the same place are substitutions, a variant equal to a whole line is an
insertion. Keys are reduced to their earliest line before they are joined back, so a key that
a third of all lines holds costs one row a line, never a pair of lines. Joined lines are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import GAP, GAP_CHARS, with_row_id, written

#: Fewest words of a line that may be near another; shorter lines must be equal.
LEAST_WORDS = 5
#: Most documents, and candidate lines in them (four bytes each), that are sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 2_000_000
#: Columns that name a row.
ROW = ("file", "place")


def _hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _squeezed(line: Column) -> Column:
    """The words of a line joined by single spaces; most lines are so already."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for gap in GAP_CHARS.replace(" ", "").replace("\n", ""):
        odd = odd | line.contains(gap)
    return F.when(odd, F.regexp_replace(F.btrim(line, F.lit(GAP_CHARS)), GAP, " ")).otherwise(line)


def _size(squeezed: Column) -> Column:
    """Number of words of a squeezed line that has one."""
    return F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1


def _halves(squeezed: Column, n: Column) -> Column:
    def half(length: Column) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        return [F.xxhash64(F.lit(side), length, F.call_function("substring_index", squeezed, F.lit(" "), h if side else -h)) for side in (0, 1)]

    return F.array(*half(n), *half(n - 1))


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(GAP_CHARS)) != ""


def _place() -> Column:
    """What lines are ordered by: key (null last), row, place in the row."""
    return F.struct(F.col("k").isNull().alias("none"), "k", *ROW, "line_no")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def within_one(a: Column, b: Column) -> Column:
    """Whether one word substituted, inserted or deleted at most turns word array ``a`` into ``b``."""
    na, nb = F.size(a), F.size(b)
    least = F.least(na, nb)
    # The first difference: found among the places that differ, so long lines cost one pass.
    differ = F.when(least > 0, F.filter(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) != F.get(b, i)))
    start = F.coalesce(F.get(differ, F.lit(0)), least)

    def rest(x: Column, skip: Column) -> Column:
        return F.slice(x, start + skip + 1, F.size(x) + 1)

    one, none = F.lit(1), F.lit(0)
    return F.when(na == nb, rest(a, one) == rest(b, one)).when(na == nb + 1, rest(a, one) == rest(b, none)).when(nb == na + 1, rest(a, none) == rest(b, one)).otherwise(F.lit(False))


def _near_classes(classes: DataFrame, rows: DataFrame, least_words: int, broadcast_rows: int) -> DataFrame:
    """(h1, h2) of classes that an earlier class is near to."""
    long_lines = classes.where(F.col("n") >= least_words)
    keyed = long_lines.select("h1", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    maybe = keyed.join(shared, "half").select("h1").distinct()
    places = long_lines.join(maybe, "h1", "left_semi").select(*[f"first.{c}" for c in ROW], "first.line_no")
    by_row = written(places.groupBy(*ROW).agg(F.collect_list("line_no").alias("at")), "places-by-row")
    size = by_row.agg(F.count("*").alias("rows"), F.sum(F.size("at")).alias("lines")).first()
    small = size.rows <= broadcast_rows and (size.lines or 0) <= BROADCAST_LINES
    side = F.broadcast(by_row) if small else by_row.hint("shuffle_hash")
    found = rows.join(side, list(ROW)).select(*ROW, "k", _lines(F.col("t")).alias("lines"), F.explode("at").alias("line_no"))
    found = found.select(_place().alias("first"), _squeezed(F.get("lines", F.col("line_no"))).alias("line"))
    h1, h2 = _hashes(F.col("line"))
    found = found.select("first", h1.alias("h1"), h2.alias("h2"), F.split("line", " ").alias("words"))
    # Numbers in the order of the lines' first places stand for the lines from here on.
    found = written(found.orderBy("first").withColumn("no", F.monotonically_increasing_id()).drop("first"), "candidate-lines")
    keyed = written(_neighbourhoods(found), "neighbourhoods")
    deleted = F.col("deleted")
    earliest = keyed.groupBy("variant", "place").agg(F.min(F.when(deleted, F.col("no"))).alias("first_deleted"), F.count_if(deleted).alias("n"), F.min(F.when(~deleted, F.col("no"))).alias("whole"))
    earliest = earliest.where("n > 1 or (n = 1 and whole is not null)")
    met = keyed.join(earliest, ["variant", "place"])
    # Of one key: lines with a word substituted at its place, and a whole line that all of them have a word more than.
    earlier = F.when(deleted, F.array("first_deleted", "whole")).otherwise(F.array("first_deleted"))
    pairs = met.select("no", F.explode(earlier).alias("earlier")).where("earlier < no").distinct()
    texts = found.select("no", "h1", "h2", "words")
    joined = pairs.join(texts, "no").join(found.select(F.col("no").alias("earlier"), F.col("words").alias("before")), "earlier")
    return joined.where(within_one(F.col("words"), F.col("before"))).select("h1", "h2").distinct()


def _neighbourhoods(found: DataFrame) -> DataFrame:
    """(variant, place, deleted, no): the hashed variants of lines (no, words), in time linear in the words.

    A variant is hashed from sums of position-keyed word hashes, from the start up to its
    place and from the end back to it, so a word deleted between does not shift them. deleted:
    the word at the place is left out; else the line is whole, cut at the place.
    """
    low = (1 << 43) - 1
    words = found.repartition("no").select("no", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))

    def hashed(seed: int, position: Column) -> Column:
        return F.xxhash64(F.lit(seed), position, F.col("word")).bitwiseAND(F.lit(low))

    words = words.select("no", "n", "place", *[hashed(k, F.col("place")).alias(f"p{k}") for k in (0, 1)], *[hashed(k, F.col("n") - F.col("place")).alias(f"s{k}") for k in (2, 3)])
    line = Window.partitionBy("no").orderBy("place")
    ahead = [F.coalesce(F.sum(f"p{k}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"a{k}") for k in (0, 1)]
    behind = [F.coalesce(F.sum(f"s{k}").over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias(f"b{k}") for k in (2, 3)]
    sums = words.select("*", *ahead, *behind)

    def variant(place: Column, deleted: bool, *parts: Column) -> Column:
        return F.struct(F.xxhash64(*parts).alias("variant"), place.alias("place"), F.lit(deleted).alias("deleted"))

    here = F.col("place")
    out = [
        variant(here, True, F.col("a0"), F.col("a1"), F.col("b2"), F.col("b3")),
        variant(here, False, F.col("a0"), F.col("a1"), F.col("b2") + F.col("s2"), F.col("b3") + F.col("s3")),
    ]
    end = F.when(here == F.col("n") - 1, variant(here + 1, False, F.col("a0") + F.col("p0"), F.col("a1") + F.col("p1"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return sums.select("no", F.explode(F.array_compact(F.array(*out, end))).alias("v")).select("v.*", "no")


def deduped(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row_id", least_words: int = LEAST_WORDS, broadcast_rows: int = BROADCAST_ROWS, carry: list[str] | None = None) -> DataFrame:
    """(row, key, n_lines, n_kept, clean_text, and a struct ``carried`` of ``carry`` columns if given) of each row that has ``row``, a unique id.

    Lines end at newlines. A line goes if an earlier one has the same words or is near it;
    earlier by key (null last), row id and place. Lines without words stay and do not count
    in n_lines. A null text stays null; a text that loses all lines with words keeps its
    blank ones. No rows: no rows.
    """
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    in_two = "struct" in rows.schema[row].dataType.simpleString()
    named = [F.col(row)["file"].alias("file"), F.col(row)["place"].alias("place")] if in_two else [F.col(row).alias("file"), F.lit(0).alias("place")]
    rows = rows.select(*named, F.col(key).alias("k"), F.col(text).alias("t"), *carried)
    extra = ["carried"] if carry else []
    lines = rows.select(*ROW, "k", F.posexplode(_lines(F.col("t"))).alias("line_no", "line"))
    lines = lines.select(*ROW, "k", "line_no", _squeezed(F.col("line")).alias("line")).where("line != ''")
    h1, h2 = _hashes(F.col("line"))
    hashed = lines.select(*ROW, "k", "line_no", "line", _size(F.col("line")).alias("n"), h1.alias("h1"), h2.alias("h2"))
    hashed = hashed.select(*ROW, "k", "line_no", "n", "h1", "h2", F.when(F.col("n") >= least_words, _halves(F.col("line"), F.col("n"))).alias("halves"))
    hashed = hashed.select("*", *[F.get("halves", F.lit(i)).alias(f"half{i}") for i in range(4)])
    classes = hashed.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.min("n").alias("n"), *[F.min(f"half{i}").alias(f"half{i}") for i in range(4)])
    classes = written(classes.select("h1", "h2", "first", "n", F.array(*[f"half{i}" for i in range(4)]).alias("halves")), "line-classes")
    near = written(_near_classes(classes, rows, least_words, broadcast_rows), "near-lines")
    kept = classes.join(near, ["h1", "h2"], "left_anti").groupBy(*[F.col(f"first.{c}").alias(c) for c in ROW]).agg(F.collect_list("first.line_no").alias("kept"))
    out = rows.join(kept.hint("shuffle_hash"), list(ROW), "left")
    out = out.select(*ROW, "k", "t", *extra, _lines(F.col("t")).alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~_has_words(F.get("lines", i)))
    out = out.select(*ROW, "k", *extra, "lines", "kept", F.when(F.col("t").isNull(), F.array().cast("array<int>")).otherwise(blank).alias("blank"))
    clean = F.array_join(F.transform(F.sort_array(F.concat("kept", "blank")), lambda i: F.get("lines", i)), "\n")
    n_lines = F.coalesce(F.size("lines") - F.size("blank"), F.lit(0))
    return out.select((F.struct(*ROW) if in_two else F.col("file")).alias(row), F.col("k").alias(key), F.when(F.col("lines").isNull(), 0).otherwise(n_lines).alias("n_lines"), F.size("kept").alias("n_kept"), F.when(F.col("lines").isNotNull(), clean).alias("clean_text"), *extra)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_kept, clean_text) of each row; see ``deduped``."""
    rows = with_row_id(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return deduped(rows, "k", "t").withColumnRenamed("k", key).drop("row_id")
