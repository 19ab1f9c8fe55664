"""Documents scored by a recurrent language model learned from the corpus.

Word counts cover every training document. Executors learn replicas of one GRU, each on
its own share of all training documents, and the replicas are averaged by their tokens, by
streamed sums in executors. A word outside the bounded table that executors hold is
looked up by a join, so counts are exact whatever the vocabulary.

The model's probability of a token is P(class | state) times P(word | class): the
latter from the state for core words, from smoothed counts within the class for all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import gru
from corvane.llm.common import written

#: Words that executors hold at most, additive smoothing, tokens that a replica learns from at least.
TABLE, SMOOTH, REPLICA = 1 << 17, 0.1, 1_000_000
#: Parameters of a row while replicas are averaged.
CHUNK = 4096
#: The token after a text's last word.
END = ""
#: Rows of an Arrow batch, words of partial counts that a task holds, tokens that are laid out in lanes at once.
BATCH_ROWS, HELD_WORDS, LAID_OUT = 4096, 300_000, 4_000_000


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its key as text, modulo 10, is 0 (null key: of no text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts one after another, how many each has), A-Z lower-cased; null: none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    # A text that is blank at an end splits off an empty word there.
    real = pc.not_equal(flat, "")
    owner = owner.filter(real).to_numpy(zero_copy_only=False)
    return flat.filter(real), np.bincount(owner, minlength=len(texts))


def ending(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")[-2:]) % gru.ENDINGS


def endings(found: pa.Array) -> np.ndarray:
    """The ending's class of each word, computed once for each pair of last bytes."""
    if not len(found):
        return np.zeros(0, dtype=np.int32)
    coded = pc.binary_slice(found.cast(pa.binary()), -2, None).dictionary_encode()
    each = np.array([zlib.crc32(tail) % gru.ENDINGS for tail in coded.dictionary.to_pylist()], dtype=np.int32)
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    column = batch.column(batch.schema.get_field_index("text"))
    return column.cast(pa.string()) if column.type != pa.string() else column


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: merged again and again, given out where they grow large."""
    parts: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    ends = 0
    for batch in batches:
        tally = words(_texts(batch))[0].value_counts()
        parts.append(pa.table({"word": tally.field("values"), "c": tally.field("counts")}))
        ends += batch.num_rows
        if sum(map(len, parts)) > 2 * HELD_WORDS:
            parts[:] = [merged()]
            if len(parts[0]) > HELD_WORDS:
                yield from parts.pop().combine_chunks().to_batches(1 << 16)
    if parts:
        yield from merged().combine_chunks().to_batches(1 << 16)
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], ["word", "c"])


@contextmanager
def small_batches(spark: SparkSession):
    """Actions within send rows to Python in batches of ``BATCH_ROWS``: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all training documents; the end of a text is the empty word."""
    parts = training.select(F.col(text).alias("text")).mapInArrow(_count, "word string, c long")
    return written(parts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Encoded:
    """Tokens of texts one after another, each text ended: what the model reads, table numbers or -1, the text of each."""

    tokens: np.ndarray
    numbers: np.ndarray
    text: np.ndarray
    sizes: np.ndarray
    rare: pa.Array  # words that the table lacks
    rare_text: np.ndarray

    def each(self) -> list[np.ndarray]:
        return np.split(self.tokens, np.cumsum(self.sizes)[:-1])


class Lexicon:
    """The bounded table of the most frequent words, and the sums that cover all words."""

    def __init__(self, table: list[tuple[str, int]], total: int, distinct: int) -> None:
        table = sorted(table, key=lambda x: (-x[1], x[0]))
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in table], pa.string())
        self.counts = np.array([c for _, c in table], dtype=np.float64)
        self.core = min(gru.WORDS, len(table))
        #: What the model reads for each table word: itself, or the class of its ending.
        self.token = np.array([i if i < self.core else gru.WORDS + ending(w) for i, (w, _) in enumerate(table)], dtype=np.int32)
        self.class_total = np.zeros(gru.ENDINGS)
        self.class_words = np.zeros(gru.ENDINGS)

    @property
    def class_mass(self) -> np.ndarray:
        return self.class_total + SMOOTH * (self.class_words + 1)

    @property
    def base_log(self) -> float:
        return np.log10(self.total + SMOOTH * (self.distinct + 1))

    def encode(self, texts: pa.Array) -> Encoded:
        found, sizes = words(texts)
        n, ends = len(texts), np.cumsum(sizes + 1) - 1
        place = np.ones(len(found) + n, dtype=bool)
        place[ends] = False
        numbers = np.full(len(place), -1, dtype=np.int32)
        known = pc.fill_null(pc.index_in(found, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        numbers[place] = known
        numbers[ends] = pc.fill_null(pc.index_in(pa.array([END]), value_set=self.words), -1)[0].as_py()
        text = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
        rare = found.filter(pa.array(known < 0))
        lacking = numbers < 0
        rare_text = text[lacking & place]
        if n and numbers[ends[0]] < 0:
            rare, rare_text = pa.concat_arrays([rare, pa.array([END] * n)]), np.concatenate([rare_text, np.arange(n)])
        tokens = self.token[numbers] if len(self.token) else np.zeros(len(numbers), dtype=np.int32)
        tokens[lacking & place] = gru.WORDS + endings(found.filter(pa.array(known < 0)))
        tokens[ends] = self.token[numbers[ends]] if n and numbers[ends[0]] >= 0 else gru.WORDS + ending(END)
        return Encoded(tokens, numbers, text, sizes + 1, rare, rare_text)


def lexicon(counts: DataFrame, most: int = TABLE) -> Lexicon:
    """The words that are frequent enough for at most ``most`` of them to be as frequent, and the sums over all."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # How many words have each count: as many rows as there are distinct counts, each seen once by the driver.
    least, so_far = 1 << 62, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(most).collect():
        so_far += r.k
        if so_far > most:
            break
        least = r.c
    table = counts.where(F.col("c") >= least).toArrow()
    lex = Lexicon(list(zip(table["word"].to_pylist(), table["c"].to_pylist())), int(sums.n), int(sums.v))
    core = lex.words[: lex.core]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pc.invert(pc.is_in(batch.column("word"), value_set=core))
            kinds, c = endings(batch.column("word").filter(kept)), batch.column("c").filter(kept).to_numpy(zero_copy_only=False)
            sums = np.bincount(kinds, weights=c, minlength=gru.ENDINGS).astype(np.int64), np.bincount(kinds, minlength=gru.ENDINGS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(gru.ENDINGS)), pa.array(sums[0]), pa.array(sums[1])], ["kind", "c", "v"])

    for r in counts.mapInArrow(classed, "kind long, c long, v long").groupBy("kind").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        lex.class_total[r.kind], lex.class_words[r.kind] = r.c, r.v
    return lex


def learn(training: DataFrame, lex: Lexicon, text: str = "text", replica: int = REPLICA) -> np.ndarray:
    """Parameters averaged over replicas, each learned from a share of all training documents in one pass."""
    context = training.sparkSession.sparkContext
    start = gru.initial(lex.counts[: lex.core], lex.class_mass)
    held = context.broadcast((lex, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, start = held.value
        model, seen, held_tokens = gru.Gru(start), 0, []
        for batch in batches:
            held_tokens += lex.encode(_texts(batch)).each() if batch.num_rows else []
            if sum(map(len, held_tokens)) >= LAID_OUT:
                seen += model.learn(held_tokens)
                held_tokens = []
        seen += model.learn(held_tokens)
        if seen:
            parts = [model.flat[at : at + CHUNK] for at in range(0, gru.SIZE, CHUNK)]
            n = len(parts)
            columns = [pa.array(np.arange(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "replica", "weight", "part"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, weight, part in zip(batch["chunk"], batch["weight"], batch["part"]):
                at = sums.setdefault(chunk, [0.0, 0.0])
                at[0] += float(weight)
                at[1] = at[1] + weight * np.asarray(part, dtype=np.float64)
        for chunk, (weight, total) in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "part": [total / weight]})

    texts = training.select(F.col(text).alias("text"))
    shares = max(1, lex.total // replica)
    replicas = texts.coalesce(min(shares, 1 << 30)).mapInArrow(run, "chunk int, replica int, weight long, part array<float>")
    mean = replicas.repartition("chunk").sortWithinPartitions("chunk", "replica").mapInPandas(add, "chunk int, part array<double>").collect()
    flat = start.copy()
    for r in mean:
        flat[r.chunk * CHUNK : r.chunk * CHUNK + len(r.part)] = r.part
    return flat


def _grouped(found: pa.Array, text: np.ndarray, n: int) -> pa.Array:
    """Lists of (word, times) of each of n texts."""
    counts = pa.table({"text": pa.array(text, pa.int64()), "word": found}).group_by(["text", "word"]).aggregate([([], "count_all")]).sort_by("text").combine_chunks()
    cuts = np.searchsorted(counts["text"].to_numpy(), np.arange(n + 1))
    word = counts["word"].combine_chunks() if len(counts) else pa.array([], pa.string())
    times = counts["count_all"].combine_chunks().cast(pa.int32()) if len(counts) else pa.array([], pa.int32())
    pairs = pa.StructArray.from_arrays([word, times], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)


def _facts(e: Encoded, lex: Lexicon, mass_log: np.ndarray, count_log: np.ndarray) -> tuple:
    """Of each text: tokens, known ones, base score and the fixed part of the model's, and the words that a join has to find."""
    n = len(e.sizes)
    known, other = e.numbers >= 0, e.tokens >= gru.WORDS

    def total(where: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(e.text[where], weights=values, minlength=n)

    base = total(known, count_log[e.numbers[known]]) - lex.base_log * e.sizes
    fixed = total(known & other, count_log[e.numbers[known & other]]) - total(other, mass_log[e.tokens[other] - gru.WORDS])
    return e.sizes.astype(np.int64), total(known).astype(np.int64), base, fixed, _grouped(e.rare, e.rare_text, n)


SCORED = "n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:int>>"


def score(rows: DataFrame, lex: Lexicon, flat: np.ndarray, counts: DataFrame, text: str = "text", key: str = "k") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of each row's whole text; logs to base 10.

    Texts are read once: what is found is written with the key, and rows get their ids there.
    """
    kind = rows.schema[key].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((lex, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, flat = held.value
        model = gru.Gru(flat)
        mass_log, count_log = np.log10(lex.class_mass), np.log10(lex.counts + SMOOTH)
        keys, facts, tokens = [], [], []

        def out() -> pa.RecordBatch:
            size, known, base, fixed, rare = (list(x) for x in zip(*facts))
            chance = model.score(tokens) / np.log(10) + np.concatenate(fixed)
            columns = [pa.concat_arrays(keys), *[pa.array(np.concatenate(x)) for x in (size, known, base)], pa.array(chance), pa.concat_arrays(rare)]
            for x in (keys, facts, tokens):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "n_known", "base", "score", "rare"])

        for batch in batches:
            if batch.num_rows:
                e = lex.encode(_texts(batch))
                keys.append(batch.column("k"))
                facts.append(_facts(e, lex, mass_log, count_log))
                tokens += e.each()
            if sum(map(len, tokens)) >= LAID_OUT:
                yield out()
        if tokens:
            yield out()

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, {SCORED}")
    scored = written(found.withColumn("row_id", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.n")
    met = rare.join(counts, "word", "left")
    more = met.groupBy("row_id").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")
    )
    out = scored.drop("rare").join(more, "row_id", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(F.col("k").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Null and blank texts have one token, their end. Repeated rows are each learned from and
    scored; null keys are held out. No training document: every word is unknown, and the model
    is as it starts. No rows: no rows.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    training = rows.where(~held_out(F.col("k")))
    with small_batches(docs.sparkSession):
        counts = word_counts(training)
        lex = lexicon(counts)
        flat = learn(training, lex)
        found = score(rows, lex, flat, counts)
    return found.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
