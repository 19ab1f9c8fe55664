"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

1. quality: documents whose expected rating is not good go (toxic or poor ones).
2. line_dedup: lines that repeat, or nearly repeat, an earlier line go; documents without a line left go.
3. simhash: of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more, found by SimHash and
   verified on whole texts) the document with the least id stays.
4. decontamination: documents that hold a benchmark item go.
5. mixing: documents that the mix takes stay, with how many words it takes and when first.

The first four return the columns of their input; ``n_chars``, where there, follows the text.
Columns of any other name are carried through, whatever they are called; ``mix_words`` and ``mix_slot`` of the input are
replaced by the last stage's own. Null and empty texts pass the first stage as the model says, keep their lines, and are near-duplicates of one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, line_dedup, mixing, quality, simhash
from corvane.llm.common import BROADCAST_IDS, sent, table, with_row_id, written


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = unused(docs, "rating")
    rated = quality.graded(docs, quality.fit(docs, ratings), out=out)
    return rated.where(F.col(out)["keep"]).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = unused(docs, "row")
    out = line_dedup.deduped(with_row_id(docs, row), row=row, carry=others).where("n_kept > 0 or n_lines = 0")
    changed = F.col("n_kept") < F.col("n_lines")
    facts = {"doc_id": F.col("doc_id"), "text": F.col("clean_text")} | {c: F.col("carried")[c] for c in others}
    if "n_chars" in facts:
        facts["n_chars"] = F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(facts["n_chars"])
    return out.select(*[facts[c].alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, order = unused(docs, "row"), unused(docs, "order")
    rows = with_row_id(docs, row)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = simhash.similar_texts(rows.select(place.alias(order), row, "text"), order, row=row)
    gone = written(groups.where(F.col(order) != F.col("component_id")).select(row), "copies")
    return rows.join(sent(gone, BROADCAST_IDS), row, "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def in_the_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = unused(docs, "row")
    rows = with_row_id(docs, row)
    mix = mixing.mixed(rows, row=row).where("taken > 0").select(row, F.col("taken").alias("mix_words"), F.col("first_slot").alias("mix_slot"))
    own = [c for c in docs.columns if c.lower() not in ("mix_words", "mix_slot")]
    return rows.select(*own, row).join(mix.hint("shuffle_hash"), row).select(*own, "mix_words", "mix_slot")


STAGES = [("quality", good), ("line_dedup", fresh_lines), ("simhash", one_of_each), ("decontamination", clean), ("mixing", in_the_mix)]

#: SQL cannot express the fitted model nor the hashed schedule; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
