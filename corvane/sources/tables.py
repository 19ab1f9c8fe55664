"""Declared tables with keys, and the readers and writers of the batch stages (SRC01-SRC08, SRC16, SRC28-SRC30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.core import keep_first, nulls_last

#: The stored tables, their columns in order, and their keys.
SCHEMAS = {
    "works": "work_id string, doi string, title string, year int, venue_id string, venue_name string, type string, cited_by_count bigint, source string",
    "authors": "author_id string, display_name string, disambiguation_source string, confidence double",
    "authorships": "work_id string, author_id string, position string, institution_ids array<string>",
    "citations": "citation_id string, citing_work string, cited_work string",
    "frames": "case_id string, frame_id string, kind string, work_id string, year int",
    "overlap": "subject_a string, subject_b string, basis string, authors_a int, authors_b int, shared int, coefficient double, exceeds boolean",
    "ingested": "work_id string, venue string, volume string, issue string, first_page string, first_author string, document_url string",
    "contexts": "cited_work string, citing_doi string, citing_s2_id string, context_index int, text string, intents array<string>, is_influential boolean, source string",
    "scope": "lineage_id string, window_start int, window_end int, citing_work string, cited_work string",
    "member_contexts": "citing_work string, cited_work string, citing_doi string, context_index int, text string, intents array<string>, is_influential boolean, source string",
    "abstracts": "work_id string, abstract string, source string",
    "reference_positions": "citing_work string, cited_work string, position int, list_length int",
    "labels": "task string, subject string, item_id string, work_id string, coder_id string, rep int, label string, span string, missing string",
    "items": "item_id string, work_id string, text string, rule string",
    "pilot": "subject string, side string, coder_id string, direction string, stance string, share double, items int",
    "census_sample": "case_id string, frame_id string, year int, work_id string, status string, reference_source string, refs int, resolved int, refs_excluded int, refs_unclassifiable int, doiless int, doiless_sampled int, doiless_matched int, doiless_rescued int, doiless_unparseable int",
    "coverage": "case_id string, frame_id string, kind string, year int, frame_works int, frame_works_excluded int, sampled int, measured int, unmeasured int, refs int, resolved int, refs_excluded int, refs_unclassifiable int, doiless int, doiless_sampled int, doiless_matched int, doiless_rescued int, doiless_unparseable int, resolved_estimated double",
    "clusters": "method string, resolution double, window_start int, window_end int, cluster int, author string",
    "lineages": "method string, resolution double, lineage_id string, window_start int, window_end int, cluster int, members int, parent string, overlap double",
    "leakage": "item_id string, subject string, coder_id string, request_id string, guess string, confidence double, missing string",
    "audits": "kind string, item_id string, coder_id string, rep int, subject string, label string, reason_span string, missing string",
    "eligibility": "resolution double, lineage_id string, window_start int, window_end int, members int, citations_on_claim int, disconfirmations int, coverage double, closed boolean, meets_m boolean, meets_v boolean, meets_r boolean",
}
KEYS = {
    "works": ["work_id"], "authors": ["author_id"], "authorships": ["work_id", "author_id", "position"], "citations": ["citation_id"], "frames": ["case_id", "frame_id", "work_id"],
    "overlap": ["subject_a", "subject_b"], "ingested": ["work_id"], "contexts": ["cited_work", "citing_s2_id", "context_index"], "scope": ["lineage_id", "window_start", "citing_work", "cited_work"],
    "member_contexts": ["citing_work", "cited_work", "context_index"], "abstracts": ["work_id"], "reference_positions": ["citing_work", "cited_work", "position"], "labels": ["task", "coder_id", "item_id", "rep"],
    "items": ["item_id"], "pilot": ["subject", "coder_id", "direction", "stance"], "census_sample": ["case_id", "frame_id", "year", "work_id"], "coverage": ["case_id", "frame_id", "year"],
    "clusters": ["method", "resolution", "window_start", "window_end", "author"], "lineages": ["method", "resolution", "window_start", "window_end", "cluster"], "leakage": ["coder_id", "item_id"],
    "audits": ["kind", "coder_id", "item_id", "rep"], "eligibility": ["resolution", "window_start", "lineage_id"],
}


def conform(name: str, df: DataFrame) -> DataFrame:
    """Declared columns in order and type: unknown ones dropped, missing ones null."""
    from pyspark.sql.types import StructType

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])])


def keyed(name: str, df: DataFrame, order: list | None = None) -> DataFrame:
    """``conform`` with the first row of each key, in ``order`` (by default the row order as read)."""
    rows = df if order else df.withColumn("_seq", F.monotonically_increasing_id())
    first = keep_first(rows, KEYS[name], order or ["_seq"])
    return conform(name, first)


def write_table(name: str, df: DataFrame, path: str, order: list | None = None) -> None:
    """Write once, sorted by key with nulls last: range-partitioned, so each file is sorted and no task sorts all."""
    keyed(name, df, order).orderBy(*nulls_last(*KEYS[name])).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files: sums of row hashes."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) if t != "map" else F.to_json(c) for c, t in df.dtypes]
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25, 37)]
    row = df.agg(F.count("*"), *parts).first()
    return "-".join(str(x or 0) for x in row)


# ---- sheets


MANUAL = "work_id string, ref_index string, ref_text string, doi string, entered_by string, entered_on string"


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """(work_id, refs) of a sheet of references entered by hand; refs in order. Raises on rows that break its rules."""
    from corvane.functions.ids import normalize_doi

    rows = spark.read.csv(path, header=True, schema=MANUAL, mode="FAILFAST", enforceSchema=False)
    return grouped_manual(rows, normalize_doi)


def grouped_manual(rows: DataFrame, doi) -> DataFrame:
    bad = F.coalesce(F.trim("work_id"), F.lit("")) == ""
    bad = bad | (F.coalesce(F.trim("ref_text"), F.lit("")) == "") | (F.coalesce(F.trim("entered_by"), F.lit("")) == "")
    number = F.expr("try_cast(ref_index AS int)")
    checked = rows.withColumn("ref_index", F.when(bad | number.isNull(), F.raise_error(F.lit("a row lacks its work, text, hand or number")).cast("int")).otherwise(number))
    lists = checked.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ref_index", doi(F.col("doi")).alias("doi"), F.col("ref_text").alias("text")))).alias("refs"))
    twice = F.size(F.array_distinct(F.transform("refs", lambda r: r["ref_index"]))) < F.size("refs")
    return lists.withColumn("refs", F.when(twice, F.raise_error(F.concat(F.lit("a reference is entered twice for "), F.col("work_id"))).cast(lists.schema["refs"].dataType)).otherwise(F.col("refs")))


def audit_counts(references: DataFrame, works: DataFrame, sample: DataFrame, verdicts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict counts, summed counts, works outside the sample) of completed audit sheets."""
    known = F.when(F.col("verdict").isin(*verdicts), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("")))).cast("string"))
    counts = references.select(known.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))
    missed = works.agg(F.sum(F.expr("try_cast(missed AS bigint)")).alias("missed"))
    return counts, missed, works.join(sample, "work_id", "left_anti")


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV of a small table, write-once, nulls as empty fields."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


# ---- archives


RESPONSE = "status int, body string"


def read_json_archive(spark: SparkSession, path: str, body: str) -> DataFrame:
    """(key, status, body) of archived responses; key is the file's name, body parsed by its DDL."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("key", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    parsed = F.from_json("value", f"struct<status:int,body:{body}>")
    return rows.select("key", parsed["status"].alias("status"), parsed["body"].alias("body"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(key, status, content_type, content) of archived documents: bytes joined to the JSON beside them."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)\.(?:bin|meta\.json)$", 1)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(stem(F.col("path")).alias("key"), "content")
    meta = spark.read.option("wholetext", True).option("pathGlobFilter", "*.meta.json").text(folder)
    meta = meta.select(stem(F.input_file_name()).alias("key"), F.from_json("value", "struct<status:int,content_type:string,url:string>").alias("m")).select("key", "m.*")
    return meta.join(content, "key", "left")


def append_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key the archive does not hold yet: the first write of a key stands."""
    return keep_first(rows.withColumn("_seq", F.monotonically_increasing_id()), [key], ["_seq"]).drop("_seq").join(existing.select(key), key, "left_anti")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON-lines log; a line that does not parse raises."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def verify_artifacts(spark: SparkSession, folder: str, recorded: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, added or changed against recorded SHA-256 sums."""
    from corvane.operators.core import table_diff

    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))
    return table_diff(recorded, found)


def markdown(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A report table of a small aggregate."""
    from corvane.functions.ids import percent

    shares = [c for c, t in df.dtypes if t == "double" and (c.endswith("share") or c == "coverage")]
    rows = df.select(*[percent(F.col(c)).alias(c) if c in shares else F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in columns]).limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])
