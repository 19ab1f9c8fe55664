"""Row ids and results stay the same when scans are split in other ways between jobs, as lost or added executors make them."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corvane.llm import line_dedup, lm_scoring, mixing, simhash, warc
from corvane.llm.common import with_row_id

SPLITS = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def many_files(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    for name, files in (("documents", 7), ("pages", 5)):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.union(df.limit(40)).repartition(files).write.option("parquet.block.size", 65536).parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def splits(spark):
    """A function that sets how scans are split from now on."""

    def put(n):
        spark.conf.set(SPLITS[0], str(n))
        spark.conf.set(SPLITS[1], "4m" if n > 4 else "64k")

    yield put
    for k in SPLITS:
        spark.conf.unset(k)


@pytest.fixture
def unsteady(splits, monkeypatch):
    """Every table is written, and so every scan after it made, under other splits than the one before."""
    write, turn = DataFrameWriter.parquet, [0]

    def parquet(self, *args, **more):
        turn[0] += 1
        splits((2, 16)[turn[0] % 2])
        return write(self, *args, **more)

    def start():
        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)

    return start


def test_ids_do_not_depend_on_splits(spark, many_files, splits):
    found = []
    for n in (2, 16):
        splits(n)
        rows = with_row_id(spark.read.parquet(f"{many_files}/documents.parquet").where("doc_id is not null"))
        found.append({(r.row_id.file, r.row_id.place): r.doc_id for r in rows.select("row_id", "doc_id").collect()})
    assert found[0] == found[1] and len(found[0]) == 1040
    made = with_row_id(spark.range(10).withColumn("x", F.rand()))
    assert made.collect() == made.collect() and made.select("row_id").distinct().count() == 10
    joined = spark.read.parquet(f"{many_files}/documents.parquet").join(spark.range(2), F.lit(True))
    assert with_row_id(joined).select("row_id").distinct().count() == 2080


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def warc_marks(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    place = warc.archive_folder(spark)
    return warc.read_archives(warc.archive(pages, place), place, with_payload=False).select("page_id", "payload_digest", "record_type", "refers_to")


def stage(name):
    def run(spark, folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        return dict(cp.STAGES)[name](spark, docs, folder)

    return run


@pytest.mark.parametrize(
    "run",
    [
        lambda s, f: line_dedup.dedup(s.read.parquet(f"{f}/documents.parquet")),
        lambda s, f: mixing.mix(s.read.parquet(f"{f}/documents.parquet")),
        lambda s, f: lm_scoring.score_documents(s.read.parquet(f"{f}/documents.parquet")).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6)),
        lambda s, f: simhash.near_duplicates(s.read.parquet(f"{f}/documents.parquet")),
        warc_marks,
        stage("line_dedup"),
        stage("simhash"),
        stage("mixing"),
    ],
    ids=["lines", "mix", "lm", "simhash", "warc", "stage lines", "stage simhash", "stage mixing"],
)
def test_results_do_not_depend_on_splits(spark, many_files, splits, unsteady, run):
    splits(2)
    want = rows_of(run(spark, many_files))
    unsteady()
    assert rows_of(run(spark, many_files)) == want
