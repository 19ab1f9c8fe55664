"""Runs as rows: what a stage read and wrote, under which settings (SRC27, SRC28, FLT10, JOIN23, SRT02, STG11)."""

from __future__ import annotations

import datetime
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tables import content_hash, keyed, write_table

RUN = "run_id string, stage string, case_id string, fold string, status string, started timestamp, ended timestamp, components map<string,string>, params string, inputs array<struct<path:string,hash:string>>, outputs array<struct<name:string,path:string,hash:string,rows:bigint>>"


def load_settings(kind: type, path: str):
    """A settings dataclass from a JSON (or, if a reader is installed, YAML) file; unknown and missing names raise."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    known = {f.name for f in fields(kind)}
    if set(data) - known:
        raise ValueError(f"unknown settings {sorted(set(data) - known)}")
    return kind(**data)


@dataclass
class Run:
    """One execution of a stage; its row is written when it ends, also when it fails."""

    spark: SparkSession
    log: str
    stage: str
    case_id: str
    fold: str
    components: dict[str, str]
    params: dict = field(default_factory=dict)
    inputs: list[tuple[str, str]] = field(default_factory=list)
    outputs: list[tuple[str, str, str, int]] = field(default_factory=list)

    def __enter__(self) -> Run:
        self.started = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        self.run_id = f"{self.started:%Y-%m-%dT%H%MZ}-{self.stage}-{self.case_id}-{abs(hash((self.started, self.stage))) % 65536:04x}".lower()
        return self

    def store(self, name: str, df: DataFrame, root: str) -> str:
        """Write a declared table under its content's hash; one that is whole already is not written again, one that a failed write left is."""
        table = keyed(name, df)
        digest = content_hash(table)
        path = f"{root}/{name}-{digest}"
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            files.delete(target, True)
            write_table(name, df, path)
        self.outputs.append((name, path, digest, int(digest.split("-")[0])))
        return path

    def __exit__(self, kind, error, trace) -> bool:
        ended = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        row = (self.run_id, self.stage, self.case_id, self.fold, "failed" if kind else "done", self.started, ended, self.components, json.dumps(self.params, sort_keys=True, default=asdict), self.inputs, self.outputs)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.log)
        return False


def read_runs(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(log)


def latest_run(runs: DataFrame, stage: str, case_id: str, fold: str, components: dict[str, str]) -> DataFrame:
    """The newest finished run of a stage under the same components; none or one row."""
    same = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("components")))) == json.dumps(dict(sorted(components.items())), separators=(",", ":"))
    rows = runs.where((F.col("stage") == stage) & (F.col("case_id") == case_id) & (F.col("fold") == fold) & (F.col("status") == "done") & same)
    return rows.orderBy(F.desc("started"), F.desc("run_id")).limit(1)


def recent_runs(runs: DataFrame, most: int) -> DataFrame:
    return runs.orderBy(F.desc(F.date_trunc("minute", "started")), F.desc("ended"), F.desc("run_id")).limit(most)


def outputs(runs: DataFrame) -> DataFrame:
    """(run_id, name, path, hash, rows) of what runs wrote."""
    return runs.select("run_id", F.explode("outputs").alias("o")).select("run_id", "o.*")


def verify_run(spark: SparkSession, runs: DataFrame, run_id: str) -> list[str]:
    """Outputs of a run whose content is no longer what was recorded."""
    bad = []
    for o in outputs(runs.where(F.col("run_id") == run_id)).collect():
        if content_hash(spark.read.parquet(o.path)) != o.hash:
            bad.append(o.name)
    return bad
