"""Labels from an external coder (STG08): batches are requests of the connector, so answers are archived as they came and replayed.

An answer is JSON: ``model``, ``is_error`` and ``labels``, one object per item under the item's place in its batch,
from 1. Coders never see the items' ids. A failed call is kept as one and made again by the next run.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.connector import Policy, Send, fetched, keyed, usage

ANSWER = "struct<model:string,labels:array<map<string,string>>>"


class CallFailed(OSError):
    """The coder answered that it failed."""


def _checked(send: Send) -> Send:
    """A sender for which an answer that states an error is a failed call, so it is not replayed as an answer."""

    def checked(url: str, params: dict, headers: dict):
        got = send(url, params, headers)
        try:
            answer = json.loads(got[2])
        except ValueError:
            return got
        if isinstance(answer, dict) and answer.get("is_error"):
            raise CallFailed
        return got

    return checked


def requests(batches: DataFrame, items: DataFrame, coder: str, task: str, version: str, rep: int) -> DataFrame:
    """(batch, ids, source, kind, url, params) of ``batches`` (batch, ids) of ``items`` (item_id, text)."""
    placed = batches.select("batch", "ids", F.posexplode("ids").alias("place", "item_id")).join(items.select("item_id", "text"), "item_id")
    shown = F.struct((F.col("place") + 1).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = placed.groupBy("batch").agg(F.first("ids").alias("ids"), F.to_json(F.array_sort(F.collect_list(shown))).alias("items"))
    params = F.create_map(F.lit("items"), F.col("items"), F.lit("rep"), F.lit(str(rep)), F.lit("version"), F.lit(version))
    return rows.select("batch", "ids", F.lit(coder).alias("source"), F.lit("label").alias("kind"), F.lit(task).alias("url"), params.alias("params"))


def labelled(asked: DataFrame, archive: str, send: Send, model: str, labels: list[str], most_calls: int | None = None, today: dt.date | None = None, offline: bool = False) -> DataFrame:
    """(request_id, item_id, value, missing) of each item of ``asked``, see ``requests``; missing says why a label lacks.

    ``most_calls`` bounds each coder's calls of this run; past it ``CapReached`` is raised, and a rerun goes on from the archive.
    """
    spark, day = asked.sparkSession, today or dt.datetime.now(dt.UTC).date()
    made = {r.source: r.usd for r in usage(spark, archive).where((F.col("day") == F.lit(day)) & (F.col("kind") == "label")).groupBy("source").agg(F.sum("usd").alias("usd")).collect()}
    coders = [r.source for r in asked.select("source").distinct().collect()]
    policies = {c: Policy(prices={"label": 1.0}, cap=None if most_calls is None else made.get(c, 0.0) + most_calls, attempts=1) for c in coders}
    got = fetched(asked, archive, policies, _checked(send), offline=offline, strict="cap" if not offline else True, today=day)
    ids = asked.select("batch", "ids").join(keyed(asked, "batch").select("batch", F.col("key").alias("request_id")), "batch")
    return parsed(ids.join(got.select(F.col("key").alias("request_id"), "status", F.decode("content", "utf-8").alias("answer")).dropDuplicates(["request_id"]), "request_id"), model, labels)


def parsed(rows: DataFrame, model: str, labels: list[str]) -> DataFrame:
    """(request_id, item_id, value, missing) of answers (request_id, ids, status, answer); nothing is inferred from neighbours."""
    rows = rows.select("request_id", "status", F.posexplode("ids").alias("place", "item_id"), F.from_json("answer", ANSWER).alias("got"))
    mine = F.filter("got.labels", lambda x: F.trim(x["key"]) == (F.col("place") + 1).cast("string"))
    rows = rows.withColumn("mine", mine).withColumn("one", F.get("mine", F.lit(0)))
    used = F.col("got.model")
    other = used.isNotNull() & (used != "") & ~used.contains(model) & ~F.lit(model).contains(used)
    label = F.col("one")["label"]
    missing = (
        F.when(F.col("status").isNull(), "call_failed").when(other, "wrong_model").when(F.col("got.labels").isNull(), "unparseable")
        .when(F.size("mine") != 1, "absent").when(label.isNull() | ~label.isin(*labels), "invalid")
    )
    value = F.map_filter("one", lambda k, v: (k != "key") & v.isNotNull())
    return rows.select("request_id", "item_id", F.when(missing.isNull(), value).alias("value"), missing.alias("missing"))
