"""Live answers of sources as a table: archive first, retries, rate limits, daily caps (SRC09, the asking half of SRC11-SRC16).

Requests are rows (source, kind, url, params). ``fetched`` takes what the archive holds from it and sends the
rest in rounds; a round is one task per source, as a source's rate allows no more, and is appended to the archive
before the next begins. The archive is one Parquet table of calls, so what was spent today is a sum over it. A round that
dies, or a task that is run again, repeats its calls: a lost executor costs a round of requests at most.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "source string, kind string, url string, params map<string,string>"
OUTCOME = "status int, content_type string, content binary, attempts int, usd double, problem string"
CALLS = f"key string, {REQUEST}, {OUTCOME}, day date, retrieved_at timestamp, terms string"
#: Requests of a source in a round; the pages of a listing that are kept on the driver as requests.
ROUND, FRONT = 500, 10_000
#: Attempts a request, seconds of the longest pause, statuses that settle a request of a kind or call for another attempt.
ATTEMPTS, LONGEST = 8, 60.0
SETTLED, PASSING = {"document": {200, 401, 403, 404, 410}, "label": {200}, "": {200, 404}}, {429, 500, 502, 503, 504}
#: Values of one filter that a listing takes at most.
VALUES = 50

Send = Callable[[str, dict, dict], tuple[int, dict, bytes]]


class FetchFailed(RuntimeError):
    """A source did not answer; the message never holds credentials."""


class CapReached(FetchFailed):
    """A call would take today's spend past the source's cap."""


class NotArchived(FetchFailed):
    """An offline run needs an answer that the archive lacks."""


@dataclass(frozen=True)
class Policy:
    """How a source is asked: calls a second (0: any), price by kind of request, money a day, and what is added when sending."""

    rate: float = 0.0
    prices: dict[str, float] = field(default_factory=dict)
    cap: float | None = None
    secret_params: dict[str, str] = field(default_factory=dict)
    secret_headers: dict[str, str] = field(default_factory=dict)
    terms: str | None = None
    attempts: int = ATTEMPTS


def web(url: str, params: dict, headers: dict) -> tuple[int, dict, bytes]:
    """(status, headers, body) of one GET; OSError where there is no answer."""
    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers=headers), timeout=60) as got:
            return got.status, {k.lower(): v for k, v in got.headers.items()}, got.read()
    except urllib.error.HTTPError as refused:
        return refused.code, {k.lower(): v for k, v in refused.headers.items()}, b""


class Line:
    """The calls of one source in one task, one after another."""

    def __init__(self, send: Send, policy: Policy, spent: float, sleep=time.sleep, clock=time.monotonic):
        self.send, self.policy, self.spent, self.sleep, self.clock = send, policy, spent, sleep, clock
        self.free_at = None

    def ask(self, kind: str, url: str, params: dict) -> dict:
        """The outcome of a request: settled with a status, or a problem. Every attempt is paid for."""
        out = {"status": None, "content_type": None, "content": None, "attempts": 0, "usd": 0.0, "problem": None}
        price, settled = self.policy.prices.get(kind, 0.0), SETTLED.get(kind, SETTLED[""])
        while out["attempts"] < self.policy.attempts:
            if price > 0 and self.policy.cap is not None and self.spent + price > self.policy.cap + 1e-9:
                return out | {"problem": "cap"}
            self._take_turn()
            self.spent += price
            out |= {"attempts": out["attempts"] + 1, "usd": out["usd"] + price}
            try:
                status, headers, body = self.send(url, params | self.policy.secret_params, dict(self.policy.secret_headers))
            except OSError as error:
                # The error's text may hold the whole address, credentials included.
                status, headers, body, out["problem"] = None, {}, b"", type(error).__name__
            if status in settled:
                return self._settled(out, kind, status, headers, body)
            if status is not None:
                out["problem"] = f"HTTP {status}"
                if status not in PASSING:
                    break
            if out["attempts"] == self.policy.attempts:
                break
            asked = headers.get("retry-after", "")
            self.sleep(min(float(asked) if asked.isdigit() else 2.0 ** (out["attempts"] - 1), LONGEST))
        return out

    def _take_turn(self) -> None:
        if self.policy.rate:
            now = self.clock()
            if self.free_at is not None and self.free_at > now:
                self.sleep(self.free_at - now)
            self.free_at = max(now, self.free_at or now) + 1.0 / self.policy.rate

    @staticmethod
    def _settled(out: dict, kind: str, status: int, headers: dict, body: bytes) -> dict:
        if kind not in SETTLED and status == 200:
            try:
                json.loads(body)
            except ValueError:
                return out | {"problem": "not JSON"}
        kind_of = headers.get("content-type", "").split(";")[0].strip() or None
        return out | {"status": status, "content_type": kind_of, "content": body if status == 200 else None, "problem": None}


def keyed(requests: DataFrame, *more: str) -> DataFrame:
    """Requests with their key, and ``more`` columns: a digest that the order of parameters does not change; null parameters are left out."""
    given = F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    rows = requests.select(*more, "source", "kind", "url", given.alias("params"))
    same = F.struct("source", "url", F.array_sort(F.map_entries("params")).alias("params"))
    return rows.select(F.sha2(F.to_json(same), 256).alias("key"), "*")


def calls(spark: SparkSession, archive: str) -> DataFrame:
    spark.createDataFrame([], CALLS).write.mode("ignore").parquet(archive)
    return spark.read.schema(CALLS).parquet(archive)


def answers(spark: SparkSession, archive: str) -> DataFrame:
    """One settled call per key: the first stands."""
    rest = ["status", "content_type", "content", "retrieved_at"]
    held = calls(spark, archive).where("status is not null")
    return held.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("retrieved_at", F.sha2("content", 256))).alias("a")).select("key", "a.*")


def usage(spark: SparkSession, archive: str) -> DataFrame:
    """(source, kind, day, attempts, usd) of the calls made."""
    return calls(spark, archive).groupBy("source", "kind", "day").agg(F.sum("attempts").alias("attempts"), F.round(F.sum("usd"), 6).alias("usd"))


def fetched(requests: DataFrame, archive: str, policies: dict[str, Policy], send: Send = web, offline: bool = False, strict: bool | str = True, today: dt.date | None = None, sleep=time.sleep) -> DataFrame:
    """(key, source, kind, url, params, status, content_type, content, retrieved_at) of each request.

    Equal requests are sent once. ``strict`` raises after the round in which a source did not answer or its cap was
    met ("cap": for the cap alone), so what did come is kept; else such requests have a null status. ``offline`` sends nothing.
    """
    spark = requests.sparkSession
    rows = keyed(requests)
    pending = rows.dropDuplicates(["key"]).join(answers(spark, archive).select("key"), "key", "left_anti")
    if offline:
        lacking = pending.select("source", "url").head(1)
        if lacking and strict:
            raise NotArchived(f"{lacking[0].source}: {lacking[0].url} is not in the archive")
    else:
        most = pending.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        rounds = -(-most // ROUND)
        for k in range(rounds):
            _round(pending.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k), archive, policies, send, strict, today, sleep)
    return rows.join(answers(spark, archive), "key", "left")


def _round(pending: DataFrame, archive: str, policies: dict[str, Policy], send: Send, strict: bool | str, today: dt.date | None, sleep) -> None:
    spark = pending.sparkSession
    began, day = dt.datetime.now(dt.UTC), today or dt.datetime.now(dt.UTC).date()
    spent = {r.source: r.usd for r in calls(spark, archive).where(F.col("day") == F.lit(day)).groupBy("source").agg(F.sum("usd").alias("usd")).where(F.col("source").isin(*policies)).collect()}

    def of_source(group: pd.DataFrame) -> pd.DataFrame:
        source = group["source"].iloc[0]
        policy = policies.get(source, Policy())
        line = Line(send, policy, spent.get(source, 0.0), sleep)
        done = []
        for r in group.sort_values("key").to_dict("records"):
            outcome = line.ask(r["kind"], r["url"], dict(r["params"]))
            done.append({**r, "params": dict(r["params"]), **outcome, "day": day, "retrieved_at": pd.Timestamp.now(tz="UTC"), "terms": policy.terms})
        out = pd.DataFrame(done)
        return out.assign(status=out["status"].astype("Int32"))

    pending.groupBy("source").applyInPandas(of_source, CALLS).write.mode("append").parquet(archive)
    if strict:
        bad = calls(spark, archive).where("problem is not null").where(F.col("retrieved_at") >= F.lit(began)).join(pending.select("key"), "key", "left_semi")
        bad = bad.where("problem = 'cap'") if strict == "cap" else bad
        first = bad.orderBy(F.col("problem") == "cap", "source", "url").select("source", "url", "problem").head(1)
        if first:
            raise (CapReached if first[0].problem == "cap" else FetchFailed)(f"{first[0].source} {first[0].url}: {first[0].problem}")


# ---- listings


def listed(requests: DataFrame, follow: Callable[[DataFrame], DataFrame], archive: str, policies: dict[str, Policy], **how) -> DataFrame:
    """The answers of all pages: ``follow`` makes the requests of the next pages of answers, until it makes none."""
    spark = requests.sparkSession
    front, seen = _cut(requests), None
    while not front.isEmpty():
        seen = front if seen is None else _cut(seen.unionByName(front))
        front = _cut(follow(fetched(front, archive, policies, **how)))
    return fetched(seen if seen is not None else front, archive, policies, offline=True, strict=how.get("strict", True))


def _cut(requests: DataFrame) -> DataFrame:
    """The requests without their lineage."""
    requests = requests.select("source", "kind", "url", "params")
    few = requests.limit(FRONT + 1).toArrow()
    return requests.sparkSession.createDataFrame(few).to(requests.schema) if few.num_rows <= FRONT else requests.checkpoint()


def bodies(got: DataFrame, body: str) -> DataFrame:
    """Answers as ``tables.read_json_archive`` gives them: (key, status, body), the body parsed by its DDL."""
    return got.select("key", "status", F.from_json(F.decode("content", "utf-8"), body).alias("body"))


def _with_params(got: DataFrame, new: dict[str, Column]) -> DataFrame:
    changed = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v.cast("string"))])
    return got.select("source", "kind", "url", F.map_concat(F.map_filter("params", lambda k, _: ~k.isin(*new)), changed).alias("params"))


def next_cursor(got: DataFrame) -> DataFrame:
    """Pages by cursor (SRC11): the next one, where this one has results and names it."""
    page = F.from_json(F.decode("content", "utf-8"), "struct<meta:struct<next_cursor:string>,results:array<string>>")
    more = got.withColumn("page", page).where("status = 200 and size(page.results) > 0 and page.meta.next_cursor is not null")
    return _with_params(more, {"cursor": F.col("page.meta.next_cursor")})


def next_offset(size: int, most: int) -> Callable[[DataFrame], DataFrame]:
    """Pages of ``size`` by offset (SRC15): the next one after a full page, up to the last offset that the source serves."""

    def follow(got: DataFrame) -> DataFrame:
        n = F.size(F.from_json(F.decode("content", "utf-8"), "struct<data:array<string>>")["data"])
        asked = [F.coalesce(F.col("params")[p].cast("int"), F.lit(d)).alias(p) for p, d in (("offset", 0), ("limit", size))]
        then = got.select("*", n.alias("n"), *asked).withColumn("then", F.col("offset") + F.col("n"))
        more = then.where(F.col("status") == 200).where("n = `limit`").where(F.col("then") < most - 1)
        return _with_params(more, {"offset": F.col("then"), "limit": F.least(F.lit(size), most - 1 - F.col("then"))})

    return follow


def listing_requests(spark: SparkSession, source: str, url: str, values: list[str], start: int, end: int, on: str = "cites", fields: list[str] | None = None, per_page: int = 200) -> DataFrame:
    """The first pages of a frame's works (SRC11): filters reach the source, in lists of ``VALUES`` at most, and only ``fields`` come back."""
    values = sorted(set(values))
    given = {"per-page": str(per_page), "cursor": "*"} | ({"select": ",".join(fields)} if fields else {})
    lists = ["|".join(values[k : k + VALUES]) for k in range(0, len(values), VALUES)]
    rows = [(source, "list", url, given | {"filter": f"{on}:{some},publication_year:{start}-{end}"}) for some in lists]
    return spark.createDataFrame(rows, REQUEST)
