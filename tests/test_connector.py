"""The connector with senders that answer from rules, without a network."""

from __future__ import annotations

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.sources import bibliographic as bib
from corvane.sources import connector as con
from corvane.sources import labeller

DAY = dt.date(2026, 3, 1)
# Workers cannot import this module: its senders travel as code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Script:
    """A sender that plays answers in order and a clock that only sleeping moves."""

    def __init__(self, *plays):
        self.plays, self.sent, self.slept, self.now = list(plays), [], [], 0.0

    def __call__(self, url, params, headers):
        self.sent.append((url, params, headers))
        play = self.plays.pop(0)
        if isinstance(play, Exception):
            raise play
        return play

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds

    def line(self, policy=con.Policy(), spent=0.0):
        return con.Line(self, policy, spent, self.sleep, lambda: self.now)


OK = (200, {"content-type": "application/json; charset=utf-8"}, b"{}")


def test_passing_errors_are_tried_again_with_pauses():
    s = Script((429, {"retry-after": "7"}, b""), ConnectionError("https://x?key=hidden"), (503, {"retry-after": "900"}, b""), OK)
    got = s.line(con.Policy(prices={"list": 0.5})).ask("list", "u", {})
    assert (got["status"], got["attempts"], got["usd"], got["content_type"], got["problem"]) == (200, 4, 2.0, "application/json", None)
    assert s.slept == [7.0, 2.0, 60.0]
    s = Script(*[(504, {}, b"")] * con.ATTEMPTS)
    got = s.line().ask("list", "u", {})
    assert (got["status"], got["attempts"], got["problem"]) == (None, 8, "HTTP 504") and max(s.slept) == 60 and sum(s.slept) >= 120
    assert Script(*[ConnectionError("key=hidden")] * 8).line().ask("list", "u", {})["problem"] == "ConnectionError"


def test_what_settles_a_request_depends_on_its_kind():
    for status in (401, 403, 410):
        assert Script((status, {}, b"no")).line().ask("document", "u", {})["status"] == status
        assert Script((status, {}, b"no")).line().ask("list", "u", {})["problem"] == f"HTTP {status}"
    assert Script((404, {}, b"no")).line().ask("list", "u", {}) == {"status": 404, "content_type": None, "content": None, "attempts": 1, "usd": 0.0, "problem": None}
    assert Script((400, {}, b"")).line().ask("document", "u", {})["problem"] == "HTTP 400"
    assert Script((200, {}, b"<html>")).line().ask("list", "u", {})["problem"] == "not JSON"
    assert Script((200, {}, b"\xff<html>")).line().ask("document", "u", {})["content"] == b"\xff<html>"


def test_rates_and_caps():
    s = Script(OK, OK, OK)
    line = s.line(con.Policy(rate=4))
    for _ in range(3):
        line.ask("list", "u", {})
    assert s.slept == [0.25, 0.25]
    s = Script(OK, OK, OK)
    line = s.line(con.Policy(prices={"list": 0.1}, cap=0.3), spent=0.1)
    got = [line.ask(kind, "u", {})["problem"] for kind in ("list", "list", "list", "single")]
    assert got == [None, None, "cap", None] and len(s.sent) == 3


def by_rule(url, params, headers):
    """Answers from the address alone."""
    if url.startswith("https://down"):
        return 500, {}, b""
    if url.endswith("/gone"):
        return 404, {}, b""
    assert ("key" in params) == (url.startswith("https://a")), "credentials belong to their own source"
    if "cursor" in params:
        at = 0 if params["cursor"] == "*" else int(params["cursor"])
        found = [{"id": f"https://openalex.org/W{i}", "publication_year": 1990} for i in range(at, min(at + 2, 5))]
        return 200, {}, json.dumps({"meta": {"count": 5, "next_cursor": str(at + 2)}, "results": found}).encode()
    if "offset" in params or "limit" in params:
        at, n = int(params.get("offset", 0)), int(params["limit"])
        return 200, {}, json.dumps({"offset": at, "data": [{"i": i} for i in range(at, min(at + n, 9))]}).encode()
    return OK


def never(url, params, headers):
    raise AssertionError("sent")


def rows(spark, *requests):
    return spark.createDataFrame(list(requests), con.REQUEST)


POLICIES = {"a": con.Policy(prices={"list": 0.25}, cap=1.0, secret_params={"key": "HIDDEN"}, terms="terms-a"), "b": con.Policy()}


def no_sleep(seconds):
    pass


def test_archive_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(con, "ROUND", 2)
    archive = str(tmp_path / "calls")
    wanted = rows(spark, ("a", "list", "https://a/1", {"y": "2", "x": "1", "z": None}), ("a", "list", "https://a/1", {"x": "1", "y": "2"}), ("a", "list", "https://a/gone", None), ("a", "list", "https://a/3", {}), ("b", "document", "https://b/1", {}))
    got = con.fetched(wanted, archive, POLICIES, by_rule, today=DAY, sleep=no_sleep).collect()
    assert sorted((r.url, r.status) for r in got) == [("https://a/1", 200), ("https://a/1", 200), ("https://a/3", 200), ("https://a/gone", 404), ("https://b/1", 200)]
    assert len({r.key for r in got}) == 4
    spent = {(r.source, r.kind): (r.attempts, r.usd) for r in con.usage(spark, archive).collect()}
    assert spent == {("a", "list"): (3, 0.75), ("b", "document"): (1, 0.0)}
    kept = con.calls(spark, archive)
    assert not any("HIDDEN" in str(r) for r in kept.collect()) and kept.where("source = 'a' and terms = 'terms-a'").count() == 3
    # All of it is replayed, offline too; what is new is refused.
    again = con.fetched(wanted, archive, POLICIES, never, offline=True)
    assert sorted((r.url, r.status) for r in again.collect()) == sorted((r.url, r.status) for r in got)
    new = rows(spark, ("a", "list", "https://a/9", {}))
    with pytest.raises(con.NotArchived, match="https://a/9"):
        con.fetched(new, archive, POLICIES, never, offline=True)
    assert con.fetched(new, archive, POLICIES, never, offline=True, strict=False).first().status is None


def test_the_cap_holds_across_runs_and_ends_with_the_day(spark, tmp_path):
    archive = str(tmp_path / "calls")
    page = lambda *names: rows(spark, *[("a", "list", f"https://a/{n}", {}) for n in names])
    con.fetched(page(1, 2, 3), archive, POLICIES, by_rule, today=DAY, sleep=no_sleep)
    with pytest.raises(con.CapReached, match="cap"):
        con.fetched(page(1, 4, 5), archive, POLICIES, by_rule, today=DAY, sleep=no_sleep)
    assert con.usage(spark, archive).agg(F.sum("usd")).first()[0] == 1.0
    tomorrow = con.fetched(page(4, 5), archive, POLICIES, by_rule, today=DAY + dt.timedelta(days=1), sleep=no_sleep)
    assert [r.status for r in tomorrow.collect()] == [200, 200]


def test_failures_keep_what_came_and_are_tried_again(spark, tmp_path):
    archive = str(tmp_path / "calls")
    both = rows(spark, ("b", "list", "https://down/1", {}), ("b", "list", "https://b/2", {}))
    with pytest.raises(con.FetchFailed, match="https://down/1: HTTP 500"):
        con.fetched(both, archive, POLICIES, by_rule, today=DAY, sleep=no_sleep)
    assert [r.n for r in con.answers(spark, archive).agg(F.count("*").alias("n")).collect()] == [1]
    lenient = con.fetched(both, archive, POLICIES, by_rule, strict=False, today=DAY, sleep=no_sleep)
    assert {r.url: r.status for r in lenient.collect()} == {"https://down/1": None, "https://b/2": 200}
    assert con.usage(spark, archive).first().attempts == 17
    assert con.fetched(rows(spark), archive, POLICIES, never).count() == 0


def test_listings(spark, tmp_path, monkeypatch):
    archive = str(tmp_path / "calls")
    first = con.listing_requests(spark, "b", "https://b/works", [f"W{i}" for i in range(60)], 1990, 1995, fields=["id", "publication_year"])
    assert sorted(r.params["filter"].count("|") for r in first.collect()) == [9, 49] and all(r.params["filter"].endswith(",publication_year:1990-1995") for r in first.collect())
    got = con.listed(first, con.next_cursor, archive, POLICIES, send=by_rule, today=DAY, sleep=no_sleep)
    works = bib.works(bib.pages_to_works(con.bodies(got, bib.PAGE)), "openalex")
    # Pages of 2, 2, 1 and an empty one, for both lists of filters.
    assert got.count() == 8 and sorted(r.work_id for r in works.collect()) == sorted([f"W{i}" for i in range(5)] * 2)
    pages = rows(spark, ("b", "list", "https://b/cites", {"limit": "4"}))
    sizes = lambda d: sorted((int(r.params.get("offset") or 0), int(r.params["limit"])) for r in d.collect())
    assert sizes(con.listed(pages, con.next_offset(4, 100), archive, POLICIES, send=by_rule, today=DAY, sleep=no_sleep)) == [(0, 4), (4, 4), (8, 4)]
    assert sizes(con.listed(pages, con.next_offset(4, 8), archive, POLICIES, send=by_rule, today=DAY, sleep=no_sleep)) == [(0, 4), (4, 3)]


def coder(mode):
    def send(url, params, headers):
        if mode == "down":
            raise TimeoutError
        if mode == "text":
            return 200, {}, b"not json at all"
        asked = [str(i["key"]) for i in json.loads(params["items"])]
        given = [{"key": k, "label": "+", "span": f"s{k}"} for k in asked]
        if mode == "odd":
            given = [{"key": "1", "label": "+"}, {"key": "2", "label": "maybe"}, {"key": "3", "label": "x"}, {"key": "3", "label": "+"}]
        return 200, {}, json.dumps({"model": "other-9" if mode == "other" else "coder-1-2026", "is_error": mode == "error", "labels": given}).encode()

    return send


def test_labels(spark, tmp_path):
    items = spark.createDataFrame([(f"i{k}", f"text {k}" if k else None) for k in range(7)], "item_id string, text string")
    batches = spark.createDataFrame([(0, ["i4", "i0", "i2"]), (1, ["i1", "i3", "i5"]), (2, ["i6"])], "batch int, ids array<string>")
    asked = labeller.requests(batches, items, "A", "T1", "v1", 0)
    assert "i4" not in asked.where("batch = 0").first().params["items"]
    run = lambda mode, to, **how: labeller.labelled(asked, str(tmp_path / to), never if mode is None else coder(mode), "coder-1", ["+", "x"], today=DAY, **how)
    reasons = lambda d: {r.item_id: r.missing for r in d.collect()}
    first = run("fine", "one")
    assert {r.item_id: r.value for r in first.collect()} == {i: {"label": "+", "span": f"s{k}"} for i, k in (("i4", 1), ("i0", 2), ("i2", 3), ("i1", 1), ("i3", 2), ("i5", 3), ("i6", 1))}
    assert run(None, "one", most_calls=0).where("missing is null").count() == 7 and run(None, "one", offline=True).count() == 7
    with pytest.raises(con.CapReached):
        run("fine", "two", most_calls=2)
    assert set(reasons(run("fine", "two", most_calls=1)).values()) == {None}
    # A failure is kept as one, and the call is made again; an answer that cannot be read is kept as it came.
    assert set(reasons(run("down", "three")).values()) == {"call_failed"} and set(reasons(run("fine", "three")).values()) == {None}
    assert con.usage(spark, str(tmp_path / "three")).first().attempts == 6
    assert set(reasons(run("text", "four")).values()) == {"unparseable"} and con.calls(spark, str(tmp_path / "four")).where("content = cast('not json at all' as binary)").count() == 3
    assert set(reasons(run("other", "five")).values()) == {"wrong_model"} and set(reasons(run("error", "six")).values()) == {"call_failed"}
    assert set(reasons(run("fine", "six")).values()) == {None}
    assert reasons(run("odd", "seven")) == {"i4": None, "i0": "invalid", "i2": "absent", "i1": None, "i3": "invalid", "i5": "absent", "i6": None}
