"""Views that bind the bibliographic shapes to the driver's star-schema tables.

Each view has a Spark form here and a DuckDB form in ``PRELUDE``; queries are plain
functions over the shapes, so real tables can take the views' place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR, WINDOW = 1995, 1999, 3
PAPER_TYPES = ["F", "O"]

PRELUDE = """
works AS (SELECT o_orderkey AS work_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS type, o_orderpriority AS venue, o_custkey AS cust, o_totalprice AS price FROM orders),
authorships AS (SELECT DISTINCT l_orderkey AS work_id, l_suppkey AS author_id FROM lineitem),
authors AS (SELECT s_suppkey AS author_id, s_name AS display_name, s_nationkey AS nation FROM supplier),
citations AS (SELECT citing, cited FROM (SELECT o_orderkey AS citing, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cited FROM orders) WHERE cited IS NOT NULL),
frames AS (SELECT c_mktsegment AS frame_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'bearing' WHEN 'FURNITURE' THEN 'mainstream' ELSE 'community' END AS kind, work_id, year FROM works JOIN customer ON cust = c_custkey),
windows AS (SELECT CAST(s AS INTEGER) AS window_start, CAST(s + 2 AS INTEGER) AS window_end FROM generate_series(1995, 1997) t(s)),
anchors AS (SELECT work_id FROM works WHERE work_id % 97 = 0),
bearing AS (SELECT work_id FROM anchors UNION SELECT citing FROM citations JOIN anchors ON cited = work_id),
members AS (SELECT window_start, window_end, nation AS cluster, author_id FROM windows, authors WHERE (author_id + window_start) % 5 <> 0),
ledger AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'B' WHEN 'error' THEN 'C' WHEN 'view' THEN 'D' END AS code, event_type = 'click' AS at_risk, value FROM events)
"""


def counted(body: str) -> str:
    """``count_if`` written as a plain count, whose type is that of Spark's."""
    while (at := body.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            end += 1
        body = f"{body[:at]}count(CASE WHEN {body[at + len('count_if('):end - 1]} THEN 1 END){body[end:]}"
    return body


def sql(body: str) -> str:
    """A DuckDB query over the views."""
    return f"WITH {PRELUDE.strip()}{',' if body.lstrip().startswith('--also') else ''} {body.replace('--also', '', 1)}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """The bound views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def works(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("venue"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price")
        )

    @property
    def authorships(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).distinct()

    @property
    def authors(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("display_name"), F.col("s_nationkey").alias("nation"))

    @property
    def citations(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.t("orders").select(F.col("o_orderkey").alias("citing"), F.lag("o_orderkey").over(w).alias("cited")).where("cited is not null")

    @property
    def frames(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        kind = F.when(segment == "BUILDING", "bearing").when(segment == "FURNITURE", "mainstream").otherwise("community")
        return self.works.join(self.t("customer"), F.col("cust") == F.col("c_custkey")).select(segment.alias("frame_id"), kind.alias("kind"), "work_id", "year")

    @property
    def windows(self) -> DataFrame:
        from corvane.operators.core import sub_windows

        return sub_windows(self.spark, FIRST_YEAR, LAST_YEAR, WINDOW, True)

    @property
    def anchors(self) -> DataFrame:
        return self.works.where("work_id % 97 = 0").select("work_id")

    @property
    def members(self) -> DataFrame:
        rows = F.broadcast(self.windows).crossJoin(self.authors).where("(author_id + window_start) % 5 != 0")
        return rows.select("window_start", "window_end", F.col("nation").alias("cluster"), "author_id")

    @property
    def ledger(self) -> DataFrame:
        kind = F.col("event_type")
        code = F.when(kind == "purchase", "A").when(kind == "signup", "B").when(kind == "error", "C").when(kind == "view", "D")
        return self.t("events").select("user_id", "ts", "event_id", code.alias("code"), (kind == "click").alias("at_risk"), "value")
