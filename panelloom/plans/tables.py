"""Panels derived from the driver tables, and the same panels as SQL text.

* ``panel_s``: supplier x week from lineitem, densified; weekly signals are missing where nothing shipped.
* ``panel_e``: event type x hour; calendar and hour-of-week logic.
* ``panel_u``: user x hour; mostly zero, the throughput panel.
* ``cube``: the three seasonal baselines over three gapped windows of ``panel_s``.

Money and rates are summed in whole cents, so the panels are the same numbers on any engine.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import baselines
from panelloom.session import checkpointed, shared_folder, spread, stored
from panelloom.spec import PanelSpec

SIGNALS = ("x1", "x2", "x3")

WEEKLY = PanelSpec(
    signals=SIGNALS, nullable=SIGNALS, statics=("capacity", "zone"), step_seconds=7 * 86_400, season=13, score_len=13,
    train_end=331, late_from=9, lags=(1, 2, 4, 13, 26), rolls=(4, 13),
)
HOURLY = PanelSpec(
    signals=SIGNALS, nullable=SIGNALS, statics=("capacity", "zone"), season=168, score_len=84, train_end=552, late_from=56,
    lags=(1, 24, 48, 168), rolls=(24, 168),
)
USERS = HOURLY.with_(signals=("x1",), nullable=("x1",), season=24)
CUTOFFS = (331, 318, 305)
MEMBERS = ("naive", "seasonal_naive", "seasonal_mean")


def cents(col: str):
    return F.sum(F.round(F.col(col) * 100).cast("long")).cast("double")


def unrolled(keys: DataFrame, key: str, n: int) -> DataFrame:
    """Every row of ``keys`` at each of the ``n`` positions of a calendar, ``hidx``.

    A product with the positions, not an array taken apart: Spark counts a product for the sizes of both sides, but an
    exploded table for as small as its keys, and would send all cells to the driver to broadcast them in a later join.
    """
    positions = keys.sparkSession.range(0, n, 1, 1).withColumnRenamed("id", "hidx")
    return spread(keys, key).crossJoin(F.broadcast(positions))  # a row a position


def unrolled_join(cells: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """``cells``, keys unrolled over a calendar, beside what was seen of them, merged whatever their sizes look like."""
    return cells.hint("merge").join(seen, keys, "left")


class Tables:
    """Lazy access to the driver tables and the panels over them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -------------------------------------------------------------- supplier x week

    @cached_property
    def weeks(self):
        """First and last week of the calendar: two dates read on the driver."""
        day = F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date")
        return self.read("lineitem").agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()

    @cached_property
    def weekly(self) -> PanelSpec:
        return WEEKLY.with_(series_len=(self.weeks["hi"] - self.weeks["lo"]).days // 7 + 1)

    @cached_property
    def chunked(self) -> PanelSpec:
        """The weekly panel treated as if its length were unknown, cut into short chunks."""
        return WEEKLY.with_(series_len=None, chunk_rows=64)

    @cached_property
    def panel_s(self) -> DataFrame:
        lo, n = self.weeks["lo"], self.weekly.series_len
        week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit(lo)) / 7)
        shipped = self.read("lineitem").groupBy("l_suppkey", week.alias("hidx")).agg(
            F.sum("l_quantity").alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("t"),
            cents("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n"),
        )
        zones = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("zone"))
        supplier = self.read("supplier").join(zones, "s_nationkey").select(
            "s_suppkey", F.greatest("s_acctbal", F.lit(1.0)).alias("capacity"), F.col("zone").cast("long").alias("zone")
        )
        cells = unrolled(supplier, "s_suppkey", n)
        rows = unrolled_join(cells, shipped.withColumnRenamed("l_suppkey", "s_suppkey"), ["s_suppkey", "hidx"])
        return rows.select(
            F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("unique_id"),
            F.date_add(F.lit(lo), (F.col("hidx") * 7).cast("int")).cast("timestamp").alias("ds"),
            "hidx",
            F.coalesce("q", F.lit(0.0)).alias("y"),
            (F.col("d") / (F.col("n") * 100.0)).alias("x1"),
            (F.col("t") / (F.col("n") * 100.0)).alias("x2"),
            (F.col("p") / (F.col("q") * 100.0)).alias("x3"),
            "capacity",
            "zone",
        )

    @cached_property
    def kept_s(self) -> DataFrame:
        """``panel_s`` written once to the shared folder, for work that reads it several times."""
        return stored(self.panel_s, "panel_s")

    # -------------------------------------------------------------- events x hour

    @cached_property
    def hours(self):
        at = F.date_trunc("hour", F.col("ts").cast("timestamp"))
        row = self.read("events").agg(F.unix_seconds(F.min(at)).alias("lo"), F.unix_seconds(F.max(at)).alias("hi")).first()
        return row["lo"], (row["hi"] - row["lo"]) // 3600 + 1

    @cached_property
    def hourly(self) -> PanelSpec:
        return HOURLY.with_(series_len=self.hours[1])

    @cached_property
    def users(self) -> PanelSpec:
        return USERS.with_(series_len=self.hours[1])

    def _hourly(self, key: str, aggs: dict, facts: DataFrame) -> DataFrame:
        lo, n = self.hours
        at = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(lo)) / 3600)
        events = self.read("events")
        seen = events.groupBy(key, at.alias("hidx")).agg(*(x.alias(c) for c, x in aggs.items()))
        cells = unrolled(facts, key, n)
        stamp = F.timestamp_seconds(F.lit(lo) + F.col("hidx") * 3600)
        return unrolled_join(cells, seen, [key, "hidx"]).withColumn("ds", stamp)

    @cached_property
    def panel_e(self) -> DataFrame:
        facts = self.read("events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("capacity"))
        facts = facts.withColumn("zone", F.pmod(F.length("event_type"), F.lit(2)).cast("long"))
        rows = self._hourly(
            "event_type",
            {"n": F.count(F.lit(1)), "v": cents("value"), "x2": F.max("value"), "x3": F.min("value")},
            facts,
        )
        return rows.select(
            F.col("event_type").alias("unique_id"), "ds", "hidx", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("y"),
            (F.col("v") / (F.col("n") * 100.0)).alias("x1"), "x2", "x3", "capacity", "zone",
        )

    @cached_property
    def panel_u(self) -> DataFrame:
        facts = self.read("events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("capacity"))
        facts = facts.withColumn("zone", F.pmod(F.col("user_id"), F.lit(4)).cast("long"))
        rows = self._hourly("user_id", {"n": F.count(F.lit(1)), "v": cents("value")}, facts)
        return rows.select(
            F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("unique_id"), "ds", "hidx",
            F.coalesce(F.col("v") / 100.0, F.lit(0.0)).alias("y"), (F.col("v") / (F.col("n") * 100.0)).alias("x1"),
            "capacity", "zone",
        )

    # -------------------------------------------------------------- prediction cube

    @cached_property
    def cube(self) -> DataFrame:
        return baselines.baseline_cube(self.kept_s, self.weekly, CUTOFFS)

    @cached_property
    def scored(self) -> DataFrame:
        return self.cube.filter(F.col("blk") >= 0)

    @cached_property
    def stored(self) -> DataFrame:
        """The cube written once to the shared folder, for work that reads it several times."""
        return checkpointed(self.cube)

    @cached_property
    def stored_scored(self) -> DataFrame:
        return self.stored.filter(F.col("blk") >= 0)

    def scratch(self, name: str) -> str:
        """A new place in the shared folder."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ the same panels in SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "panel_s": (
        (),
        """
ps_rng AS (SELECT CAST(min(date_trunc('week', l_shipdate)) AS DATE) AS lo,
                  CAST(max(date_trunc('week', l_shipdate)) AS DATE) AS hi FROM lineitem),
ps_axis AS (SELECT lo + 7 * CAST(i AS INTEGER) AS wk, CAST(i AS BIGINT) AS hidx
            FROM (SELECT lo, unnest(range(0, (hi - lo) // 7 + 1)) AS i FROM ps_rng)),
ps_obs AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk, sum(l_quantity) AS q,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
                  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS t,
                  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS p,
                  count(*) AS n
           FROM lineitem GROUP BY 1, 2),
panel_s AS MATERIALIZED (
  SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS unique_id, CAST(a.wk AS TIMESTAMP) AS ds, a.hidx,
         coalesce(o.q, 0) AS y, o.d / (o.n * 1e2) AS x1, o.t / (o.n * 1e2) AS x2, o.p / (o.q * 1e2) AS x3,
         greatest(s_acctbal, 1) AS capacity, CAST(n_regionkey AS BIGINT) AS zone
  FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN ps_axis a
  LEFT JOIN ps_obs o ON o.l_suppkey = s_suppkey AND o.wk = a.wk)""",
    ),
    "ev_axis": (
        (),
        """
ev_rng AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events),
ev_axis AS (SELECT lo + to_hours(CAST(i AS INTEGER)) AS ds, CAST(i AS BIGINT) AS hidx
            FROM (SELECT lo, unnest(range(0, date_diff('hour', lo, hi) + 1)) AS i FROM ev_rng))""",
    ),
    "panel_e": (
        ("ev_axis",),
        """
pe_obs AS (SELECT event_type, date_trunc('hour', ts) AS ds, count(*) AS n,
                  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v, max(value) AS x2, min(value) AS x3
           FROM events GROUP BY 1, 2),
pe_key AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS capacity, CAST(length(event_type) % 2 AS BIGINT) AS zone
           FROM events GROUP BY 1),
panel_e AS MATERIALIZED (
  SELECT k.event_type AS unique_id, a.ds, a.hidx, CAST(coalesce(o.n, 0) AS DOUBLE) AS y, o.v / (o.n * 1e2) AS x1,
         o.x2, o.x3, k.capacity, k.zone
  FROM pe_key k CROSS JOIN ev_axis a LEFT JOIN pe_obs o ON o.event_type = k.event_type AND o.ds = a.ds)""",
    ),
    "panel_u": (
        ("ev_axis",),
        """
pu_obs AS (SELECT user_id, date_trunc('hour', ts) AS ds, count(*) AS n,
                  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
pu_key AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS capacity, CAST(user_id % 4 AS BIGINT) AS zone FROM events GROUP BY 1),
panel_u AS MATERIALIZED (
  SELECT 'u' || lpad(CAST(k.user_id AS VARCHAR), 8, '0') AS unique_id, a.ds, a.hidx, coalesce(o.v / 1e2, 0) AS y,
         o.v / (o.n * 1e2) AS x1, k.capacity, k.zone
  FROM pu_key k CROSS JOIN ev_axis a LEFT JOIN pu_obs o ON o.user_id = k.user_id AND o.ds = a.ds)""",
    ),
    "cube": (
        ("panel_s",),
        """
cube_cut AS (SELECT unnest([331, 318, 305]) AS cutoff),
cube AS MATERIALIZED (
  SELECT p.unique_id, p.ds, p.hidx, p.y, CAST(c.cutoff AS BIGINT) AS cutoff, p.hidx - c.cutoff + 1 AS step,
         p.hidx - c.cutoff - 13 AS blk,
         (SELECT arg_max(h.y, h.hidx) FROM panel_s h WHERE h.unique_id = p.unique_id AND h.hidx < c.cutoff) AS naive,
         (SELECT h.y FROM panel_s h WHERE h.unique_id = p.unique_id
            AND h.hidx = p.hidx - 13 * ((p.hidx - c.cutoff) // 13 + 1)) AS seasonal_naive,
         (SELECT avg(h.y) FROM panel_s h WHERE h.unique_id = p.unique_id AND h.hidx < c.cutoff
            AND h.hidx % 13 = p.hidx % 13) AS seasonal_mean
  FROM panel_s p JOIN cube_cut c ON p.hidx >= c.cutoff AND p.hidx < c.cutoff + 26),
scored AS (SELECT * FROM cube WHERE blk >= 0)""",
    ),
}


def with_ctes(names: str, body: str) -> str:
    """``WITH`` the named panels (and what they need) in front of a query body."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for n in names.split():
        add(n)
    if not done:
        return body.strip()
    text = body.strip()
    recursive = text.upper().startswith("WITH RECURSIVE ")
    more = text[14 if recursive else 5 :].lstrip() if text.upper().startswith("WITH ") else None
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(CTES[n][1] for n in done).strip()
    return f"{head},\n{more}" if more else f"{head}\n{text}"
