"""Operator inputs made from the star-schema tables, each with the same table as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions of one record per user: available up to four hours after they happen."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), "event_type", F.col("ts").alias("event_time"),
        F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 5 as int))").alias("available_time"),
        (F.row_number().over(order) - 1).cast("long").alias("source_revision"),
        F.col("event_id").alias("ingest_sequence"), "value",
    )


BOOK = """book as (
  select user_id as record_id, event_type, ts as event_time, ts + to_hours((event_id % 5)::int) as available_time,
         (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as source_revision,
         event_id as ingest_sequence, value from events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per order priority and day: the day's total, exact in cents."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price")
    )
    return days.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("d")).cast("long"))


DAILY = """daily as (
  select *, row_number() over (partition by series order by d)::bigint as t from (
    select o_orderpriority as series, o_orderdate::date as d, sum(o_totalprice::decimal(18,2))::double as price from orders group by 1, 2))"""


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction path on the daily series: bounded returns, yesterday's return faded as the prediction."""
    order = Window.partitionBy("series").orderBy("t")
    before = F.lag("price").over(order)
    base = daily(spark, sf_dir).withColumn("ret", F.coalesce((F.col("price") - before) / (F.col("price") + before), F.lit(0.0)) / 8)
    base = base.withColumn("prediction", 0 - F.coalesce(F.lag("ret").over(order), F.lit(0.0)) / 2)
    return base.select(
        "series", "t", "d", "price", "ret", "prediction", F.col("ret").alias("label"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("prediction") * 20)).alias("position"),
        (F.col("t") > 20).alias("evaluated"), F.signum("ret").alias("optimal"), F.expr("t div 97").alias("regime"),
    )


PATH = f"""{DAILY},
rets as (select *, coalesce((price - lag(price) over o) / (price + lag(price) over o), 0) / 8 as ret from daily window o as (partition by series order by t)),
path as (
  select series, t, d, price, ret, prediction, ret as label, greatest(-1, least(1, prediction * 20))::double as position,
         t > 20 as evaluated, sign(ret)::double as optimal, t // 97 as regime
  from (select *, 0 - coalesce(lag(ret) over (partition by series order by t), 0) / 2 as prediction from rets))"""

#: The path with change, cost, gross, net and equity, at a cost rate of 0.001.
RATE = 0.001
MADE = f"""{PATH},
moved as (select *, case when evaluated then abs(position - coalesce(lag(position) over (partition by series, evaluated order by t), 0)) else 0 end as change from path),
paid as (select *, change * {RATE} as cost, case when evaluated then position * ret else 0 end as gross from moved),
netted as (select *, gross - cost as net from paid),
made as (select *, 1 + sum(net) over (partition by series order by t) as equity from netted)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in [-1, 1] per event type (gate) and user (challenger)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("gate"), F.col("user_id").alias("challenger"), F.col("event_id").alias("t"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 40) / 53.7)).alias("score"),
    )


BETS = "bets as (select event_type as gate, user_id as challenger, event_id as t, greatest(-1, least(1, (value - 40) / 53.7))::double as score from events)"


def lagged(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """Per event type the last ``n`` values as features and the next as the target."""
    order = Window.partitionBy("event_type").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumns({"t": F.row_number().over(order), "x": F.col("value") / 100})
    features = F.array(*[F.coalesce(F.lag("x", k).over(order), F.lit(0.0)) for k in range(n)])
    return e.select("event_type", "t", features.alias("features"), F.coalesce(F.lead("x").over(order), F.lit(0.0)).alias("target"))


def lagged_sql(n: int = 2) -> str:
    features = ", ".join(f"coalesce(lag(value / 100, {k}) over o, 0)::double as f{k}" for k in range(n))
    return f"""lagged as (select event_type, row_number() over o as t, {features}, coalesce(lead(value / 100) over o, 0)::double as y
 from events window o as (partition by event_type order by event_id))"""
