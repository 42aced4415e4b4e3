"""Analytics over an event log: ``(session, seq, ts, step, status, ...)``, one row a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_where(value: str | Column, order: str, cond: Column) -> Column:
    """The value of the first row, in order, for which a condition holds."""
    return F.min_by(value, F.when(cond, F.col(order)))


def last_where(value: str | Column, order: str, cond: Column) -> Column:
    return F.max_by(value, F.when(cond, F.col(order)))


def session_summary(events: DataFrame) -> DataFrame:
    """``(session, query, ended, branch, mr_url, env, steps)``; expects columns query, branch, mr_url, env."""
    ok = F.col("status") == "ok"
    return events.groupBy("session").agg(
        first_where("query", "seq", F.col("query").isNotNull()).alias("query"),
        last_where("status", "seq", F.col("step") == "end").alias("ended"),
        first_where("branch", "seq", (F.col("step") == "branch") & ok).alias("branch"),
        first_where("mr_url", "seq", F.col("mr_url").isNotNull()).alias("mr_url"),
        first_where("env", "seq", F.col("env").isNotNull()).alias("env"),
        F.count(F.lit(1)).alias("steps"),
    )


def test_runs(events: DataFrame) -> DataFrame:
    """``(session, checks, verify, judge, iterations)`` of sessions that have any of them."""
    step = F.col("step")
    return events.groupBy("session").agg(
        last_where("status", "seq", step == "checks").alias("checks"),
        first_where("status", "seq", step == "verify").alias("verify"),
        first_where("status", "seq", step == "judge").alias("judge"),
        F.count_if(step == "implement").alias("iterations"),
    ).filter("checks is not null or verify is not null or judge is not null")


def stage_coverage(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(stage, ran, skipped, reason, silent)`` of every stage of ``catalog(stage)``; silent: neither ran nor was skipped."""
    skipped = F.col("status") == "skipped"
    c = events.groupBy(F.col("step").alias("stage")).agg(
        F.count_if(~skipped).alias("ran"), F.count_if(skipped).alias("skipped"), first_where("reason", "seq", skipped).alias("reason")
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    out = catalog.join(c, "stage", "left").select("stage", zero("ran"), zero("skipped"), "reason")
    return out.withColumn("silent", (F.col("ran") == 0) & (F.col("skipped") == 0))


def coverage_totals(stages: DataFrame) -> DataFrame:
    return stages.agg(
        F.count_if(F.col("ran") > 0).alias("covered"), F.count_if((F.col("ran") == 0) & (F.col("skipped") > 0)).alias("explained"), F.count_if("silent").alias("silent")
    )


def branches(events: DataFrame, ok_only: bool = True) -> DataFrame:
    """Distinct ``(repo, branch)`` that sessions created."""
    e = events.filter((F.col("step") == "branch") & F.col("branch").isNotNull())
    return (e.filter(F.col("status") == "ok") if ok_only else e).select("repo", "branch").distinct()


def narrate(step: Column, status: Column) -> Column:
    """A sentence for an event."""
    done = F.when(status == "ok", "done").when(status == "skipped", "skipped").when(status == "error", "failed").otherwise(status)
    return F.concat_ws(" ", F.initcap(F.replace(step, F.lit("_"), F.lit(" "))), done)
