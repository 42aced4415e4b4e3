"""Event-log analytics over ``events``: a user is a session, an event type a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluate, journal
from graphloom.plans.tables import read

STAGES = ("click", "error", "purchase", "signup", "view", "refund", "branch")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps: the status follows from the value, the reason from the properties."""
    status = F.when(F.col("event_id") % 7 == 0, "skipped").when(F.col("event_id") % 11 == 0, "error").otherwise("ok")
    return read(spark, d, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("step"), status.alias("status"), F.get_json_object("props", "$.k").alias("reason")
    )


def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    return journal.stage_coverage(_log(spark, d), catalog)


def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return journal.coverage_totals(stage_coverage(spark, d))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    e = e.select(
        "session", "seq", "status",
        F.when(F.col("step") == "signup", "branch").when(F.col("step") == "purchase", "end").otherwise(F.col("step")).alias("step"),
        F.when(F.col("step") == "view", F.concat(F.lit("q"), "seq")).alias("query"),
        F.when(F.col("step") == "signup", F.concat(F.lit("b"), "seq")).alias("branch"),
        F.when(F.col("step") == "click", F.concat(F.lit("u"), "seq")).alias("mr_url"),
        F.when(F.col("step") == "error", F.col("reason")).alias("env"),
    )
    return journal.session_summary(e)


def test_runs(spark: SparkSession, d: str) -> DataFrame:
    names = {"signup": "checks", "view": "verify", "error": "judge", "click": "implement"}
    step = F.col("step")
    for k, v in names.items():
        step = F.when(F.col("step") == k, v).otherwise(step)
    return journal.test_runs(_log(spark, d).withColumn("step", step))


def branches(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).filter("step = 'signup'").withColumns({"step": F.lit("branch"), "branch": F.concat(F.lit("b"), F.col("session") % 10), "repo": F.concat(F.lit("r"), F.col("session") % 3)})
    return journal.branches(e)


def regression_verdict(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("step") == "error", "failed").when(F.col("step") == "click", "unverified").when(F.col("step") == "view", "skipped").otherwise("passed")
    e = _log(spark, d).select("session", status.alias("status"))
    return evaluate.regression_verdict(e, "session")


def narrate(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy(journal.narrate(F.col("step"), F.col("status")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stage_coverage, stage_totals, session_summary, test_runs, branches, regression_verdict, narrate)}

_LOG = """log AS (SELECT user_id AS session, event_id AS seq, event_type AS step,
    CASE WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, props->>'$.k' AS reason FROM events)"""
_COVER = f"""{_LOG}, cat AS (SELECT unnest({list(STAGES)}) AS stage),
    c AS (SELECT step AS stage, count(*) FILTER (status <> 'skipped') AS ran, count(*) FILTER (status = 'skipped') AS skipped, arg_min(reason, seq) FILTER (status = 'skipped') AS reason FROM log GROUP BY 1),
    cover AS (SELECT stage, coalesce(ran, 0) AS ran, coalesce(skipped, 0) AS skipped, reason, coalesce(ran, 0) = 0 AND coalesce(skipped, 0) = 0 AS silent FROM cat LEFT JOIN c USING (stage))"""

ORACLE_SQL = {
    "stage_coverage": f"WITH {_COVER} SELECT * FROM cover",
    "stage_totals": f"WITH {_COVER} SELECT count(*) FILTER (ran > 0) AS covered, count(*) FILTER (ran = 0 AND skipped > 0) AS explained, count(*) FILTER (silent) AS silent FROM cover",
    "session_summary": f"""WITH {_LOG} SELECT session, 'q' || min(seq) FILTER (step = 'view') AS query, arg_max(status, seq) FILTER (step = 'purchase') AS ended,
        'b' || min(seq) FILTER (step = 'signup' AND status = 'ok') AS branch, 'u' || min(seq) FILTER (step = 'click') AS mr_url,
        arg_min(reason, seq) FILTER (step = 'error' AND reason IS NOT NULL) AS env, count(*) AS steps FROM log GROUP BY session""",
    "test_runs": f"""WITH {_LOG}, r AS (SELECT session, arg_max(status, seq) FILTER (step = 'signup') AS checks, arg_min(status, seq) FILTER (step = 'view') AS verify,
        arg_min(status, seq) FILTER (step = 'error') AS judge, count(*) FILTER (step = 'click') AS iterations FROM log GROUP BY session)
        SELECT * FROM r WHERE checks IS NOT NULL OR verify IS NOT NULL OR judge IS NOT NULL""",
    "branches": f"WITH {_LOG} SELECT DISTINCT 'r' || session % 3 AS repo, 'b' || session % 10 AS branch FROM log WHERE step = 'signup' AND status = 'ok'",
    "regression_verdict": f"""WITH {_LOG}, e AS (SELECT session, bool_or(step = 'error') AS f, bool_or(step = 'click') AS u, bool_or(step = 'view') AS s, bool_or(step NOT IN ('error', 'click', 'view')) AS p FROM log GROUP BY 1)
        SELECT session, CASE WHEN f THEN 'failed' WHEN u THEN 'unverified' WHEN p AND s THEN 'partial' WHEN p THEN 'verified' ELSE 'none' END AS verdict FROM e""",
    "narrate": f"""WITH {_LOG} SELECT upper(step[1]) || step[2:] || ' ' || CASE status WHEN 'ok' THEN 'done' WHEN 'skipped' THEN 'skipped' ELSE 'failed' END AS line, count(*) AS n FROM log GROUP BY 1""",
}
