"""Repositories, jobs and tile sets: upserts, latest states, stage times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: How events stand for jobs.
STATUS = {"signup": "QUEUED", "view": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED", "click": "QUEUED"}
ACTIVE = ["QUEUED", "RUNNING"]
TIMED_OUT = "the job ran longer than the time limit"


def jobs(events: DataFrame) -> DataFrame:
    """events as jobs: job_id, repo_id, created_at, status, duration_ms."""
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("repo_id"), F.col("ts").alias("created_at"), F.try_element_at(status, F.col("event_type")).alias("status"), F.col("value").alias("duration_ms"))


JOBS_SQL = """WITH jobs AS (SELECT event_id AS job_id, user_id AS repo_id, ts AS created_at, value AS duration_ms,
  CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'QUEUED' END AS status
  FROM events)"""


def latest(rows: DataFrame, key: str, order: str = "created_at", tie: str = "job_id") -> DataFrame:
    """The newest row of each key; partial aggregation keeps one row a task and key."""
    best = F.max_by(F.struct(*rows.columns), F.struct(order, tie)).alias("r")
    return rows.groupBy(key).agg(best).select("r.*")


def newest(rows: DataFrame, n: int = 20, order: str = "created_at", tie: str = "job_id") -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def oldest_queued(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'QUEUED'").orderBy("created_at", "job_id").limit(1)


def newest_repos(repos: DataFrame) -> DataFrame:
    """Repositories, newest first."""
    return repos.orderBy(F.desc("created_at"), "repo_id")


def with_latest(repos: DataFrame, rows: DataFrame) -> DataFrame:
    """repos with their newest job, null if none."""
    return repos.join(latest(rows, "repo_id"), "repo_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key isn't there yet, of each key the least row; old rows stay as they are."""
    added = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r"))
    return old.unionByName(added.select(key, "r.*"))


def enqueue(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per requested repository: its active job (the oldest) if there is one, else the new job's id."""
    active = rows.where(F.col("status").isin(ACTIVE)).groupBy("repo_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("active_id"))
    once = requests.groupBy("repo_id").agg(F.min("new_id").alias("new_id"))
    out = once.join(active, "repo_id", "left")
    return out.select("repo_id", F.coalesce("active_id", "new_id").alias("job_id"), F.col("active_id").isNull().alias("created"))


def fail_stale(rows: DataFrame, now, seconds: int) -> DataFrame:
    """rows with running jobs that began too long ago failed, with the fixed message."""
    stale = (F.col("status") == "RUNNING") & (F.col("created_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.withColumn("error", F.when(stale, F.lit(TIMED_OUT))).withColumn("status", F.when(stale, F.lit("FAILED")).otherwise(F.col("status")))


def stage_durations(marks: DataFrame, key: str = "repo_id", stage: str = "status", at: str = "created_at", tie: str = "job_id") -> DataFrame:
    """marks with ms: the time until the key's next mark, null for the last."""
    following = F.lead(at).over(W.partitionBy(key).orderBy(at, tie))
    ms = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return marks.withColumn("ms", F.floor(ms / 1000))


def timings(marks: DataFrame, key: str = "repo_id", stage: str = "status") -> DataFrame:
    """Per key a map from stage to its total time."""
    sums = stage_durations(marks, key, stage).where("ms is not null").groupBy(key, stage).agg(F.sum("ms").alias("ms"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stage, "ms")))).alias("timings_ms"))


def iso(column: Column) -> Column:
    """A timestamp as ISO 8601 text with milliseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duplicates(claims: DataFrame, key: str) -> DataFrame:
    """Keys that were claimed more than once."""
    return claims.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unclaimed(expected: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().exceptAll(claims.select(key).distinct().intersect(expected.select(key).distinct()))
