"""Registered queries on ordered results: each row with its place in the order that the library gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.operators import catalog, classify, profile, pyramid
from cartolith.plans.places import SCATTERED, _tiles
from cartolith.plans.queries import CLASSIFIED, FILES, _classified, _files, _indexed, _jobs, query
from cartolith.sources.storage import staged


def in_place(ordered: DataFrame, *group: str) -> DataFrame:
    """The rows of a sorted frame with `place`, from 1, within each group, in the order in which they come."""
    seen = staged(ordered.withColumn("__at", F.monotonically_increasing_id()))
    within = W.partitionBy(*(group or [F.lit(0)])).orderBy("__at")
    return seen.withColumn("place", F.row_number().over(within)).drop("__at")


@query(CLASSIFIED + " SELECT language, lines, row_number() OVER (ORDER BY lines DESC, language)::int AS place FROM (SELECT language, sum(lines)::bigint AS lines FROM classified WHERE outcome = 'file' GROUP BY language)")
def language_order(spark, sf_dir):
    """Languages, most lines first."""
    return in_place(profile.language_profile(_files(spark, sf_dir))).select("language", "lines", "place")


@query(catalog.JOBS_SQL + " SELECT job_id, row_number() OVER (ORDER BY created_at DESC, job_id DESC)::int AS place FROM jobs QUALIFY place <= 20")
def newest_jobs_order(spark, sf_dir):
    """The newest twenty jobs, newest first."""
    return in_place(catalog.newest(_jobs(spark, sf_dir))).select("job_id", "place")


@query(catalog.JOBS_SQL + " SELECT repo_id, row_number() OVER (ORDER BY min(created_at) DESC, repo_id)::int AS place FROM jobs GROUP BY repo_id")
def repos_order(spark, sf_dir):
    """Repositories, newest first."""
    repos = _jobs(spark, sf_dir).groupBy("repo_id").agg(F.min("created_at").alias("created_at"))
    return in_place(catalog.newest_repos(repos)).select("repo_id", "place")


@query(CLASSIFIED + ", e AS (SELECT repo_id, path, reason FROM classified WHERE outcome = 'excluded' UNION SELECT repo_id, excluded_path, reason FROM classified WHERE outcome = 'pruned') SELECT repo_id, path, reason, row_number() OVER (PARTITION BY repo_id ORDER BY path)::int AS place FROM e")
def exclusions_order(spark, sf_dir):
    """Each repository's exclusions by path."""
    return in_place(classify.excluded_paths(_classified(spark, sf_dir)).orderBy("repo_id", "path"), "repo_id")


@query(FILES + " SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY file_id)::int AS place FROM files")
def path_index_order(spark, sf_dir):
    """The path index by file id, which is the order of path components."""
    return in_place(pyramid.path_index(_indexed(spark, sf_dir)), "repo_id").select("repo_id", "path", "place")


@query(SCATTERED + ", k AS (SELECT DISTINCT repo_id, z, tx, ty FROM feats) SELECT repo_id, z, tx AS x, ty AS y, row_number() OVER (PARTITION BY repo_id ORDER BY z, tx, ty)::int AS place FROM k")
def tile_keys_order(spark, sf_dir):
    """Each repository's tile addresses by zoom, column and row."""
    return in_place(pyramid.tile_keys(_tiles(spark, sf_dir)), "repo_id")
