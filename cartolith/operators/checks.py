"""Invariants of tables and tile sets: each check gives the rows that break it, or one row of measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def not_once_at_max_zoom(tiled: DataFrame, files: DataFrame) -> DataFrame:
    """Files that aren't in exactly one tile of the largest zoom."""
    most = tiled.groupBy("repo_id").agg(F.max("z").alias("z"))
    seen = tiled.join(most, ["repo_id", "z"]).select("repo_id", F.explode("features").alias("f")).where("f.kind = 'file'").groupBy("repo_id", F.col("f.id").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    return files.select("repo_id", "file_id").join(seen.hint("merge"), ["repo_id", "file_id"], "left").where(F.coalesce("n", F.lit(0)) != 1)


def area_error(placed: DataFrame) -> DataFrame:
    """Per repository the relative difference of the files' cells from the world's area."""
    world = F.greatest(F.sum(F.when(F.col("parent_path") == "", F.col("weight"))), F.lit(1)).cast("double")
    cells = F.sum(F.when(F.col("kind") == "file", F.col("w") * F.col("h")))
    return placed.groupBy("repo_id").agg((F.abs(cells - world) / world).alias("error"))


def over_budget(tiled: DataFrame, most_features: int = 50_000, most_bytes: int = 256 * 1024) -> DataFrame:
    size = F.length(F.to_json(F.struct("features")))
    return tiled.select("repo_id", "z", "tx", "ty", F.size("features").alias("n"), size.alias("bytes")).where((F.col("n") > most_features) | (F.col("bytes") > most_bytes))


def misaligned(tiled: DataFrame, layered: DataFrame) -> DataFrame:
    """Tiles and layers whose numbers of features and values differ, or that have no partner."""
    at = ["repo_id", "z", "tx", "ty"]
    rows = tiled.select(*at, F.size("features").alias("n")).join(layered.select(*at, "layer", F.size("values").alias("m")), at, "full")
    return rows.where(F.coalesce("n", F.lit(-1)) != F.coalesce("m", F.lit(-1)))


def bad_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans that overlap the next one or end after the text."""
    after = F.lead("start").over(W.partitionBy("repo_id", "path").orderBy("start"))
    rows = spans.withColumn("after", after).join(texts.select("repo_id", "path", F.octet_length("content").alias("size")).hint("merge"), ["repo_id", "path"])
    return rows.where((F.col("after") < F.col("start") + F.col("len")) | (F.col("start") + F.col("len") > F.col("size")))


def bad_spans_in_lists(rows: DataFrame) -> DataFrame:
    """bad_spans where a file's spans are lists in its one row: repo_id, path, start of rows(repo_id, path, starts, lens,
    size). Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, (a, n, size) in enumerate(zip(*[batch.column(c) for c in ("starts", "lens", "size")], strict=True)):
                if not a.is_valid or not len(a):
                    continue
                a, n = (x.values.to_numpy().astype(np.int64) for x in (a, n))
                order = np.argsort(a, kind="stable")
                a, ends = a[order], (a + n)[order]
                bad = ends > size.as_py() if size.is_valid else np.zeros(len(a), bool)
                bad[:-1] |= a[1:] < ends[:-1]
                found.append(a[bad])
                at.append(np.full(len(found[-1]), i))
            if found:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([batch.column("repo_id").take(take), batch.column("path").take(take), pa.array(np.concatenate(found))], ["repo_id", "path", "start"])

    return rows.select("repo_id", "path", "starts", "lens", F.col("size").cast("long").alias("size")).mapInArrow(run, "repo_id string, path string, start long")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash: equal for equal tables."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("mark"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("total"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as often as they are missing."""
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    more = both.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, F.lit("a")).otherwise(F.lit("b"))
    return more.select(*a.columns, side.alias("side"), F.explode(F.array_repeat(F.lit(0), F.abs("__n").cast("int"))).alias("__k")).drop("__k")


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(parents, on, "left_anti")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(allowed) | F.col(column).isNull())
