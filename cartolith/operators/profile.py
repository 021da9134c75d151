"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def scan_flags(classified: DataFrame) -> DataFrame:
    """Counts over all files, without exclusion rules: text files, lines, bytes, and what was skipped."""
    plain = ~F.col("is_binary") & ~F.col("is_oversize")
    return classified.agg(
        F.count_if(plain).alias("files"), F.coalesce(F.sum(F.when(plain, F.col("lines"))), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(plain, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("is_binary") & ~F.col("is_oversize")).alias("skipped_binary"), F.count_if("is_oversize").alias("skipped_oversize"),
    )


def language_profile(files: DataFrame) -> DataFrame:
    """Files, lines and bytes by language, most lines first."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")).orderBy(F.desc("lines"), "language")


def language_rollup(files: DataFrame) -> DataFrame:
    """The same with a row `total`."""
    rolled = files.rollup("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.grouping_id().alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("language")).alias("language"), "files", "lines", "bytes")


def by_language_map(files: DataFrame) -> DataFrame:
    """One row: language to statistics, sorted by name."""
    each = files.groupBy("language").agg(F.struct(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")).alias("s"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "s")))).alias("by_language"))


def repo_stats(nodes: DataFrame, approximate: bool = False) -> DataFrame:
    """Per repository: files, directories, lines, bytes, and distinct languages of its files."""
    is_file = F.col("kind") == "file"
    langs = F.when(is_file, F.col("language"))
    return nodes.groupBy("repo_id").agg(
        F.count_if(is_file).alias("files"), F.count_if(~is_file).alias("directories"), F.coalesce(F.sum(F.when(is_file, F.col("lines"))), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(is_file, F.col("bytes"))), F.lit(0)).alias("bytes"), (F.approx_count_distinct(langs) if approximate else F.countDistinct(langs)).alias("languages"),
    )


def layer_range(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.coalesce(F.min("lines"), F.lit(0)).alias("min_lines"), F.coalesce(F.max("lines"), F.lit(0)).alias("max_lines"))


def index_summary(files: DataFrame, symbols: DataFrame, imports: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    first = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("parsed").alias("parsed"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return first.crossJoin(n(symbols, "symbols")).crossJoin(n(imports, "imports")).crossJoin(n(excluded, "excluded"))  # one-row sides


def counts_by_file(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """files with n_symbols and n_imports, 0 where there are none."""
    n = lambda df, name: df.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias(name))
    out = files.join(n(symbols, "n_symbols").hint("merge"), ["repo_id", "path"], "left").join(n(imports, "n_imports").hint("merge"), ["repo_id", "path"], "left")
    return out.na.fill(0, ["n_symbols", "n_imports"])


def nearest_rank(values: DataFrame, group: str, value: str, ranks: tuple[float, ...] = (0.5, 0.95, 0.99), approximate: bool = False) -> DataFrame:
    """Per group: n, mean, max, and percentiles by sorted[round((n - 1) * p)], halves away from zero.

    Exact: equal values are first counted together, and a group's distinct values are dealt into buckets between
    approximate quantiles, whose counts give each bucket its first rank: a large group isn't one task.
    """
    named = [(p, f"p{int(p * 100)}") for p in ranks]
    base = values.groupBy(group).agg(F.count(value).alias("n"), (F.sum(value) / F.greatest(F.count(value), F.lit(1))).alias("mean"), F.max(value).alias("max"))
    if approximate:
        quick = values.groupBy(group).agg(*[F.percentile_approx(value, p, 10_000).alias(name) for p, name in named])
        return base.join(quick, group)
    times = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    cuts = values.groupBy(group).agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)], 1000).alias("__cuts"))
    times = times.join(cuts.hint("merge"), group).withColumn("__b", F.size(F.filter("__cuts", lambda q: q < F.col(value)))).drop("__cuts")
    sums = times.groupBy(group, "__b").agg(F.sum("k").alias("__k"))
    firsts = sums.select(group, "__b", F.coalesce(F.sum("__k").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.sum("__k").over(W.partitionBy(group)).alias("n"))
    w = W.partitionBy(group, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto = times.join(firsts.hint("merge"), [group, "__b"]).withColumn("hi", F.col("__first") + F.sum("k").over(w))
    at = lambda p: F.round((F.col("n") - 1) * p)
    picked = upto.groupBy(group).agg(*[F.min(F.when(F.col("hi") > at(p), F.col(value))).alias(name) for p, name in named])
    return base.join(picked.hint("merge"), group)
