"""The directory tree of each repository: nodes, ids, sums, dominant languages and zooms, without recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.functions import columns as c


def ranked(rows: DataFrame, bucket: Column, order: list, name: str) -> DataFrame:
    """rows with `name`: the place, from 1, within the repository in the given order.

    `bucket` is a function that doesn't fall along the order. Counts by bucket give each bucket its first place, so only
    the rows of one bucket are sorted together: a repository with most rows isn't one task.
    """
    keyed = rows.withColumn("__b", bucket)
    counts = keyed.groupBy("repo_id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("repo_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("repo_id", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.col("__first") + F.row_number().over(W.partitionBy("repo_id", "__b").orderBy(*order))
    return keyed.join(firsts.hint("merge"), ["repo_id", "__b"]).withColumn(name, place.cast("long")).drop("__b", "__first")


def file_ids(files: DataFrame, depth: int = 3) -> DataFrame:
    """files with file_id: 1, 2, ... within a repository, in the order of path components.

    Files below one directory are neighbours in that order; the first `depth` components are the bucket.
    """
    return ranked(files, F.slice(F.split("path", "/"), 1, depth), [F.split("path", "/")], "file_id")


def ids_in_order(rows: DataFrame, order: list[str], name: str = "id", bucket: Column | None = None) -> DataFrame:
    """Ids within each repository in the given order (symbols, imports, exclusions).

    Rows in the order of their files are sorted by 1024 files together; other orders need a bucket of their own.
    """
    if bucket is None:
        bucket = F.shiftright("file_id", 10) if order[0] == "file_id" else F.lit(0)
    return ranked(rows, bucket, order, name)


def first_ids(files: DataFrame, n: str) -> DataFrame:
    """files(repo_id, file_id, n) with __first: how many items, n of each, the files before have in the repository. Sums by 1024
    files give it."""
    rows = files.withColumn("__b", F.shiftright("file_id", 10))
    before = W.partitionBy("repo_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("repo_id", "__b").agg(F.sum(n).alias("__n"))
    sums = sums.select("repo_id", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__upto"))
    inside = W.partitionBy("repo_id", "__b").orderBy("file_id").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("__upto") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    return rows.join(sums.hint("merge"), ["repo_id", "__b"]).withColumn("__first", first).drop("__b", "__upto")


def ids_of_lists(rows: DataFrame, items: str, name: str = "id", key: tuple[str, ...] = ("repo_id", "file_id"), files: DataFrame | None = None) -> DataFrame:
    """rows(repo_id, file_id, items) with a row for each item: `item`, and its id within the repository, by file and then as
    the list has them. Lists move once, to the first id of their file.

    Where the rows have no file_id, files(repo_id, file_id, n) has the sizes of the lists, and `key` is what the two share.
    """
    if files is None:
        files = rows.select(*key, F.size(items).cast("long").alias("n"))
    found = rows.join(first_ids(files, "n").select(*key, "__first").hint("shuffle_hash"), list(key))
    kept = [c for c in rows.columns if c != items]
    out = found.select(*kept, "__first", F.posexplode(items).alias("__k", "item"))
    return out.select(*kept, "item", (F.col("__first") + F.col("__k") + 1).cast("long").alias(name))


def _above(path: Column) -> Column:
    """The directories above a path, outermost first, the root (an empty path) included."""
    p = c.parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))


def closure(files: DataFrame) -> DataFrame:
    """(directory, file) for every directory above each file: the columns of files, and dir and depth."""
    return files.select("*", F.posexplode(_above(F.col("path"))).alias("depth", "dir"))


def dir_rollup(files: DataFrame) -> DataFrame:
    """Per directory, the root (an empty path) included: depth, files, lines, bytes, weight, min_file_path.

    A file weighs max(lines, 1). One explode and one aggregation with partial sums; no recursion.
    """
    up = closure(files.select("repo_id", "path", "lines", "bytes"))
    return up.groupBy("repo_id", "dir").agg(
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"),
        F.sum(F.greatest("lines", F.lit(1))).alias("weight"), F.min("path").alias("min_file_path"),
    )


def dominant_language(files: DataFrame) -> DataFrame:
    """Per directory the language with the largest weight, by name where equal."""
    up = closure(files.select("repo_id", "path", "language", F.greatest("lines", F.lit(1)).alias("w")))
    sums = up.groupBy("repo_id", "dir", "language").agg(F.sum("w").alias("w"))
    best = F.min_by("language", F.struct(-F.col("w"), F.col("language")))
    return sums.groupBy("repo_id", "dir").agg(best.alias("language"))


def parent_path(path: Column) -> Column:
    p = c.parts(path)
    return F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")


def tree_nodes(files: DataFrame) -> DataFrame:
    """All nodes but the root: repo_id, id, kind, path, parent_path, parent_id, depth, lines, bytes, weight, language, min_file_path.

    files needs repo_id, file_id, path, language, lines, bytes. Directory ids follow the file ids, in the order in
    which the files' sorted paths first meet them, outer directories first; the root's id is 0.
    """
    dirs = dir_rollup(files).where("dir <> ''").join(dominant_language(files).hint("merge"), ["repo_id", "dir"])
    most = files.groupBy("repo_id").agg(F.max("file_id").alias("most"))
    # the path up to its third slash, that included, never falls along the order of paths
    top = F.regexp_extract("min_file_path", "^(?:[^/]*/){3}|^.*", 0)
    dirs = ranked(dirs, top, ["min_file_path", "depth"], "__place")
    dirs = dirs.join(most.hint("shuffle_hash"), "repo_id").withColumn("id", (F.col("most") + F.col("__place")).cast("long"))
    dir_nodes = dirs.select("repo_id", "id", F.lit("dir").alias("kind"), F.col("dir").alias("path"), "depth", "lines", "bytes", "weight", "language", "min_file_path")
    leaf_nodes = files.select(
        "repo_id", F.col("file_id").alias("id"), F.lit("file").alias("kind"), "path", F.size(c.parts(F.col("path"))).alias("depth"), "lines", "bytes",
        F.greatest("lines", F.lit(1)).alias("weight"), "language", F.col("path").alias("min_file_path"),
    )
    nodes = dir_nodes.unionByName(leaf_nodes).withColumn("parent_path", parent_path(F.col("path")))
    ids = dir_nodes.select("repo_id", F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    return nodes.join(ids.hint("merge"), ["repo_id", "parent_path"], "left").na.fill(0, ["parent_id"])


def world(files: DataFrame) -> DataFrame:
    """Per repository the total weight and the side of its square."""
    w = F.coalesce(F.sum(F.greatest("lines", F.lit(1))), F.lit(0))
    return files.groupBy("repo_id").agg(w.alias("world_weight"), F.sqrt(F.greatest(w, F.lit(1))).alias("side"))


def node_zooms(nodes: DataFrame) -> DataFrame:
    """nodes with appear_z and split_z.

    A directory splits at the largest, over itself and the directories above it but the root, of the smallest natural
    zoom among that directory's children; a node appears where its parent splits. Areas are weights.
    """
    total = nodes.where("parent_path = ''").groupBy("repo_id").agg(F.sum("weight").alias("__world"))
    natural = nodes.join(total.hint("shuffle_hash"), "repo_id").withColumn("__z", c.natural_zoom(F.col("weight").cast("double"), F.greatest("__world", F.lit(1)).cast("double")))
    least = natural.groupBy("repo_id", "parent_path").agg(F.min("__z").alias("__m")).where("parent_path <> ''")
    up = nodes.where("kind = 'dir'").select("repo_id", "path", F.explode(F.concat(F.filter(_above(F.col("path")), lambda x: x != ""), F.array("path"))).alias("parent_path"))
    split = up.join(least.hint("merge"), ["repo_id", "parent_path"]).groupBy("repo_id", "path").agg(F.max("__m").alias("split_z"))
    out = nodes.join(split.select("repo_id", F.col("path").alias("parent_path"), F.col("split_z").alias("appear_z")).hint("merge"), ["repo_id", "parent_path"], "left").na.fill(0, ["appear_z"])
    return out.join(split.hint("merge"), ["repo_id", "path"], "left").withColumn("split_z", F.coalesce("split_z", "appear_z"))


def max_zoom(zoomed: DataFrame) -> DataFrame:
    return zoomed.groupBy("repo_id").agg(F.least(F.max("appear_z"), F.lit(24)).alias("max_z"))


def visible_cut(zoomed: DataFrame) -> DataFrame:
    """One row per zoom at which a node is drawn: files from where they appear on, directories until they split."""
    rows = zoomed.join(max_zoom(zoomed).hint("shuffle_hash"), "repo_id").withColumn("__hi", F.when(F.col("kind") == "file", F.col("max_z")).otherwise(F.least(F.col("split_z") - 1, F.col("max_z"))))
    # sequence() counts down when its end is smaller
    return rows.where(F.col("__hi") >= F.col("appear_z")).withColumn("z", F.explode(F.sequence("appear_z", "__hi"))).drop("__hi")


def category_index(nodes: DataFrame) -> DataFrame:
    """Per repository each language with its place, from 0, among the sorted names."""
    names = nodes.groupBy("repo_id").agg(F.array_sort(F.collect_set("language")).alias("names"))
    return names.select("repo_id", F.posexplode("names").alias("idx", "language"))
