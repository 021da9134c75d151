"""File classification: one projection decides what becomes of each file; filters split it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.functions import tables as t


def classify(files: DataFrame, include_vendored: bool = False, max_bytes: int = t.MAX_FILE_BYTES) -> DataFrame:
    """files(repo_id, path, content) with size, hash, language, flags and outcome.

    outcome is `pruned` (below an excluded directory, excluded_path names it), `excluded` (a lockfile, minified or
    generated file) or `file`; reason says which rule. Rules in order: directory, name, size, binary, header.
    Oversize and binary files are kept with 0 lines; one may be both. Where content is null (sources/folder.py doesn't
    hold larger files) bytes, hash and has_nul of the source count. `include_vendored` turns the exclusion rules off. The text form of
    content is used when it is a string. All of it is one narrow projection: nothing is shuffled.
    """
    binary = dict(files.dtypes)["content"] == "binary"
    raw = F.col("content") if binary else F.col("content").cast("binary")
    text = c.latin1(raw) if binary else F.col("content")
    given = lambda name, kind: F.col(name) if name in files.columns else F.lit(None).cast(kind)
    size = F.coalesce(F.octet_length("content").cast("long"), given("bytes", "long"))
    nul = c.is_binary(raw) if binary else F.contains(F.substring("content", 1, t.SNIFF_BYTES), F.lit("\0"))
    digest = F.coalesce(F.sha2(raw, 256), given("hash", "string"))
    rows = files.withColumns({"is_binary": F.coalesce(nul, given("has_nul", "boolean"), F.lit(False)), "hash": digest, "bytes": size}).withColumn("is_oversize", F.col("bytes") > max_bytes)
    rows = rows.withColumn("language", c.language(F.col("path"))).withColumn("grammar", c.grammar(F.col("language"), F.col("path")))
    rules = F.lit(not include_vendored)
    pruned, named = c.excluded_dir(F.col("path")), c.excluded_name(F.col("path"))
    plain = ~F.col("is_oversize") & ~F.col("is_binary")
    rows = rows.withColumn("excluded_path", F.when(rules & pruned.isNotNull(), pruned))
    reason = (
        F.when(F.col("excluded_path").isNotNull(), F.element_at(F.split("excluded_path", "/"), -1))
        .when(rules & named.isNotNull(), named)
        .when(rules & plain & c.generated_header(text), F.lit("generated"))
    )
    rows = rows.withColumn("reason", reason)
    outcome = F.when(F.col("excluded_path").isNotNull(), "pruned").when(F.col("reason").isNotNull(), "excluded").otherwise("file")
    valid = F.is_valid_utf8(raw.cast("string")) if binary else F.lit(True)
    return rows.withColumn("outcome", outcome).withColumns(
        {
            "lines": F.when(plain, c.count_lines(text)).otherwise(F.lit(0).cast("long")),
            "parsed": plain & F.col("grammar").isNotNull() & F.coalesce(valid, F.lit(False)),
        }
    )


def kept_files(classified: DataFrame) -> DataFrame:
    return classified.where("outcome = 'file'")


def excluded_paths(classified: DataFrame) -> DataFrame:
    """repo_id, path, reason: excluded files, and each pruned directory once."""
    files = classified.where("outcome = 'excluded'").select("repo_id", "path", "reason")
    dirs = classified.where("outcome = 'pruned'").select("repo_id", F.col("excluded_path").alias("path"), "reason")
    return files.unionByName(dirs).distinct()
