"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import ROW, materialise, row_ids, table

#: Over the text's bytes in hexadecimal: a chunk ends after its 512th byte at the first three bytes whose low halves are
#: in these sets, one place in 64 whatever the script, or after 4096 bytes.
CHUNK = r".{1018}(?:..){0,3584}?.[159D].[26AE].[048C]|.{1,8192}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """The text, in hexadecimal, cut where its content says so: equal passages give equal chunks, equal texts equal lists."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    """96 bits of two hashes: among the 1.6e11 chunks of 100 TB two with one identifier are a matter of one in millions."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.hash(chunk).alias("b"))


def exact_groups(docs: DataFrame, fingerprint=identifier) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A chunk's identifier is its fingerprint, once all chunks with that fingerprint are shown to be the same text; each
    task sends a chunk once for that. Should several chunks share a fingerprint after all, the chunks themselves join the
    identifiers. Rows are equal when their ordered identifier lists are; only those lists move, not the texts.

    Of a group the row with the smallest doc_id stays, null ids last, and one of rows with the same id. Null texts
    count as empty, empty texts are one group, repeated doc_ids stay rows of their own, other columns are not read, and
    an empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("__t"))
    parts = rows.select(F.explode(chunks(F.col("__t"))).alias("chunk"))
    parts = parts.select(fingerprint(F.col("chunk")).alias("fp"), F.unhex("chunk").alias("chunk"))
    distinct = parts.groupBy("fp", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashing = materialise(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    clash = not clashing.isEmpty()
    cut = chunks(F.col("__t"))
    listed = rows.select("doc_id", F.sha2(F.encode("__t", "UTF-8"), 256).alias("text_sha256"), F.transform(cut, lambda c: fingerprint(c)).alias("ids"), *([cut.alias("__c")] if clash else []))
    listed = materialise(listed.withColumn("__r", F.monotonically_increasing_id()))
    if clash:
        each = listed.select("__r", F.posexplode(F.arrays_zip("ids", "__c")).alias("pos", "x"))
        told = each.join(clashing.hint("shuffle_hash"), F.col("x.ids") == F.col("fp")).groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("pos", "x.__c"))).alias("texts"))
        listed = listed.join(told.hint("merge"), "__r", "left").drop("__c").withColumn("recipe", F.struct("ids", "texts"))
    else:
        listed = listed.withColumn("recipe", F.struct("ids"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__r")).alias("first")
    groups = listed.groupBy("recipe").agg(first, F.count(F.lit(1)).alias("group_size"))
    # a group with a third of all rows is one row of `groups`; the sort-merge join lets AQE split its rows
    joined = listed.join(groups.hint("merge"), "recipe")
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("__r") == F.col("first.__r")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts one row stays, with the smallest doc_id (null ids last).

    Rows are told apart by more than their ids: a null id loses no row, and a repeated one keeps no copy. Columns of
    any name pass through; an empty table gives an empty result.
    """
    rows = row_ids(docs)
    keep = exact_groups(rows.select(F.col(ROW).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(ROW))
    return rows.join(keep.hint("merge"), ROW, "left_semi").select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(x) AS text_sha256 FROM g
"""
