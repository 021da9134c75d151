"""Shards that all match the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import ranked, table

#: Rows that one rank bucket holds, about; in large tables there are at most 16^MOST_DIGITS buckets, and they hold more.
BUCKET_ROWS = 20_000
MOST_DIGITS = 4


def shuffled(doc_id: Column, seed: int) -> Column:
    """A seeded order that any engine with MD5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def hash_bucket(key: Column, rows: int) -> Column:
    """The first hexadecimal digits of a hash: as many as give buckets of about BUCKET_ROWS rows."""
    digits = min(MOST_DIGITS, max(0, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))))
    return F.substring(key, 1, digits)


def source_ranks(rows: DataFrame, total: int, seed: int) -> DataFrame:
    """rows(doc_id, source, ...) with `rank`, from 0 within each source in seeded order."""
    ties = [c for c in rows.columns if c != "source"]  # rows that tie in all columns are the same
    rows = rows.withColumn("__h", shuffled(F.col("doc_id"), seed))
    return ranked(rows, ["source"], "__h", ties, hash_bucket(F.col("__h"), total), "rank").drop("__h")


def shard(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    Law `rows`: the seeded ranks within each source, as fractions of the source's size, give one order of all rows,
    which is cut into `shards` runs whose counts are at most one apart; each holds every source in proportion, within
    a row or so. Texts aren't moved. A null source is a source; null texts have size 1 and checksum 0; copies and
    repeated doc_ids are rows of their own; extra columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("__of"))
    total = docs.select("doc_id").count()
    placed = source_ranks(rows, total, seed).alias("l").join(sizes.alias("r").hint("shuffle_hash"), F.col("l.source").eqNullSafe(F.col("r.source")))
    placed = placed.select("l.*", ((F.col("rank") + 0.5) / F.col("__of")).alias("__at"))
    buckets = min(16**MOST_DIGITS, max(1, math.ceil(total / BUCKET_ROWS)))
    ordered = ranked(placed, [], "__at", ["source", "rank"], F.floor(F.col("__at") * buckets), "__g")
    ordered = ordered.withColumn("shard", F.expr(f"cast((__g * {shards}) div {max(total, 1)} as int)"))
    begin = F.expr(f"(shard * cast({max(total, 1)} as bigint) + {shards - 1}) div {shards}")
    return ordered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__g") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = """
WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS t, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) AS b FROM documents),
r AS (SELECT doc_id, source, strlen(t) + 1 AS size, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(table_[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) AS text_crc32,
  row_number() OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::varchar, 'null')), doc_id) - 1 AS rank,
  count(*) OVER (PARTITION BY source) AS n FROM bytes, crcs),
g AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::double) / n, source, rank) - 1 AS g, count(*) OVER () AS total FROM r),
s AS (SELECT *, (g * 16) // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::int AS shard, g - (shard * total + 15) // 16 AS slot, NULL::int AS grown_shard, source FROM s
"""
