"""Interleaving sources to target weights as a Pfair schedule of their blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import table
from cartolith.llm.sharding import source_ranks

#: A block has so many rows at least, and in large tables so many that there are about MOST_BLOCKS blocks besides one for
#: each source: that bounds the schedule, which is made once and sent to the tasks.
BLOCK_ROWS = 64
MOST_BLOCKS = 1 << 17
#: Sources whose counts are gathered at most, and the smallest share of the weights that one may have: slots fit 64 bits.
MOST_SOURCES = 1_000_000
LEAST_SHARE = Fraction(1, 1 << 40)


def exact_weights(wanted: dict) -> dict:
    """The weights as whole numbers in exactly the same proportions; floating-point weights count at their exact value."""
    exact = {s: Fraction(w) for s, w in wanted.items()}
    total = sum(exact.values())
    if any(w <= 0 or w < LEAST_SHARE * total for w in exact.values()):
        raise ValueError("a weight isn't positive or is less than 2^-40 of all")
    scale = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * scale) for s, w in exact.items()}


def release(k: int, a: int, total: int) -> int:
    """The slot in which block k of a source with share a / total is released: floor(k / share)."""
    return k * total // a


def deadline(k: int, a: int, total: int) -> int:
    """The slot before which it is due: ceil((k + 1) / share)."""
    return -(-(k + 1) * total // a)


def schedule(weights: dict, blocks: dict) -> list[tuple]:
    """(source, k, slot, release, deadline) of the sources' blocks in the order of their slots.

    Each slot takes the released block with the earliest deadline, by name where equal. Slots in which no block waits
    stay empty, as sources that have run out leave theirs. All is whole-number arithmetic with the exact weights, so
    no source drifts, however long the schedule is.
    """
    total = sum(weights.values())
    waiting = [(0, str(s), i, s, 0) for i, s in enumerate(weights) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            released, name, i, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(k, weights[s], total), name, i, s, k, released))
        due, name, i, s, k, released = heapq.heappop(ready)
        out.append((s, k, slot, released, due))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (release(k + 1, weights[s], total), name, i, s, k + 1))
        slot += 1
    return out


def mix_sources(docs: DataFrame, weights: dict | None = None, power: float = 1.0, block_rows: int | None = None, seed: int = 11) -> DataFrame:
    """One row per row of docs(doc_id, source): doc_id, source, block, release, deadline, slot, position, in_mixture.

    Each source is put in seeded order and cut into blocks. Release times and deadlines from the exact weights and
    earliest deadline first keep every source, at every slot before the first runs out, less than one block from its
    weight. The schedule has a row for each block, about MOST_BLOCKS whatever the table's size, and the tasks place
    their rows by it: only each source's rows are sorted. `weights` maps sources to weights (others get none: an
    error); by default a source's weight is its row count to the given power (1: the natural mixture). `block_rows`
    sets the rows of a block.

    No row is dropped: slots of sources that have run out stay empty, and in_mixture tells the rows before the first
    source runs out, where the weights hold. position is gapless from 0. A null source is a source; null and repeated
    doc_ids stay rows; texts and other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy("source").agg(F.count(F.lit(1))).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights is not None and (missing := set(counts) - set(weights)):
        raise ValueError(f"no weight for {sorted(map(str, missing))[:5]}")
    total = sum(counts.values())
    size = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    order = sorted(counts, key=lambda s: (s is None, str(s)))
    whole = exact_weights({s: weights[s] if weights else counts[s] if power == 1 else counts[s] ** power for s in order})
    plan, at, ends = [], 0, {}
    for s, k, slot, released, due in schedule(whole, {s: -(-counts[s] // size) for s in order}):
        plan.append((s, k, slot, released, due, at))
        at += min(size, counts[s] - k * size)
        ends[s] = due
    rows = spark.createDataFrame(plan, "source string, block long, slot long, release long, deadline long, at long")
    rows = F.broadcast(rows.withColumn("source", F.col("source").cast(docs.schema["source"].dataType)))  # bounded by MOST_BLOCKS
    ranks = source_ranks(docs.select("doc_id", "source"), total, seed).withColumn("block", F.expr(f"rank div {size}"))
    placed = ranks.alias("l").join(rows.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source")) & (F.col("l.block") == F.col("p.block")))
    position = (F.col("p.at") + F.col("l.rank") % size).alias("position")
    inside = (F.col("p.slot") < min(ends.values(), default=0)).alias("in_mixture")
    return placed.select("l.doc_id", "l.source", "l.block", "p.release", "p.deadline", "p.slot", position, inside)


def in_mixed_order(docs: DataFrame, rows_per_file: int | None = None, **options) -> DataFrame:
    """All rows of docs as runs of the schedule: partition i holds the i-th run, in order.

    Rows of one doc_id, or without one, stay together at the place of that id. By default a run has 16,384 rows, more in
    large tables.
    """
    ids = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
    at = mix_sources(ids, **options).select("doc_id", "position")
    total = docs.select("doc_id").count()
    rows_per_file = rows_per_file or max(16_384, min(131_072, total // 512))
    parts = max(1, -(-total // rows_per_file))
    joined = docs.alias("l").join(at.alias("r").hint("merge"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))).select("l.*", F.col("r.position").alias("__at"))
    dealt = joined.repartitionById(parts, F.least(F.expr(f"__at div {rows_per_file}"), F.lit(parts - 1)).cast("int"))
    return dealt.sortWithinPartitions("__at").select(*docs.columns)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights: square roots of the sources' row counts, so that a dominant source takes less than its size."""
    return mix_sources(table(spark, sf_dir, "documents"), power=0.5)
