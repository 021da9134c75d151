"""Helpers shared by the operators: shared storage, Arrow text access, word hashes, ranks and components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: The ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees.

    Where that is unset a local session gets a folder of its own; on a cluster, where each executor would write to a
    disk of its own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
    return f"{root}/cartolith-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and sizes are known."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column that row_ids adds.
ROW = "__row"


def row_ids(docs: DataFrame) -> DataFrame:
    """docs with ROW, which no two rows share and which orders rows by doc_id, null ids last.

    It is the doc_id itself where all are there and differ. Else the rows are written once, in order, with numbers.
    """
    n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == distinct:
        return docs.withColumn(ROW, F.col("doc_id"))
    # rows of one id are dealt over several tasks by their texts
    return materialise(docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn(ROW, F.monotonically_increasing_id()))


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes, so that work arrays stay small; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (exclusive) and rows, and the lower-cased bytes; offsets are relative to data."""
    low = _LOWER[data]
    full = ~_IS_SPACE[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | cut[1:-1]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1, low


def word_hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of low[start:stop]; very long words, for which powers modulo 2^64 are weak, get another hash."""
    import xxhash

    up, down = _power_tables(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    sizes = (stops - starts).astype(np.uint64)
    out = mix((sums[stops] - sums[starts]) * down[starts] + sizes * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(sizes > 512):
        out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : stops[i]].tobytes())
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its `width`-word shingles) for every row of a text column."""
    data, offsets = text_buffers(column)
    for i, j in pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        starts, stops, rows, low = words_of(data[offsets[i] : offsets[j]], at)
        h = word_hashes(low, starts, stops)
        first = np.searchsorted(rows, np.arange(j - i + 1))
        rolled = chain([h[k : len(h) - width + 1 + k] for k in range(width)]) if len(h) >= width else h[:0]
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                yield i + r, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield i + r, chain([h[k : k + 1] for k in range(a, b)])
            else:
                yield i + r, h[:0]


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """An order-aware hash of aligned hash arrays."""
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) + p
    return mix(x)


def flat_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array per row."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def ranked(df: DataFrame, groups: list[str], key: str, ties: list[str], bucket: Column, name: str) -> DataFrame:
    """df with `name`: the row's rank from 0 within its group in the order of (key, ties).

    `bucket` is a monotone, deterministic function of key with enough values that one bucket of a group fits a task,
    and few enough (65,536) that a group's bucket counts fit one as well. They give each bucket its offset, so even a
    group with all rows is ranked by many tasks.
    """
    b, off = f"__b_{name}", f"__o_{name}"
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    if not groups:
        before = W.partitionBy(F.lit(0)).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*groups, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off))
    # null-safe keys: a null group is a group too
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*groups, b]]
    joined = df.alias("l").join(offsets.alias("r").hint("shuffle_hash"), on).select("l.*", F.col(f"r.{off}"))
    within = W.partitionBy(*groups, b).orderBy(key, *ties)
    return joined.withColumn(name, F.col(off) + F.row_number().over(within) - 1).drop(b, off)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Alternating large and small stars over an edge table that is written to the shared folder after each round; the
    number of rounds grows with the logarithm of the graph's size, and no task or driver holds a whole component.
    """
    now = materialise(_local_forest(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("shuffle_hash"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("shuffle_hash"), "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _local_forest(edges: DataFrame) -> DataFrame:
    """Each task keeps a spanning forest of its edges, batch by batch."""

    def run(batches):
        for batch in batches:
            parent: dict[int, int] = {}

            def find(x):
                while (p := parent.get(x, x)) != x:
                    parent[x] = parent.get(p, p)
                    x = p
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := find(a)) != (y := find(b)):
                    parent[max(x, y)] = min(x, y)
            out = [(n, find(n)) for n in list(parent)]
            out = [(n, r) for n, r in out if n != r]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
