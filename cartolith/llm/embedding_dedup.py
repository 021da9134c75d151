"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import components, materialise, table

#: Cells grow with the root of the number of vectors, up to so many. k-means learns from LEARN_ROWS vectors, or four a cell
#: where that is more: those with the smallest hashes; all vectors are then assigned.
MOST_CELLS = 16_384
LEARN_ROWS = 16_384
BLOCK_ROWS = 4096
THRESHOLD = 0.98


def usable(v):
    """Neither null nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # very large or small components don't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of x's rows, started from its first rows."""
    x = unit(x)
    c = np.unique(x[:cells], axis=0)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def reach(x: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells may hold the midpoint of a row and a vector that is linked with it.

    The midpoint is at most r away on the unit sphere, so only cells whose border is that near count: a pair with
    cosine >= threshold meets in the cell of its midpoint, always.
    """
    r = math.sqrt(max(0.0, 2 - 2 * math.sqrt((1 + threshold) / 2)))
    dots = x @ centres.T
    own = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    return dots >= dots[np.arange(len(x)), own][:, None] - r * apart[own] - 1e-7


def _assign(centres, dim: int, threshold: float, names: list[str]):
    """Each vector once for every cell that it reaches, with all of those cells: what they are is decided here alone."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(b.column(2).value_lengths())
            same, other = np.flatnonzero(sizes == dim), np.flatnonzero(sizes != dim)
            rows, cells, all_cells = [other], [np.full(len(other), -1)], [[-1]] * len(other)
            for i in range(0, len(same), 2048):
                part = same[i : i + 2048]
                r, c = np.nonzero(reach(unit(_matrix(b.column(2).take(pa.array(part)), dim)), centres.value, threshold))
                rows.append(part[r])
                cells.append(c)
                own = np.split(c, np.flatnonzero(np.diff(r)) + 1)
                all_cells += [x.tolist() for x in own for _ in x]
            rows, cells = np.concatenate(rows), np.concatenate(cells).astype(np.int32)
            for i in range(0, len(rows), 8192):
                take = pa.array(rows[i : i + 8192])
                yield pa.RecordBatch.from_arrays([c.take(take) for c in b.columns] + [pa.array(cells[i : i + 8192]), pa.array(all_cells[i : i + 8192], pa.list_(pa.int32()))], names)

    return run


def _compare(threshold: float):
    """Links between the two blocks of a group: for each vector their number, and edges that connect what they connect."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cell, bi, bj = key[1].as_py(), key[3].as_py(), key[4].as_py()
        ids, copies, block = (np.asarray(group.column(n)) for n in ("vec_id", "copies", "block"))
        x = unit(_matrix(group.column("embedding"), key[2].as_py()))
        # the smaller cells that each vector reaches: a pair that meets in one of those is counted there
        lists = group.column("cells").combine_chunks()
        owner, flat = np.repeat(np.arange(len(x)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
        owner, flat = owner[flat < cell], flat[flat < cell]
        names, place = np.unique(flat, return_inverse=True)
        smaller = np.zeros((len(x), len(names)), bool)
        smaller[owner, place] = True
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        count, root = np.zeros(len(x), np.int64), np.arange(len(x))
        pairs_i, pairs_j = [], []
        for i in range(0, len(left), 512):
            a = left[i : i + 512]
            p, q = np.nonzero(x[a] @ x[right].T >= threshold)
            p, q = a[p], right[q]
            if bi == bj:
                p, q = p[p < q], q[p < q]
            here = np.ones(len(p), bool)
            for k in range(0, len(p) if len(names) else 0, 1 << 14):
                s = slice(k, k + (1 << 14))
                here[s] = ~(smaller[p[s]] & smaller[q[s]]).any(1)
            p, q = p[here], q[here]
            np.add.at(count, p, copies[q])
            np.add.at(count, q, copies[p])
            pairs_i.append(p)
            pairs_j.append(q)
        p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (pairs_i, pairs_j))
        while len(p):
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        linked, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": np.concatenate([ids[linked], ids[moved]]), "b": np.concatenate([ids[linked], ids[root[moved]]]), "n": np.concatenate([count[linked], np.zeros(len(moved), np.int64)])})

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label link at a cosine of `threshold` or more, in double precision. Equal vectors are compared once
    and counted as often as they come. Cells are fitted on a bounded sample; every vector goes to each cell that may
    hold the midpoint of one of its links, and a pair counts in the first cell that both go to, so no link is missed or
    counted twice. Large cells are compared as pairs of blocks. kept is true for one vector, the smallest id, of each group.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of another length than most are compared with those of their length. Rows with one vec_id share their
    component; those without one link like others, are counted by the vectors they link with and belong to their group,
    and are kept only where no vector of the group has an id; extra columns are not read; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    good = rows.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    distinct = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # numbers of their own, as different vectors may have one vec_id
    known = materialise(distinct.select(F.monotonically_increasing_id().alias("vec_id"), "label", "embedding", "copies", "first_id"))
    distinct = known.drop("first_id")
    total = distinct.count()
    cells = int(min(MOST_CELLS, max(1, math.isqrt(total) // 4)))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEARN_ROWS, 4 * cells)).select("embedding").toArrow().column(0).combine_chunks()
    sizes = np.asarray(sample.value_lengths()) if len(sample) else np.zeros(0, np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    learn = _matrix(sample.take(pa.array(np.flatnonzero(sizes == dim))), dim) if len(sizes) else np.ones((1, 1))
    centres = spark.sparkContext.broadcast(spherical_kmeans(learn, cells))  # at most MOST_CELLS rows
    schema = T.StructType([*distinct.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    dealt = distinct.mapInArrow(_assign(centres, dim, threshold, schema.names), schema).withColumn("dim", F.size("embedding"))
    dealt = materialise(dealt)
    group = ["label", "cell", "dim"]
    blocks = dealt.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = dealt.join(blocks.hint("shuffle_hash"), group).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    found = materialise(paired.groupBy(*group, "bi", "bj").applyInArrow(_compare(threshold), "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    reps = known.withColumnRenamed("vec_id", "rep").join(counts.hint("merge"), "rep", "left").join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = reps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    reps = reps.join(smallest.hint("merge"), "root").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = rows.join(reps.hint("merge"), ["label", "embedding"], "left")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE g AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98::double),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
"""
