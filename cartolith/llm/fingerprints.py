"""Document fingerprints: threshold-scaled sketches of word shingles, which tell containment between unequal texts.

A fingerprint holds every shingle hash below a fixed share of the hash range; texts with fewer than LEAST of them hold
their LEAST smallest hashes, so that short texts have a fingerprint too. It is a string of 16 hexadecimal digits a hash,
in ascending order. Fingerprints of two texts can be merged into the one of both, and compared up to the hash to which
both are complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cartolith.llm.common import materialise, table

#: Words in a shingle; one hash in SHARE is kept, and LEAST hashes where there are as many.
WIDTH, SHARE, LEAST = 5, 16, 16
#: Hexadecimal digits of a hash, and the least hash that isn't below the share.
DIGITS = 16
BOUND = f"{(1 << 4 * DIGITS) // SHARE:0{DIGITS}x}"
#: Rows that one task compares with their neighbours: so many in large tables, fewer in small ones.
BLOCK_ROWS = 32_768
FEWEST_ROWS, MANY_BLOCKS = 1_024, 1_024


def shingle_digests(words: list[bytes]) -> list[str]:
    """The hash of each shingle in order; fewer words than WIDTH are one shingle."""
    if not words:
        return []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    joined, md5 = b" ".join(words), hashlib.md5
    return [md5(joined[a:b], usedforsecurity=False).hexdigest()[:DIGITS] for a, b in zip(starts, ends[min(WIDTH, len(words)) - 1 :].tolist(), strict=False)]


def kept(digests: list[str]) -> list[str]:
    """The hashes of a set that its fingerprint holds."""
    below = sorted({d for d in digests if d < BOUND})
    return below if len(below) >= LEAST else sorted(set(digests))[:LEAST]


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII white space."""
    return text.encode().lower().split()


def complete_to(hashes: list[str]) -> str:
    """Up to which hash a fingerprint holds all of its text's."""
    return "~" if len(hashes) < LEAST else max(BOUND, hashes[-1])


def likeness_of(a: list[str], b: list[str]) -> float:
    """The share of the smaller set that the larger contains, as estimated from two fingerprints."""
    if a == b:
        return 1.0
    to = min(complete_to(a), complete_to(b))
    x, y = {h for h in a if h <= to}, {h for h in b if h <= to}
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


# the same on columns


def hashes(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(f"([0-9a-f]{{{DIGITS}}})"), F.lit(1))


def _complete(held: Column) -> Column:
    return F.when(F.size(held) < LEAST, F.lit("~")).otherwise(F.greatest(F.lit(BOUND), F.element_at(held, -1)))


def containments(a: Column, b: Column) -> Column:
    """Of two fingerprints: in_b, the estimated share of a's shingles that b has, in_a the reverse, and likeness, the
    greater of the two; 1 for equal fingerprints, else 0 where nothing can be compared."""
    x, y = hashes(a), hashes(b)
    to = F.least(_complete(x), _complete(y))
    xs, ys = F.filter(x, lambda h: h <= to), F.filter(y, lambda h: h <= to)
    both = F.size(F.array_intersect(xs, ys))
    part = lambda n: F.when(a == b, F.lit(1.0)).when(n > 0, both / n).otherwise(F.lit(0.0))
    return F.struct(part(F.size(xs)).alias("in_b"), part(F.size(ys)).alias("in_a"), F.greatest(part(F.size(xs)), part(F.size(ys))).alias("likeness"))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' shingles together."""
    every = F.array_sort(F.array_union(hashes(a), hashes(b)))
    below = F.size(F.filter(every, lambda h: h < BOUND))
    return F.array_join(F.slice(every, F.lit(1), F.greatest(below, F.lit(LEAST))), "")


def pooled(rows: DataFrame, by: str) -> DataFrame:
    """(by, hash): the fingerprint of each group of rows(by, fingerprint), a row for each hash it holds.

    A group may hold a third of all rows: its hashes are made distinct over all tasks, and never stand in one.
    """
    every = rows.select(by, F.explode(hashes(F.col("fingerprint"))).alias("hash")).distinct()
    low = every.where(F.col("hash") < BOUND)
    least = every.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy("hash"))).where(F.col("__r") <= LEAST).drop("__r")
    return low.unionByName(least).distinct()


def contained_in(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """rows(doc_id, fingerprint) with `contained`: the estimated share of each row's shingles below the share of the hash
    range that pool(hash) has, and `compared`, how many these are; null where there are none."""
    mine = rows.select("doc_id", F.explode(hashes(F.col("fingerprint"))).alias("hash")).where(F.col("hash") < BOUND)
    found = mine.join(pool.select("hash").distinct().withColumn("__in", F.lit(1)).hint("merge"), "hash", "left")
    return found.groupBy("doc_id").agg((F.count("__in") / F.count(F.lit(1))).alias("contained"), F.count(F.lit(1)).alias("compared"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text; null counts as empty."""

    def run(texts):
        return texts.map(lambda t: "".join(kept(shingle_digests(words_of(t or "")))))

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(text)


# each text beside the next one


def _edges(keys: DataFrame, rows: int) -> np.ndarray:
    """The first key of each block of about `rows` rows of keys(k, h), in their order: 16 bytes for each block."""
    at = materialise(keys.orderBy("k", "h").withColumn("__at", F.monotonically_increasing_id()))
    first = at.where(F.expr(f"(__at & 8589934591) % {rows} = 0")).select("k", "h").distinct()
    got = first.toArrow().sort_by([("k", "ascending"), ("h", "ascending")])
    return np.stack([got.column(c).to_numpy() for c in ("k", "h")], 1)


def _block_of(edges: np.ndarray, k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and the block before if the key is a block's first (the last for the first), else -1."""
    low, high = np.searchsorted(edges[:, 0], k, "left"), np.searchsorted(edges[:, 0], k, "right")
    block = low - 1
    for i in np.unique(low[low < high]):
        mine = (low == i) & (low < high)
        end = high[mine][0]
        block[mine] = i - 1 + np.searchsorted(edges[i:end, 1], h[mine], "right")
    first = (edges[block, 0] == k) & (edges[block, 1] == h)
    return block, np.where(first, (block - 1) % len(edges), -1)


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, block, tail, k, h of docs(doc_id, text), dealt so that one task has each row and its next.

    Rows are in order of descending doc_id, null ids last, and of their texts' hashes and texts where ids are equal.
    Blocks of that order are tasks' work; the first row of each goes to the block before as well, as its tail, and the
    first of all to the last. Texts are shuffled once.
    """
    keys = [F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    small = materialise(docs.select(*keys))
    edges = _edges(small, max(FEWEST_ROWS, min(BLOCK_ROWS, small.count() // MANY_BLOCKS)))
    if not len(edges):
        edges = np.array([[0, 0]])

    @F.pandas_udf("block int, before int")
    def place(k, h):
        import pandas as pd

        block, before = _block_of(edges, k.to_numpy(), h.to_numpy())
        return pd.DataFrame({"block": block, "before": before})

    place = place.asNondeterministic()  # else it may run once for each use of its fields
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keys).withColumn("__p", place("k", "h"))
    own, more = F.struct(F.col("__p.block").alias("block"), F.lit(False).alias("tail")), F.struct(F.col("__p.before").alias("block"), F.lit(True).alias("tail"))
    rows = rows.select("doc_id", "text", "k", "h", F.explode(F.when(F.col("__p.before") >= 0, F.array(own, more)).otherwise(F.array(own))).alias("__b"))
    return rows.select("doc_id", "text", "__b.block", "__b.tail", "k", "h").repartition("block").sortWithinPartitions("block", "tail", "k", "h", "text")


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first characters of the following text, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Whole texts are hashed. A null text is an empty one, and an empty one's fingerprint is empty; equal fingerprints have
    likeness 1. Null and repeated ids and repeated rows are rows of their own (see beside_next); the only row of a table
    is its own next; extra columns aren't read; an empty table gives none.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(doc_id, text, digests, mine, following, theirs):
        n = len(text) // 3
        other = edited(text, following)
        # shingles before the cut's word are the same
        same = max(0, len(words_of(text[: len(text) - n])) - WIDTH)
        words = words_of(other)
        changed = digests[:same] + shingle_digests(words[same:]) if same else shingle_digests(words)
        held = kept(changed)
        return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), "".join(mine), "".join(held), likeness_of(mine, held), likeness_of(mine, theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, at, done = None, None, False  # the row before with its hashes
        for batch in batches:
            ids, texts, blocks, tails = (batch.column(c) for c in ("doc_id", "text", "block", "tail"))
            for i in range(len(batch)):
                block, tail = blocks[i].as_py(), tails[i].as_py()
                if block != at:
                    at, last, done = block, None, False
                if done:
                    continue  # repeats of the next block's first row
                text = texts[i].as_py()
                digests = shingle_digests(words_of(text))
                row = (ids[i].as_py(), text, digests, kept(digests))
                if last:
                    out.append(result(*last, row[1], row[3]))
                last, done = row, tail
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = T.StructType([T.StructField(n, T.LongType() if k == pa.int64() else T.DoubleType() if k == pa.float64() else T.StringType()) for n, k in zip(names, kinds, strict=True)])
    return beside_next(docs).mapInArrow(run, schema)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def _set_sql(text: str) -> str:
    """The fingerprint's hashes of a text, in DuckDB."""
    w = f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
    s = f"(SELECT list_sort(list_distinct(list_transform(CASE WHEN len(w) = 0 THEN []::bigint[] ELSE range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1) END, lambda i: substr(md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')), 1, {DIGITS})))) FROM (SELECT {w} AS w))"
    return f"(SELECT s[1:greatest(len(list_filter(s, lambda x: x < '{BOUND}')), {LEAST})] FROM (SELECT {s} AS s))"


def _likeness_sql(a: str, b: str) -> str:
    top = lambda x: f"CASE WHEN len({x}) < {LEAST} THEN '~' ELSE greatest('{BOUND}', {x}[-1]) END"
    cut = lambda x: f"list_filter({x}, lambda h: h <= least({top(a)}, {top(b)}))"
    n = f"least(len({cut(a)}), len({cut(b)}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::double WHEN {n} > 0 THEN len(list_intersect({cut(a)}, {cut(b)}))::double / {n} ELSE 0.0::double END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 3) || left(following, length(t) // 3) AS edited FROM n),
f AS (SELECT *, {_set_sql("t")} AS mine, {_set_sql("edited")} AS theirs FROM e),
g AS (SELECT *, coalesce(lead(mine) OVER (ORDER BY doc_id DESC), first_value(mine) OVER (ORDER BY doc_id DESC)) AS next_ FROM f)
SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(mine, '') AS fingerprint, array_to_string(theirs, '') AS edited_fingerprint,
  {_likeness_sql("mine", "theirs")} AS near_edited, {_likeness_sql("mine", "next_")} AS near_next FROM g
"""
