"""A Merkle manifest of a data set: one tree per language under one root, and proofs of many leaves at once.

Nodes are (tree, level, pos, digest): level 0 holds the leaves of a tree in order, each higher level the digests of
ARITY neighbours of the one below. The subroots of the trees, in order, are the leaves of the tree CROWN.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cartolith.llm.common import materialise, table

ARITY = 8
#: A block is a subtree of so many levels: 4,096 leaves, which one task folds and proves together.
BLOCK_LEVELS = 4
BLOCK = ARITY**BLOCK_LEVELS
#: The tree whose leaves are the subroots.
CROWN = -1
#: A node so many levels above a block's top is wanted by thousands of blocks: its requests are dealt over SALTS copies.
WIDE_LEVEL, SALTS = 2 * BLOCK_LEVELS, 32
NODES = "tree long, level int, pos long, digest string"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(21)]), lambda p: p < n))


def sorted_runs(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, written in order of group and `order` with the columns __part and __at; and the runs of each group.

    A group with many rows lies in many partitions of the sort; a run is a group's rows in one of them: __part, the group,
    __first (its least __at), __before (rows of the group in earlier runs) and size (of the whole group). There are at
    most as many runs as partitions and groups. Nulls come first.
    """
    at = rows.orderBy(group, *order).withColumn("__at", F.monotonically_increasing_id())
    at = materialise(at.withColumn("__part", F.shiftright("__at", 33)))
    runs = materialise(at.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(W.partitionBy(group))})
    return at, runs


def placed(at: DataFrame, runs: DataFrame, group: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows of sorted_runs with pos, their place in their group from 0, and size and `more` of their run."""
    on = (F.col("l.__part") == F.col("r.__part")) & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    pos = (F.col("r.__before") + F.col("l.__at") - F.col("r.__first")).alias("pos")
    kept = [F.col(f"l.{c}") for c in at.columns if c not in ("__part", "__at")]
    return at.alias("l").join(runs.alias("r").hint("merge"), on).select(*kept, pos, *[F.col(f"r.{c}") for c in ("size", *more)])


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The levels above `digests`."""
    out = []
    for _ in range(levels):
        digests = [_hex("".join(digests[i : i + ARITY])) for i in range(0, len(digests), ARITY)]
        out.append(digests)
    return out


def _folder(base: int):
    """What folds one block of nodes of level `base`."""

    def fold(key, rows):
        rows = rows.sort_by("pos")
        whole = rows.column("depth")[0].as_py()
        levels = fold_levels(rows.column("digest").to_pylist(), min(BLOCK_LEVELS, whole - base))
        level = np.concatenate([np.full(len(x), base + 1 + k, np.int32) for k, x in enumerate(levels)])
        pos = np.concatenate([key[1].as_py() * BLOCK // ARITY ** (k + 1) + np.arange(len(x)) for k, x in enumerate(levels)])
        flat = [d for x in levels for d in x]
        return pa.table({"tree": np.full(len(flat), key[0].as_py()), "level": level, "pos": pos, "digest": flat, "depth": np.full(len(flat), whole, np.int32)})

    return fold


def grow(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes above leaves(tree, pos, digest, depth), block by block and then over the blocks' tops; `most`: the
    greatest depth, which says how many rounds there are (three for 7e10 leaves)."""
    rounds = []
    now, base = leaves.select("tree", "pos", "digest", "depth"), 0
    while base < most:
        blocks = now.where(F.col("depth") > base).groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"))
        made = materialise(blocks.applyInArrow(_folder(base), f"{NODES}, depth int"))
        rounds.append(made.select("tree", "level", "pos", "digest"))
        base += BLOCK_LEVELS
        now = made.where(F.col("level") == base).select("tree", "pos", "digest", "depth")
    nodes = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest")
    for r in rounds:
        nodes = nodes.unionByName(r)
    return nodes


@dataclass
class Manifest:
    """rows: the leaves with the columns given to build, tree, pos, size (of the tree), depth. trees: tree, lang, size,
    depth. nodes: all nodes of all trees and of the CROWN. crown_size and crown_depth: of the CROWN."""

    rows: DataFrame
    trees: DataFrame
    nodes: DataFrame
    crown_size: int
    crown_depth: int


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of leaves(lang, digest, and others): a tree for each lang, whose leaves lie in `order` and, where that
    ties, in order of their digests. Null is a lang of its own and the first; nulls of `order` come first as well."""
    at, runs = sorted_runs(leaves, "lang", [*order, "digest"])
    names, name_runs = sorted_runs(runs.groupBy("lang").agg(F.max("size").alias("leaves")).withColumn("__one", F.lit(0)), "__one", ["lang"])
    trees = placed(names, name_runs, "__one").select(F.col("pos").alias("tree"), "lang", F.col("leaves").alias("size"), depth(F.col("leaves")).alias("depth"))
    trees = materialise(trees)
    number, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    runs = runs.alias("l").join(trees.alias("r").hint("merge"), F.col("l.lang").eqNullSafe(F.col("r.lang"))).select("l.*", "r.tree", "r.depth")
    rows = materialise(placed(at, runs, "lang", ("tree", "depth")))
    nodes = grow(rows, most)
    roots = nodes.join(trees.select("tree", "depth").hint("merge"), "tree").where(F.col("level") == F.col("depth"))
    over = len([k for k in range(21) if ARITY**k < number])
    crown = grow(materialise(roots.select(F.lit(CROWN).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(over).alias("depth"))), over)
    return Manifest(rows, trees, nodes.unionByName(crown), number, over)


def path_requests(wanted: np.ndarray, size: int, levels: int) -> list[tuple[int, np.ndarray]]:
    """(level, positions) of the fewest nodes that, with the wanted leaves, give the root: on each level the children of
    wanted nodes' parents that aren't on a wanted leaf's way up themselves."""
    out, known, count = [], np.unique(wanted), size
    for level in range(levels):
        up = np.unique(known // ARITY)
        children = (up[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < count], known)))
        known, count = up, -(-count // ARITY)
    return out


def prove(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """Each row of wanted with `steps`, `subroot` and `root`.

    wanted has tree, pos, size and depth, as manifest.rows has, `digest` and any other columns. steps leads from the leaf
    to the root: structs of place (the node's own among its run), before and after (the digests of the others, joined).

    Each block of leaves lists the nodes that its wanted leaves lack, once and as few as will do, and fetches them in one
    join. From them and its leaves it derives the inner nodes that the leaves' ways up share, and lists every leaf's
    steps. A leaf that isn't wanted is fetched like any other node.
    """
    crown_size, crown_depth = manifest.crown_size, manifest.crown_depth
    dealt = wanted.withColumn("block", F.expr(f"pos div {BLOCK}"))

    def lacking(key, rows):
        tree, block = (k.as_py() for k in key)
        size, levels = rows.column("size")[0].as_py(), rows.column("depth")[0].as_py()
        asked = [(tree, level, pos) for level, pos in path_requests(rows.column("pos").to_numpy(), size, levels)]
        asked += [(CROWN, level, pos) for level, pos in path_requests(np.array([tree]), crown_size, crown_depth)]
        asked += [(tree, levels, np.zeros(1, np.int64)), (CROWN, crown_depth, np.zeros(1, np.int64))]
        n = [len(p) for _, _, p in asked]
        out = {"for_tree": np.full(sum(n), tree), "block": np.full(sum(n), block), "tree": np.repeat([a[0] for a in asked], n), "level": np.repeat(np.array([a[1] for a in asked], np.int32), n), "pos": np.concatenate([a[2] for a in asked])}
        return pa.table(out)

    asked = dealt.select("tree", "block", "pos", "size", "depth").groupBy("tree", "block").applyInArrow(lacking, "for_tree long, block long, tree long, level int, pos long")
    wide = (F.col("level") >= WIDE_LEVEL) | (F.col("tree") == CROWN)
    asked = asked.withColumn("salt", F.when(wide, F.pmod(F.xxhash64("for_tree", "block"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    nodes = manifest.nodes.select("*", F.explode(copies).alias("salt"))
    fetched = asked.join(nodes.hint("merge"), ["tree", "level", "pos", "salt"])
    fetched = fetched.select(F.col("tree").alias("of"), "level", F.col("pos").alias("at"), F.col("digest").alias("node"), F.col("for_tree").alias("tree"), "block")

    def expand(key, rows, got):
        if not len(rows):
            return empty
        tree = key[0].as_py()
        levels = rows.column("depth")[0].as_py()
        have: list[dict[int, str]] = [{} for _ in range(levels + 1)]
        crown: list[dict[int, str]] = [{} for _ in range(crown_depth + 1)]
        for of, level, at, node in zip(*(got.column(c).to_pylist() for c in ("of", "level", "at", "node")), strict=True):
            (crown if of == CROWN else have)[level][at] = node
        subroot, root = have[levels][0], crown[crown_depth][0]
        pos = rows.column("pos").to_pylist()
        have[0].update(zip(pos, rows.column("digest").to_pylist(), strict=True))
        ways: list[dict[int, list]] = []  # on each level the step of each node on a way up
        known = sorted(set(pos))
        for level in range(levels):
            step, up = {}, {}
            for p in known:
                if p // ARITY not in up:
                    run = [have[level][q] for q in range(p // ARITY * ARITY, p // ARITY * ARITY + ARITY) if q in have[level]]
                    up[p // ARITY] = run
                run = up[p // ARITY]
                step[p] = (p % ARITY, "".join(run[: p % ARITY]), "".join(run[p % ARITY + 1 :]))
            have[level + 1].update({q: _hex("".join(run)) for q, run in up.items()})
            ways.append(step)
            known = sorted(up)
        assert have[levels][0] == subroot, "the nodes don't belong to these leaves"
        crown[0][tree] = subroot
        top, p = [], tree
        for level in range(crown_depth):
            first = p // ARITY * ARITY
            run = [crown[level][q] for q in range(first, first + ARITY) if q in crown[level]]
            top.append((p - first, "".join(run[: p - first]), "".join(run[p - first + 1 :])))
            p //= ARITY
            crown[level + 1][p] = _hex("".join(run))
        steps = [s for q in pos for s in [*[ways[level][q // ARITY**level] for level in range(levels)], *top]]
        flat = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string()), pa.array([s[2] for s in steps], pa.string())], ["place", "before", "after"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * (levels + crown_depth)), flat)
        return rows.select(names).append_column("steps", lists).append_column("subroot", pa.array([subroot] * len(pos))).append_column("root", pa.array([root] * len(pos)))

    names = wanted.columns
    step = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
    schema = T.StructType([*wanted.schema.fields, T.StructField("steps", T.ArrayType(step)), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    return dealt.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps give."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def manifest_of(docs: DataFrame) -> Manifest:
    """The manifest of docs(doc_id, source, lang, n_chars, text): leaves by lang and doc_id.

    Equal doc_ids lie in order of their leaves; null doc_ids come first, null langs are a tree of their own; null texts
    and empty ones differ; extra columns aren't read; an empty table gives a manifest without rows. Texts are read
    once and only their digests are moved. rows has doc_id and `tampered`: the digest of a row whose text is
    lower-cased, for those whose doc_id's checksum 3 divides.
    """
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "lang", leaf_digest([*c, F.col("text")]).alias("digest"), F.when(chosen, leaf_digest([*c, low])).alias("tampered"))
    return build(materialise(rows), ["doc_id"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proofs of all leaves, and what they say of rows of which a third was tampered with."""
    manifest = manifest_of(table(spark, sf_dir, "documents"))
    proved = prove(manifest, manifest.rows.select("doc_id", "tree", "pos", "size", "depth", "digest", "tampered"))
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"])))
    folded = fold(F.coalesce("tampered", "digest"), F.col("steps"))
    rows = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8, crown_levels: int = 4) -> str:
    """DuckDB's form, for 8^levels documents a language and 8^crown_levels languages."""
    f = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    head = "||".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
l AS (SELECT *, sha256({head}||{f("text")}) AS leaf, sha256({head}||{f(low)}) AS low,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, x: xor(table_[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) % 3 = 0 AS chosen FROM documents, crcs),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce(CASE WHEN chosen THEN low END, leaf) AS used FROM l),
t0 AS (SELECT lang AS g, pos, leaf AS d FROM o)"""

    def tree(name: str, count: int) -> str:
        text = ""
        for k in range(count):
            text += f""",
{name}s{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k}),
{name}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}s{k} GROUP BY g, pos // 8)"""
        return text

    out += tree("t", levels)
    out += f",\nc0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, d FROM t{levels}), roots AS (SELECT g AS lang, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS c FROM t{levels})"
    out += tree("c", crown_levels)
    out += f",\nr AS (SELECT d AS root FROM c{crown_levels}),\np0 AS (SELECT o.*, subroot, c, used AS f, '' AS p FROM o JOIN roots ON o.lang IS NOT DISTINCT FROM roots.lang)"
    n = 0
    for name, at, count in (("t", "pos", levels), ("c", "c", crown_levels)):
        for k in range(count):
            on = f"s.pos = p.{at} // {8**k}" + (" AND s.g IS NOT DISTINCT FROM p.lang" if name == "t" else "")
            out += f",\np{n + 1} AS (SELECT p.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.a || p.f || s.b) ELSE p.f END AS f, CASE WHEN s.n > 1 THEN p.p || s.a || s.b ELSE p.p END AS p) FROM p{n} p JOIN {name}s{k} s ON {on})"
            n += 1
    return out + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{n}, r\n"


SQL = _sql()
