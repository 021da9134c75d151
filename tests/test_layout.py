import math
import random

import numpy as np
import pytest
from cartolith.functions import columns as c
from cartolith.operators import evolution, pyramid, treemap
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.lists(st.integers(1, 400), min_size=1, max_size=120), st.floats(0.2, 5), st.lists(st.integers(0, 120), max_size=6))
@settings(max_examples=150, deadline=None)
def test_squarifier_equals_lists(areas, shape, cuts):
    """In one part or many: the cells of the plain form."""
    a = np.array(sorted(areas, reverse=True), float)
    w = math.sqrt(a.sum() * shape)
    h = a.sum() / w
    s = treemap.Squarifier(1.0, 2.0, w, h)
    ends = [0, *sorted(k for k in cuts if k <= len(a)), len(a)]
    got = [s.push(a[i:j], False) for i, j in zip(ends, ends[1:])] + [s.push(np.zeros(0), True)]
    assert np.allclose(np.concatenate(got), treemap.squarify(a.tolist(), 1.0, 2.0, w, h), atol=1e-9 * max(w, h), rtol=0)


def test_a_large_flat_directory_is_never_held(spark):
    rng = np.random.default_rng(1)
    a = np.sort(rng.pareto(1.5, 1_000_000) * 50 + 1)[::-1]
    side = math.sqrt(a.sum())
    s, most, area, n = treemap.Squarifier(0, 0, side, side), 0, 0.0, 0
    for i in range(0, len(a), 5000):
        cells = s.push(a[i : i + 5000], False)
        most, area, n = max(most, len(s.waiting)), area + (cells[:, 2] * cells[:, 3]).sum(), n + len(cells)
    cells = s.push(np.zeros(0), True)
    assert n + len(cells) == len(a) and abs(area + (cells[:, 2] * cells[:, 3]).sum() - a.sum()) < 1e-6 * a.sum() and most < 6000


def test_directories_in_any_batches(spark):
    """Level by level with small batches, and as whole repositories: the same cells."""
    rng = random.Random(2)
    rows, paths = [], [("", 0)]
    for k in range(700):
        parent, depth = rng.choice(paths[:12]) if k > 12 else ("", 0)
        path = f"{parent}/n{k}".lstrip("/")
        rows.append([rng.choice("rs"), path, parent, 0, depth + 1])
        if k <= 12:
            paths.append((path, 1))
    for r in rows:
        r[0] = "r"
    below = {}
    for r in rows:
        below.setdefault(r[2], []).append(r)
    weigh = lambda r: r.__setitem__(3, sum(map(weigh, below[r[1]])) if r[1] in below else rng.randrange(1, 60)) or r[3]
    for r in below[""]:
        weigh(r)
    nodes = spark.createDataFrame([tuple(r) for r in rows] + [("s", *r[1:]) for r in map(tuple, rows)], "repo_id string, path string, parent_path string, weight long, depth int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        levels = {(r.repo_id, r.path): (r.x, r.y, r.w, r.h) for r in treemap.lay_out(nodes, whole_nodes=0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    whole = {(r.repo_id, r.path): (r.x, r.y, r.w, r.h) for r in treemap.lay_out(nodes).collect()}
    assert levels.keys() == whole.keys() and all(np.allclose(levels[k], whole[k], atol=1e-6) for k in whole)


# tiles along the curve


@given(st.integers(0, 9), st.integers(-3, 520), st.integers(-3, 520), st.integers(0, 200), st.integers(0, 200), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_ranges_hold_the_box(z, x, y, w, h, most):
    code = lambda a, b: sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(12))
    ranges = c.morton_ranges(z, x, y, x + w, y + h, most)
    assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(b < a for (_, b), (a, _) in zip(ranges, ranges[1:]))
    size = 1 << z
    inside = [code(i, j) for i in range(max(x, 0), min(x + w, size - 1) + 1) for j in range(max(y, 0), min(y + h, size - 1) + 1)]
    assert all(any(a <= m <= b for a, b in ranges) for m in inside[:: max(1, len(inside) // 300)])
    assert bool(ranges) == bool(inside)


def rows_scanned(df) -> int:
    """Rows that the Parquet scan of a collected frame gave, before any filter in memory."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(found)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two repositories with all 16,384 tiles of zoom 7 and their parents."""
    root = str(tmp_path_factory.mktemp("tiles") / "set")
    tile = spark.range(1 << 14).selectExpr("id", "7 AS z", "id % 128 AS tx", "id div 128 AS ty").unionByName(spark.range(1 << 12).selectExpr("id", "6 AS z", "id % 64 AS tx", "id div 64 AS ty"))
    tile = tile.crossJoin(spark.createDataFrame([("r",), ("s",)], "repo_id string")).select("repo_id", "z", "tx", "ty", F.expr("transform(sequence(1, 40), k -> xxhash64(id, z, k))").alias("features"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pyramid.along_curve(tile).write.option("parquet.block.size", 1 << 16).option("parquet.page.size", 1 << 14).partitionBy("z").parquet(root)
    return spark.read.parquet(root), tile.count()


def test_one_tile_and_a_view_read_a_share(spark, stored):
    """The scan gives few rows more than the answer, which is what a full scan gives."""
    rows, total = stored
    code = rows.select("tx", "ty", "morton").where("tx = 5 AND ty = 3").first().morton
    assert code == 0b011011
    for box, share in (((77, 50, 77, 50), 0.06), ((30, 60, 41, 69), 0.2), ((0, 0, 127, 127), 0.5), ((200, 0, 300, 5), 0.0)):
        got = pyramid.in_box(rows, "s", 7, *box)
        keys = sorted((r.tx, r.ty) for r in got.collect())
        x0, y0, x1, y1 = box
        assert keys == [(x, y) for x in range(x0, min(x1, 127) + 1) for y in range(y0, min(y1, 127) + 1)]
        assert rows_scanned(got) <= share * total, (box, rows_scanned(got), total)


# imports and reachability


def test_longest_unique_ending(spark):
    paths = ["src/main/java/com/x/util/List.java", "src/test/java/com/x/util/List.java", "src/main/java/com/x/io/File.java", "lib/io/File.java", "app/core/index.ts", "app/util/mod.rs", "a/b.py", "pkg/a/b.py", "one.py"]
    files = spark.createDataFrame([("r", p) for p in paths] + [("q", "com/x/util/List.java")], "repo_id string, path string")
    asked = {
        "com.x.io.File": ("src/main/java/com/x/io/File.java", "heuristic"), "io.File": None, "com.x.util.List": None, "main.java.com.x.util.List": ("src/main/java/com/x/util/List.java", "heuristic"),
        "org/acme/core": ("app/core/index.ts", "heuristic"), "crate::util": ("app/util/mod.rs", "heuristic"), "a.b": ("a/b.py", "exact"), "x/one": ("one.py", "heuristic"), "nothing": None, "b": None, "./one": ("one.py", "heuristic"), "../one": ("one.py", "exact"), "../a/b": ("a/b.py", "exact"),
    }
    imports = spark.createDataFrame([("r", f"from/f{i}.x", m) for i, m in enumerate(asked)], "repo_id string, path string, module string")
    got = {r.src: (r.dst, r.confidence) for r in evolution.resolve_imports(imports, files).collect()}
    assert got == {f"from/f{i}.x": v for i, v in enumerate(asked.values()) if v}


def brute_hops(edges, entries):
    out, front, hop = {e: 0 for e in entries}, set(entries), 0
    while front:
        hop += 1
        front = {b for a, b in edges if a in front and b not in out}
        out |= dict.fromkeys(front, hop)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reachable_graphs(spark, seed):
    """Random graphs with chains, circles, entries inside chains, and loops."""
    rng = random.Random(seed)
    edges = [(f"c{k}", f"c{k + 1}") for k in range(40)] + [(f"o{k}", f"o{(k + 1) % 6}") for k in range(6)] + [("c12", "x0"), ("x3", "c30"), ("c40", "c40")]
    edges += [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(14)]
    entries = rng.choice([["c0"], ["c5", "x1"], ["c7"], ["o2", "c20"]])
    rows = spark.createDataFrame([("r", a, b) for a, b in edges] + [("q", "c0", "c1")], "repo_id string, src string, dst string")
    start = spark.createDataFrame([("r", e) for e in entries], "repo_id string, path string")
    assert {r.path: r.hops for r in evolution.reachable(rows, start).collect()} == brute_hops(edges, entries)


def test_a_round_along_chains_is_one_join(spark, monkeypatch):
    joins, real = [], type(spark.range(1)).join
    monkeypatch.setattr(evolution, "staged", lambda df: df.localCheckpoint())
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, *a, **k: joins.append(1) or real(self, *a, **k))
    counts = []
    for n in (16, 64):
        edges = spark.range(n).selectExpr("'r' AS repo_id", "cast(id AS string) AS path", "cast(id + 1 AS string) AS dst")
        joins.clear()
        evolution.contracted(edges, spark.createDataFrame([("r", "0")], "repo_id string, path string"))
        counts.append(len(joins))
    assert counts[1] - counts[0] == 2  # a chain of four times the length takes two rounds more


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    real = evolution.staged
    monkeypatch.setattr(evolution, "staged", lambda df: rounds.append(1) or real(df))
    edges = spark.range(n).selectExpr("'r' AS repo_id", "cast(id AS string) AS src", "cast(id + 1 AS string) AS dst")
    got = evolution.reachable(edges, spark.createDataFrame([("r", "0")], "repo_id string, path string")).where("hops = cast(path AS int)")
    assert got.count() == n + 1 and len(rounds) < 70
