import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartolith.operators import catalog, checks, classify, evolution, extract, ignore, profile, pyramid, textgrid, tree, treemap, viewport
from cartolith.sources import corpus
from cartolith.sources.storage import staged

SOURCES = {
    "c/util.c": '#include <stdio.h>\n#include "util.h"\n\nstruct Pair {\n  int a;\n};\n\nenum Shade { DARK, PALE };\n\nint sum(int a, int b) {\n  return a + b;\n}\n',
    "cpp/util.cpp": '#include <vector>\n#include "box.h"\n\nnamespace ui {\n\nclass Box {\npublic:\n  void show();\n};\n\nvoid Box::show() {}\n\nint twice(int n) {\n  return 2 * n;\n}\n\n}\n',
    "csharp/App.cs": "using System;\nusing System.Text.Json;\n\nnamespace Demo\n{\n    public class App\n    {\n        public int Add(int a, int b)\n        {\n            return a + b;\n        }\n    }\n\n    public interface IJob\n    {\n        void Go();\n    }\n\n    public enum State\n    {\n        On\n    }\n}\n",
    "go/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"strings"\n)\n\ntype Host struct {\n\tname string\n}\n\nfunc (h Host) Hi() string {\n\treturn "hi " + h.name\n}\n\nfunc main() {\n\tfmt.Println(strings.ToUpper("x"))\n}\n',
    "java/App.java": "package demo;\n\nimport java.util.List;\nimport java.util.Map;\n\npublic class App {\n  public int add(int a, int b) {\n    return a + b;\n  }\n}\n\ninterface Job {\n  void go();\n}\n\nenum State {\n  ON\n}\n",
    "js/app.js": 'import { open } from "fs";\nconst path = require("path");\n\nexport function hi(name) {\n  return "hi " + name + path.sep;\n}\n\nexport class Shop {\n  start() {\n    open("x", () => {});\n  }\n}\n',
    "php/app.php": "<?php\n\nuse App\\Models\\User;\nuse App\\Support\\Str;\n\nclass Shop\n{\n    public function go(): string\n    {\n        return \"ok\";\n    }\n}\n\ninterface Job\n{\n    public function run(): void;\n}\n\nfunction help(): int\n{\n    return 1;\n}\n",
    "py/mod.py": "import os\nfrom collections import deque\n\n\nclass Box:\n    def show(self):\n        return 1\n\n\ndef make():\n    return Box()\n",
    "ruby/app.rb": 'require "json"\nrequire_relative "helper"\n\nmodule Demo\n  class Box\n    def show\n      "w"\n    end\n  end\n\n  def self.make\n    Box.new\n  end\nend\n',
    "rust/lib.rs": "use std::collections::HashMap;\nuse std::fmt;\n\npub struct P {\n    x: i32,\n}\n\npub enum S {\n    A,\n}\n\npub trait Draw {\n    fn draw(&self);\n}\n\npub fn origin() -> P {\n    P { x: 0 }\n}\n\nconst MOST: i32 = 1;\n\nfn main() {\n    let _ = MOST;\n}\n",
    "ts/app.ts": 'import { z } from "zod";\n\nexport interface User {\n  id: string;\n}\n\nexport type Id = string;\n\nexport enum Role {\n  A,\n}\n\nexport class Repo {\n  find(): User | null {\n    return null;\n  }\n}\n\nexport function make(): Repo {\n  return new Repo();\n}\n',
    "tsx/view.tsx": 'import React from "react";\n\nexport interface Props {\n  title: string;\n}\n\nexport function View(props: Props) {\n  return <div>{props.title}</div>;\n}\n',
}
COUNTS = {"c/util.c": (3, 2), "cpp/util.cpp": (4, 2), "csharp/App.cs": (5, 2), "go/main.go": (3, 2), "java/App.java": (5, 2), "js/app.js": (3, 2), "php/app.php": (5, 2), "py/mod.py": (3, 2), "ruby/app.rb": (4, 2), "rust/lib.rs": (6, 2), "ts/app.ts": (6, 1), "tsx/view.tsx": (2, 1)}


def frame(spark, files):
    return spark.createDataFrame([("r", p, bytearray(t.encode() if isinstance(t, str) else t)) for p, t in files.items()], "repo_id string, path string, content binary")


@pytest.fixture(scope="module")
def polyglot(spark):
    return classify.classify(frame(spark, SOURCES)).cache()


def test_polyglot_counts(polyglot):
    symbols, imports = extract.symbols(polyglot).collect(), extract.imports(polyglot).collect()
    got = {p: (sum(s.path == p for s in symbols), sum(i.path == p for i in imports)) for p in SOURCES}
    assert got == COUNTS
    assert (sum(a for a, _ in got.values()), sum(b for _, b in got.values())) == (49, 22)
    one = next(s for s in symbols if s.path == "py/mod.py" and s.name == "Box")
    assert (one.kind, one.start_line, one.end_line) == ("class", 5, 7)
    assert {i.module for i in imports if i.path == "js/app.js"} == {"fs", "path"}
    summary = profile.index_summary(polyglot, extract.symbols(polyglot), extract.imports(polyglot), classify.excluded_paths(polyglot)).first()
    assert (summary.files, summary.parsed, summary.symbols, summary.imports, summary.excluded) == (12, 12, 49, 22, 0)


def test_spans_are_ordered_and_classed(spark, polyglot):
    spans = extract.one_per_start(extract.spans(polyglot))
    assert checks.bad_spans(spans, extract.source_text(polyglot)).count() == 0
    text = '# note\nx = "hello"\n'
    got = [(text[a : a + n], extract.CLASSES[k]) for a, n, k in extract.token_spans(text, "Python")]
    assert ("# note", "Comment") in got and ('"hello"', "String") in got
    assert [m for c, m, _ in extract.imports_of('import x from "./x"; const y = require("y"); notrequire("z");', "JavaScript") if c in (None, "require")] == ["./x", "y"]


def test_exclusions(spark):
    files = {"keep.rs": "fn a() {}", "src/app.ts": "x", "package-lock.json": "{}", "bundle.min.js": "x", "gen.rs": "// @generated by tool\n", "node_modules/dep/x.js": "x", "vendor/y.rb": "x", "dist/z.ts": "x", "third_party/w.c": "x"}
    rows = classify.classify(frame(spark, files))
    assert {r.path for r in classify.kept_files(rows).collect()} == {"keep.rs", "src/app.ts"}
    assert {(r.path, r.reason) for r in classify.excluded_paths(rows).collect()} == {("package-lock.json", "lockfile"), ("bundle.min.js", "minified"), ("gen.rs", "generated"), ("node_modules", "node_modules"), ("vendor", "vendor"), ("dist", "dist"), ("third_party", "third_party")}
    every = classify.classify(frame(spark, files), include_vendored=True)
    assert classify.kept_files(every).count() == 9 and classify.excluded_paths(every).count() == 0


def test_big_binary_and_broken_files(spark):
    rows = classify.classify(frame(spark, {"big.rs": b"a" * (2 * 1024 * 1024 + 16), "blob.rs": b"\0\1\2\3", "bad.rs": b"\xff\xfe x"}))
    got = {r.path: r for r in rows.collect()}
    assert got["big.rs"].is_oversize and got["big.rs"].lines == 0 and not got["big.rs"].parsed and len(got["big.rs"].hash) == 64
    assert got["blob.rs"].is_binary and not got["blob.rs"].parsed
    assert got["bad.rs"].lines == 1 and not got["bad.rs"].parsed
    flags = profile.scan_flags(rows).first()
    assert (flags.files, flags.skipped_binary, flags.skipped_oversize) == (1, 1, 1)


def test_queries_read_long_documents_whole(spark, tmp_path):
    from cartolith.plans import queries as plans

    # document 21 becomes a Python file without header or exclusion
    text = "import os\n" + "def f():\n    return 1\n" * 1000
    spark.createDataFrame([(21, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert 16_384 < len(text) < 2 * 1024 * 1024
    assert [tuple(r) for r in plans.symbols_count(spark, str(tmp_path)).collect()] == [("s", "function", 1000)]
    assert plans.imports_count(spark, str(tmp_path)).first().n == 1
    assert plans.token_histogram(spark, str(tmp_path)).agg(F.sum("n")).first()[0] > 4000
    assert plans.index_summary(spark, str(tmp_path)).first().parsed == 1


def test_ignore_rules(spark):
    files = frame(spark, {".gitignore": "build/\n*.log\n!keep.log\n/top.txt\n", "src/main.rs": "a", "build/out.js": "a", "a.log": "a", "keep.log": "a", "x/top.txt": "a", "top.txt": "a", "sub/.gitignore": "*.tmp\n", "sub/a.tmp": "a", "b.tmp": "a"})
    kept = {r.path for r in ignore.drop_ignored(files, ignore.ignore_rules(files)).collect()}
    assert kept == {".gitignore", "src/main.rs", "keep.log", "x/top.txt", "sub/.gitignore", "b.tmp"}


def test_scan_folder_and_index_tables(spark, tmp_path, polyglot):
    for p, t in {"a/x.rs": "fn a() {}\n", ".git/config": "x", ".hidden": "h"}.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    rows = corpus.scan_folder(spark, str(tmp_path / "repo"), "r")
    assert {(r.path, r.bytes) for r in rows.collect()} == {("a/x.rs", 10), (".hidden", 1)}
    files = tree.file_ids(polyglot.drop("content"))
    corpus.write_index({"files": files, "meta": corpus.meta_table(spark, {"a": "b"})}, str(tmp_path / "index"))
    assert corpus.read_files(spark, str(tmp_path / "index")).count() == 12
    assert corpus.read_table(spark, str(tmp_path / "index"), "edges", corpus.EDGES).count() == 0
    assert ("schema_version", "2") in {tuple(r) for r in corpus.read_table(spark, str(tmp_path / "index"), "meta").collect()}


@pytest.fixture(scope="module")
def layout(spark):
    """98 files in 8 directories below src, as in the published layout check."""
    langs = ["Rust", "TypeScript", "Python", "Go", "C"]
    rows = [("r", f"src/mod{d}/file{f}.rs", langs[(d + f) % 5], 20 * (n := 5 + (37 * d + 13 * f) % 400), n) for d in range(8) for f in range(12)]
    rows += [("r", "README.md", "Markdown", 400, 20), ("r", "build.rs", "Rust", 100, 8)]
    files = staged(tree.file_ids(spark.createDataFrame(rows, "repo_id string, path string, language string, bytes long, lines long")))
    nodes = staged(tree.tree_nodes(files))
    zoomed = staged(tree.node_zooms(nodes))
    placed = staged(treemap.lay_out(zoomed))
    return files, nodes, zoomed, placed, staged(pyramid.tiles(placed))


def test_layout_invariants(spark, layout, tmp_path):
    files, nodes, zoomed, placed, tiled = layout
    assert nodes.where("kind = 'dir'").count() == 9
    assert checks.not_once_at_max_zoom(tiled, files).count() == 0
    assert checks.area_error(placed).first().error < 1e-3
    layered = staged(pyramid.layers(tiled, nodes))
    assert checks.misaligned(tiled, layered.where("layer = 'lines'")).count() == 0
    assert checks.over_budget(tiled).count() == 0
    by_levels = staged(treemap.lay_out(zoomed, whole_nodes=0))
    cells = ["path", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h")]
    assert checks.differences(by_levels.select(*cells), placed.select(*cells)).count() == 0
    assert checks.fingerprint(tiled).collect() == checks.fingerprint(pyramid.tiles(treemap.lay_out(zoomed))).collect()
    frames = pyramid.build_tileset(files)
    frames.write(str(tmp_path))
    again = pyramid.TileSetFrames.open(spark, str(tmp_path))
    assert again.keys.count() == tiled.count() and pyramid.summary(again).first().files == 98
    assert {r.key for r in pyramid.manifest_layers(again.manifest).collect()} == {"language", "lines"}
    values = pyramid.aligned(tiled, layered.where("layer = 'lines'")).select(F.explode("features").alias("f")).where("f.value > 0").count()
    assert values >= 98  # each file is in one tile of the largest zoom at least


def test_zooms_against_recursion(layout):
    _, nodes, zoomed, *_ = layout
    rows = [r.asDict() for r in nodes.collect()]
    world = sum(r["weight"] for r in rows if r["parent_path"] == "")
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent_path"], []).append(r)
    natural = lambda w: 0 if world / (w * 512) <= 1 else min(24, math.ceil(0.5 * math.log2(world / (w * 512))))
    want: dict = {}

    def visit(parent, split):
        for r in below.get(parent, []):
            own = max(split, min(natural(k["weight"]) for k in below[r["path"]])) if r["kind"] == "dir" else split
            want[r["path"]] = (split, own)
            visit(r["path"], own)

    visit("", 0)
    assert {r.path: (r.appear_z, r.split_z) for r in zoomed.collect()} == want


@given(st.lists(st.floats(0.5, 1000), min_size=1, max_size=60), st.floats(1, 50), st.floats(1, 50))
@settings(max_examples=60, deadline=None)
def test_squarify_keeps_areas(areas, w, h):
    scale = w * h / sum(areas)
    cells = treemap.squarify([a * scale for a in areas], 0, 0, w, h)
    assert all(abs(c[2] * c[3] - a * scale) <= 1e-6 * w * h for a, c in zip(areas, cells))
    assert all(c[0] >= -1e-9 and c[1] >= -1e-9 and c[0] + c[2] <= w * (1 + 1e-6) and c[1] + c[3] <= h * (1 + 1e-6) for c in cells)


def by_the_book(areas, x, y, w, h):
    """The squarified treemap as its authors state it, by recursion: fill a row while its worst ratio doesn't grow."""

    def worst(row, side):
        s = sum(row)
        return max(max(side**2 * r / s**2, s**2 / (side**2 * r)) for r in row)

    if not areas:
        return []
    side, row = min(w, h), [areas[0]]
    while len(row) < len(areas) and worst([*row, areas[len(row)]], side) <= worst(row, side):
        row.append(areas[len(row)])
    thick = sum(row) / side
    ends = [sum(row[:k]) / thick for k in range(len(row) + 1)]
    if w <= h:
        cells, rest = [(x + a, y, b - a, thick) for a, b in zip(ends, ends[1:])], (x, y + thick, w, h - thick)
    else:
        cells, rest = [(x, y + a, thick, b - a) for a, b in zip(ends, ends[1:])], (x + thick, y, w - thick, h)
    return cells + by_the_book(areas[len(row) :], *rest)


@given(st.lists(st.integers(1, 500), min_size=1, max_size=25), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_squarify_by_the_book(areas, w, h):
    scale = w * h / sum(areas)
    areas = sorted((a * scale for a in areas), reverse=True)
    assert [tuple(round(v, 6) for v in c) for c in treemap.squarify(areas, 0, 0, w, h)] == [tuple(round(v, 6) for v in c) for c in by_the_book(areas, 0, 0, w, h)]


def test_layout_places_every_level(layout):
    """Each cell is where the book puts it in its parent's cell."""
    *_, placed, _ = layout
    rows = [r.asDict() for r in placed.collect()]
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent_path"], []).append(r)
    side = math.sqrt(sum(r["weight"] for r in below[""]))
    boxes = {"": (0.0, 0.0, side, side)} | {r["path"]: (r["x"], r["y"], r["w"], r["h"]) for r in rows}
    for parent, kids in below.items():
        kids = sorted(kids, key=lambda r: (-r["weight"], r["path"]))
        for r, cell in zip(kids, by_the_book([float(r["weight"]) for r in kids], *boxes[parent]), strict=True):
            assert all(abs(a - b) < 1e-6 for a, b in zip((r["x"], r["y"], r["w"], r["h"]), cell))


def test_squarify_single_cell():
    assert treemap.squarify([20.0], 2, 3, 4, 5) == [(2, 3, 4.0, 5.0)]


def test_runs_spans_and_classes(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "a b"), (3, "\tx")], "doc_id long, content string")
    chars = textgrid.characters(textgrid.lines_in_window(texts))
    assert chars.where("doc_id = 3").first().col == 4
    spans = spark.createDataFrame([(1, 0, 2, 1), (2, 0, 3, 1)], "doc_id long, start long, len long, cls int")
    classed = textgrid.classed_at(chars.select("doc_id", F.col("pos").cast("long").alias("off")), spans)
    joined = chars.withColumn("off", F.col("pos").cast("long")).join(classed, ["doc_id", "off"])
    runs = {(r.doc_id, r.first_col, r.last_col, r.cls) for r in textgrid.runs(joined).where("doc_id < 3").collect()}
    assert runs == {(1, 0, 1, 1), (1, 2, 3, 0), (2, 0, 0, 1), (2, 2, 2, 1)}
    rows = spark.createDataFrame([(1, 0, 2, 1), (1, 3, 4, 6), (1, 24, 1, 4)], "doc_id long, start long, len long, cls int")
    back = textgrid.span_starts(textgrid.span_deltas(rows).withColumnRenamed("start", "ord"), "ord")
    assert sorted((r.ord, r.start) for r in back.collect()) == [(0, 0), (3, 3), (24, 24)]


def test_viewport(spark):
    keys = spark.createDataFrame([("r", 0, 0, 0), ("r", 1, 0, 0), ("r", 1, 1, 0), ("r", 2, 1, 3)], "repo_id string, z int, x long, y long")
    assert {(r.z, r.x, r.y): r.has_children for r in viewport.has_children(keys).collect()} == {(0, 0, 0): True, (1, 0, 0): False, (1, 1, 0): False, (2, 1, 3): False}
    sides = spark.createDataFrame([("r", 100.0)], "repo_id string, side double")
    plane = "array(struct({} as a, 0.0D as b, 0.0D as c, {} as d))"
    cams = spark.sql(f"""SELECT 'near' AS camera_id, 'r' AS repo_id, {plane.format("-1.0D", "40.0D")} AS planes, struct(25.0D AS x, 25.0D AS y, 20.0D AS z) AS eye, 1000.0D AS viewport_h, 1000.0D AS px_per_world, 1.0D AS max_height
        UNION ALL SELECT 'far', 'r', {plane.format("1.0D", "1000.0D")}, struct(50.0D AS x, 50.0D AS y, 9000.0D AS z), 1000.0D, 1000.0D, 1.0D
        UNION ALL SELECT 'off', 'r', {plane.format("1.0D", "-1000.0D")}, struct(0.0D AS x, 0.0D AS y, 10.0D AS z), 1000.0D, 1000.0D, 1.0D""")
    got = {(r.camera_id, r.z, r.x, r.y) for r in viewport.select_tiles(cams, keys, sides).collect()}
    assert got == {("near", 1, 0, 0), ("far", 0, 0, 0), ("off", 0, 0, 0)}
    wanted = spark.createDataFrame([(1, 3, 4, 4), (2, 1, 1, 1)], "qid long, z int, x long, y long")
    there = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "z int, x long, y long")
    assert {tuple(r) for r in viewport.nearest_available(wanted, there).collect()} == {(1, 2, 2, 2), (2, 1, 1, 1)}


def test_catalog(spark):
    jobs = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2024-01-01', 'QUEUED'), (2, 1, timestamp'2024-01-02', 'RUNNING'), (3, 2, timestamp'2024-01-03', 'FAILED') AS t(job_id, repo_id, created_at, status)")
    assert {r.job_id for r in catalog.latest(jobs, "repo_id").collect()} == {2, 3}
    asked = spark.sql("SELECT * FROM VALUES (1, 10), (2, 11), (2, 12) AS t(repo_id, new_id)")
    assert {tuple(r) for r in catalog.enqueue(asked, jobs).collect()} == {(1, 1, False), (2, 11, True)}
    assert [r.ms for r in catalog.stage_durations(jobs).where("repo_id = 1").orderBy("job_id").collect()] == [86_400_000, None]
    assert catalog.oldest_queued(jobs).first().job_id == 1
    assert catalog.timings(jobs).where("repo_id = 1").first().timings_ms == {"QUEUED": 86_400_000}
    assert catalog.upsert(jobs, jobs.withColumn("status", F.lit("x")), "job_id").where("status = 'x'").count() == 0
    ranks = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)], "g string, v double")
    row = profile.nearest_rank(ranks, "g", "v").first()
    assert (row.p50, row.p95, row.p99, row.max, row.n) == (3.0, 5.0, 5.0, 5.0, 5)


def test_evolution(spark):
    commits = spark.sql("SELECT * FROM VALUES ('r', 'a', 'c1', 'ann', date'2024-01-01', 3, 1, 'x'), ('r', 'a', 'c2', 'ann', date'2024-01-05', 1, 0, 'x\nCo-authored-by: b') AS t(repo_id, path, commit, author, at, added, deleted, message)")
    assert tuple(evolution.churn(commits).first())[2:] == (2, 5)
    assert evolution.agent_share(commits).first().agent == 0.5 and len(evolution.owner(commits).first().owner) == 64
    files = spark.createDataFrame([("r", 1, "src/a.ts"), ("r", 2, "src/b.ts"), ("r", 3, "lib/util.py")], "repo_id string, file_id long, path string")
    imports = spark.createDataFrame([("r", "src/a.ts", "./b"), ("r", "src/b.ts", "util")], "repo_id string, path string, module string")
    edges = evolution.resolve_imports(imports, files)
    assert {(r.src, r.dst, r.confidence) for r in edges.collect()} == {("src/a.ts", "src/b.ts", "exact"), ("src/b.ts", "lib/util.py", "heuristic")}
    start = spark.createDataFrame([("r", "src/a.ts")], "repo_id string, path string")
    assert {(r.path, r.hops) for r in evolution.reachable(edges, start).collect()} == {("src/a.ts", 0), ("src/b.ts", 1), ("lib/util.py", 2)}


def test_listing_and_database(spark, tmp_path):
    (tmp_path / "repo" / "x").mkdir(parents=True)
    (tmp_path / "repo" / "x" / "b.txt").write_text("four")
    (tmp_path / "repo" / "a.txt").write_text("sixsix")
    (tmp_path / "repo" / "link.txt").symlink_to(tmp_path / "repo" / "a.txt")
    rows = corpus.listing(spark, str(tmp_path / "repo"))
    paths = [r.path for r in rows.collect()]
    assert paths == ["a.txt", "x/b.txt"]
    assert corpus.total_size(rows).first().bytes == 10
    url = f"jdbc:derby:{tmp_path / 'catalog'};create=true"
    jobs = spark.sql("SELECT 1L AS job_id, 'QUEUED' AS status UNION ALL SELECT 2L, 'FAILED'")
    corpus.write_jdbc(jobs, url, "jobs")
    assert sorted(tuple(r) for r in corpus.read_jdbc(spark, url, "jobs").collect()) == [(1, "QUEUED"), (2, "FAILED")]


def test_versions_and_formats(spark):
    rank = [r[0] for r in spark.createDataFrame([(v,) for v in ("1.10", "1.2.0-rc1", "1.2.0", "1.2.0-alpha", "1.9.3", "1.2.1")], "v string").orderBy(evolution.version_key(F.col("v"))).collect()]
    assert rank == ["1.2.0-alpha", "1.2.0-rc1", "1.2.0", "1.2.1", "1.9.3", "1.10"]
    with pytest.raises(Exception, match="format version 1"):
        pyramid.read_manifest(spark.createDataFrame([("r", '{"formatVersion": 1}')], "repo_id string, manifest string")).select("m.formatVersion").collect()
    edges = spark.createDataFrame([("r", "a/x", "b/y")] * 2 + [("r", "a/z", "b/y")], "repo_id string, src_path string, dst_path string")
    cut = spark.createDataFrame([("r", 0, 1, "a"), ("r", 0, 2, "b")], "repo_id string, z int, id long, path string")
    assert [tuple(r) for r in evolution.bundle_edges(edges, cut).collect()] == [("r", 0, 1, 2, 3)]


def test_adding_a_layer_leaves_geometry(spark, layout, tmp_path):
    files, nodes, _, _, tiled = layout
    frames = pyramid.build_tileset(files)
    frames.write(str(tmp_path / "set"))
    before = checks.fingerprint(corpus.read_table(spark, str(tmp_path / "set"), "tiles")).collect()
    more = frames.layers.where("layer = 'lines'").withColumn("layer", F.lit("churn"))
    more.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z").parquet(str(tmp_path / "set" / "layers"))
    again = pyramid.TileSetFrames.open(spark, str(tmp_path / "set"))
    assert {r.layer for r in again.layers.select("layer").distinct().collect()} == {"churn", "language", "lines"}
    assert checks.fingerprint(again.tiles).collect() == before
