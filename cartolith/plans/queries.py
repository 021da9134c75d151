"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.functions import columns as c
from cartolith.functions import tables as t
from cartolith.operators import catalog, checks, classify, evolution, extract, profile, pyramid, textgrid, tree, treemap, viewport
from cartolith.sources import corpus
from cartolith.sources.storage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(spark: SparkSession, sf_dir: str, max_bytes: int = t.MAX_FILE_BYTES) -> DataFrame:
    return classify.classify(corpus.corpus_files(_table(spark, sf_dir, "documents")), max_bytes=max_bytes)


def _files(spark: SparkSession, sf_dir: str, max_bytes: int = t.MAX_FILE_BYTES) -> DataFrame:
    return classify.kept_files(_classified(spark, sf_dir, max_bytes))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids read the files twice; what is staged is read, not classified, again
    return staged(tree.file_ids(staged(_files(spark, sf_dir).select("repo_id", "path", "language", "lines", "bytes"))))


def _nodes(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    return staged(tree.tree_nodes(files or _indexed(spark, sf_dir)))


def _zoomed(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    return staged(tree.node_zooms(_nodes(spark, sf_dir, files)))


def _placed(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    return staged(treemap.lay_out(_zoomed(spark, sf_dir, files)))


# SQL of the same steps


def _case(key: str, values: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_DIRS = "[" + ", ".join(f"CASE WHEN list_contains(dirs, '{d}') THEN list_position(dirs, '{d}') END" for d in t.EXCLUDED_DIRS) + "]"
CLASSIFIED = (
    corpus.CORPUS_SQL
    + f""",
named AS (SELECT *, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name, regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS ext,
  strlen(content) AS bytes FROM corpus),
langs AS (SELECT *, p[1:len(p) - 1] AS dirs, coalesce({_case("name", t.LANGUAGE_BY_NAME)}, {_case("lower(ext)", t.LANGUAGE_BY_EXTENSION)}, 'Other') AS language,
  bytes > {t.MAX_FILE_BYTES} AS is_oversize, false AS is_binary FROM named),
hits AS (SELECT *, list_min(list_filter({_DIRS}, lambda x: x IS NOT NULL)) AS hit,
  CASE WHEN language = 'TypeScript' AND ext = 'tsx' THEN 'TSX' WHEN language IN ({", ".join(repr(g) for g in t.GRAMMARS)}) THEN language END AS grammar,
  array_to_string(string_split(substring(content, 1, {t.HEADER_BYTES}), chr(10))[1:{t.HEADER_LINES}], chr(10)) AS head FROM langs),
reasons AS (SELECT *, CASE WHEN hit IS NOT NULL THEN array_to_string(p[1:hit], '/') END AS excluded_path,
  CASE WHEN hit IS NOT NULL THEN p[hit] WHEN name IN ({", ".join(repr(x) for x in t.LOCKFILES)}) THEN 'lockfile'
  WHEN {" OR ".join(f"suffix(name, '{s}')" for s in t.MINIFIED_SUFFIXES)} THEN 'minified'
  WHEN NOT is_oversize AND ({" OR ".join(f"contains(head, '{m}')" for m in t.GENERATED_MARKERS)}) THEN 'generated' END AS reason FROM hits),
classified AS (SELECT repo_id, doc_id, path, content, language, grammar, bytes, is_oversize, is_binary, excluded_path, reason, p,
  CASE WHEN excluded_path IS NOT NULL THEN 'pruned' WHEN reason IS NOT NULL THEN 'excluded' ELSE 'file' END AS outcome,
  CASE WHEN is_oversize OR content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN suffix(content, chr(10)) THEN 0 ELSE 1 END END::bigint AS lines,
  NOT is_oversize AND grammar IS NOT NULL AS parsed FROM reasons)"""
)
FILES = CLASSIFIED + ",\nfiles AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY p) AS file_id FROM classified WHERE outcome = 'file')"
DIRS = (
    FILES
    + """,
up AS (SELECT repo_id, path, language, lines, bytes, greatest(lines, 1) AS w, p, unnest(range(0, len(p))) AS depth FROM files),
ups AS (SELECT *, coalesce(array_to_string(p[1:depth], '/'), '') AS dir FROM up),
dirs AS (SELECT repo_id, dir, max(depth)::int AS depth, count(*) AS files, sum(lines)::bigint AS lines, sum(bytes)::bigint AS bytes, sum(w)::bigint AS weight,
  min(path) AS min_file_path FROM ups GROUP BY repo_id, dir),
dominant AS (SELECT repo_id, dir, language FROM (SELECT repo_id, dir, language, row_number() OVER (PARTITION BY repo_id, dir ORDER BY sum(w) DESC, language) AS r
  FROM ups GROUP BY repo_id, dir, language) WHERE r = 1)"""
)
NODES = (
    DIRS
    + """,
most AS (SELECT repo_id, max(file_id) AS most FROM files GROUP BY repo_id),
ndirs AS (SELECT d.repo_id, most + row_number() OVER (PARTITION BY d.repo_id ORDER BY min_file_path, depth) AS id, 'dir' AS kind, dir AS path, depth, lines, bytes,
  weight, language, min_file_path FROM dirs d JOIN dominant USING (repo_id, dir) JOIN most USING (repo_id) WHERE dir <> ''),
both_kinds AS (SELECT * FROM ndirs UNION ALL SELECT repo_id, file_id, 'file', path, len(p)::int, lines, bytes, greatest(lines, 1), language, path FROM files),
pnodes AS (SELECT *, coalesce(array_to_string(string_split(path, '/')[1:depth - 1], '/'), '') AS parent_path FROM both_kinds),
nodes AS (SELECT n.*, coalesce(d.id, 0) AS parent_id FROM pnodes n LEFT JOIN ndirs d ON n.repo_id = d.repo_id AND n.parent_path = d.path)"""
)
_POWERS = " + ".join(f"(weight * {512 * 4**k}::double < world)::int" for k in range(24))
ZOOMS = (
    NODES
    + f""",
worlds AS (SELECT repo_id, greatest(sum(weight), 1)::double AS world FROM nodes WHERE parent_path = '' GROUP BY repo_id),
least_z AS (SELECT repo_id, parent_path, min({_POWERS}) AS m FROM nodes JOIN worlds USING (repo_id) WHERE parent_path <> '' GROUP BY repo_id, parent_path),
upd AS (SELECT repo_id, path, unnest(range(1, depth + 1)) AS k FROM nodes WHERE kind = 'dir'),
splits AS (SELECT u.repo_id, u.path, max(m) AS split_z FROM upd u JOIN least_z l ON u.repo_id = l.repo_id AND array_to_string(string_split(u.path, '/')[1:k], '/') = l.parent_path GROUP BY u.repo_id, u.path),
zoomed AS (SELECT n.*, coalesce(s.split_z, 0) AS appear_z, coalesce(o.split_z, s.split_z, 0) AS split_z FROM nodes n
  LEFT JOIN splits s ON n.repo_id = s.repo_id AND n.parent_path = s.path LEFT JOIN splits o ON n.repo_id = o.repo_id AND n.path = o.path AND n.kind = 'dir'),
maxz AS (SELECT repo_id, least(max(appear_z), 24) AS max_z FROM zoomed GROUP BY repo_id),
cut AS (SELECT repo_id, id, kind, path, weight, unnest(range(appear_z, CASE WHEN kind = 'file' THEN max_z ELSE least(split_z - 1, max_z) END + 1)) AS z
  FROM zoomed JOIN maxz USING (repo_id))"""
)


# corpus profile


@query(CLASSIFIED + " SELECT language, count(*) AS files, sum(lines)::bigint AS lines, sum(bytes)::bigint AS bytes FROM classified WHERE outcome = 'file' GROUP BY language")
def language_profile(spark, sf_dir):
    return profile.language_profile(_files(spark, sf_dir))


@query(CLASSIFIED + " SELECT CASE WHEN grouping(language) = 1 THEN 'total' ELSE language END AS language, count(*) AS files, sum(lines)::bigint AS lines, sum(bytes)::bigint AS bytes FROM classified WHERE outcome = 'file' GROUP BY ROLLUP (language)")
def language_rollup(spark, sf_dir):
    return profile.language_rollup(_files(spark, sf_dir))


@query(CLASSIFIED + " SELECT repo_id, path, language, grammar, bytes, lines, sha256(content) AS hash, is_binary, is_oversize, parsed, outcome, reason FROM classified")
def classify_files(spark, sf_dir):
    return _classified(spark, sf_dir).select("repo_id", "path", "language", "grammar", "bytes", "lines", "hash", "is_binary", "is_oversize", "parsed", "outcome", "reason")


@query(CLASSIFIED + " SELECT repo_id, path, reason FROM classified WHERE outcome = 'excluded' UNION SELECT repo_id, excluded_path, reason FROM classified WHERE outcome = 'pruned'")
def excluded_paths(spark, sf_dir):
    return classify.excluded_paths(_classified(spark, sf_dir))


@query(CLASSIFIED + " SELECT count(*) FILTER (NOT is_oversize) AS files, sum(lines) FILTER (NOT is_oversize)::bigint AS lines, sum(bytes) FILTER (NOT is_oversize)::bigint AS bytes, count(*) FILTER (is_binary) AS skipped_binary, count(*) FILTER (is_oversize) AS skipped_oversize FROM classified")
def scan_flags(spark, sf_dir):
    return profile.scan_flags(_classified(spark, sf_dir))


@query(FILES + " SELECT repo_id, path, language, grammar, bytes, lines FROM files f WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.outcome = 'excluded' AND c.repo_id = f.repo_id AND c.path = f.path)")
def not_excluded(spark, sf_dir):
    every = staged(_classified(spark, sf_dir).drop("content", "hash"))
    rows = every.where("outcome <> 'pruned'").select("repo_id", "path", "language", "grammar", "bytes", "lines")
    return rows.join(classify.excluded_paths(every), ["repo_id", "path"], "left_anti")


OVERSIZE = 16_384


@query(CLASSIFIED.replace(f"bytes > {t.MAX_FILE_BYTES} AS is_oversize", f"bytes > {OVERSIZE} AS is_oversize") + " SELECT repo_id, path, bytes, lines, is_oversize, parsed, outcome FROM classified")
def oversize_rule(spark, sf_dir):
    """The same rules with a limit that some texts exceed."""
    return _classified(spark, sf_dir, OVERSIZE).select("repo_id", "path", "bytes", "lines", "is_oversize", "parsed", "outcome")


@query(CLASSIFIED + f" SELECT repo_id, path, bytes + (CASE WHEN bytes % 5 = 0 THEN 1 ELSE 0 END) AS bytes, bytes % 5 = 0 AND bytes < {t.SNIFF_BYTES} AS is_binary, CASE WHEN bytes % 5 = 0 AND bytes < {t.SNIFF_BYTES} THEN 0 ELSE lines + CASE WHEN bytes % 5 = 0 AND suffix(content, chr(10)) THEN 1 ELSE 0 END END AS lines, parsed AND NOT (bytes % 5 = 0 AND bytes < {t.SNIFF_BYTES}) AS parsed FROM classified")
def binary_rule(spark, sf_dir):
    """Texts with a NUL byte behind every fifth one: the first look doesn't see it in long ones."""
    files = corpus.corpus_files(_table(spark, sf_dir, "documents"))
    nul = F.when(F.octet_length("content") % 5 == 0, F.concat(F.col("content"), F.lit("\0"))).otherwise(F.col("content"))
    rows = classify.classify(files.withColumn("content", F.encode(nul, "UTF-8")))
    return rows.select("repo_id", "path", "bytes", "is_binary", "lines", "parsed")


# tree


@query(FILES + " SELECT repo_id, path, file_id FROM files")
def file_ids(spark, sf_dir):
    return _indexed(spark, sf_dir).select("repo_id", "path", "file_id")


@query(NODES + " SELECT repo_id, id AS dir_id, path FROM nodes WHERE kind = 'dir'")
def dir_ids(spark, sf_dir):
    return _nodes(spark, sf_dir).where("kind = 'dir'").select("repo_id", F.col("id").alias("dir_id"), "path")


@query(NODES + " SELECT repo_id, id, kind, path, parent_path, parent_id, depth, lines, bytes, weight, language FROM nodes")
def tree_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("repo_id", "id", "kind", "path", "parent_path", "parent_id", "depth", "lines", "bytes", "weight", "language")


@query(DIRS + " SELECT * FROM dirs")
def dir_rollup(spark, sf_dir):
    return tree.dir_rollup(_files(spark, sf_dir))


@query(DIRS + " SELECT * FROM dominant")
def dominant_language(spark, sf_dir):
    return tree.dominant_language(_files(spark, sf_dir))


@query(DIRS + " SELECT repo_id, dir, path FROM ups")
def ancestor_closure(spark, sf_dir):
    return tree.closure(_files(spark, sf_dir).select("repo_id", "path")).select("repo_id", "dir", "path")


@query(NODES + " SELECT repo_id, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS directories, coalesce(sum(lines) FILTER (kind = 'file'), 0)::bigint AS lines, coalesce(sum(bytes) FILTER (kind = 'file'), 0)::bigint AS bytes, count(DISTINCT language) FILTER (kind = 'file') AS languages FROM nodes GROUP BY repo_id")
def repo_stats(spark, sf_dir):
    return profile.repo_stats(_nodes(spark, sf_dir))


@query(FILES + " SELECT repo_id, min(lines) AS min_lines, max(lines) AS max_lines FROM files GROUP BY repo_id")
def layer_range(spark, sf_dir):
    return profile.layer_range(_files(spark, sf_dir))


@query(NODES + " SELECT repo_id, (row_number() OVER (PARTITION BY repo_id ORDER BY language) - 1)::int AS idx, language FROM (SELECT DISTINCT repo_id, language FROM nodes)")
def category_index(spark, sf_dir):
    return tree.category_index(_nodes(spark, sf_dir))


_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(language, ''), lambda ch: ascii(ch)::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_COLOR = f"""
hue AS (SELECT language, ({_FNV} % 360)::double / 60 AS h FROM (SELECT DISTINCT language FROM nodes)),
cx AS (SELECT *, (1 - abs(2 * 0.6::double - 1)) * 0.55::double AS c FROM hue),
parts AS (SELECT *, c * (1 - abs((h - 2 * floor(h / 2)) - 1)) AS x, 0.6::double - c / 2 AS m, floor(h) AS s FROM cx),
rgb AS (SELECT language, m, CASE s WHEN 0 THEN c WHEN 1 THEN x WHEN 4 THEN x WHEN 5 THEN c ELSE 0 END AS r, CASE s WHEN 0 THEN x WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN x ELSE 0 END AS g,
  CASE s WHEN 2 THEN x WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN x ELSE 0 END AS b FROM parts)
SELECT language, coalesce({_case("language", t.COLORS)}, printf('#%02x%02x%02x', round((r + m) * 255)::int, round((g + m) * 255)::int, round((b + m) * 255)::int)) AS color FROM rgb"""


@query(NODES + "," + _COLOR)
def language_color(spark, sf_dir):
    return _nodes(spark, sf_dir).select("language").distinct().withColumn("color", c.color(F.col("language")))


@query(FILES + " SELECT repo_id, file_id, least(lines, 4294967295) AS lines, least(bytes, 4294967295) AS bytes, path FROM files")
def path_index(spark, sf_dir):
    return pyramid.path_index(_indexed(spark, sf_dir))


@query(ZOOMS + " SELECT repo_id, path, appear_z, split_z FROM zoomed")
def node_zooms(spark, sf_dir):
    return tree.node_zooms(_nodes(spark, sf_dir)).select("repo_id", "path", "appear_z", "split_z")


@query(ZOOMS + " SELECT repo_id, path, z::int AS z FROM cut")
def visible_cut(spark, sf_dir):
    return tree.visible_cut(_zoomed(spark, sf_dir)).select("repo_id", "path", "z")


@query(ZOOMS + " SELECT repo_id, z::int AS z, sum(weight)::bigint AS weight FROM cut GROUP BY repo_id, z")
def zoom_partition_check(spark, sf_dir):
    """At every zoom the visible weights sum to the world's."""
    return tree.visible_cut(_zoomed(spark, sf_dir)).groupBy("repo_id", "z").agg(F.sum("weight").alias("weight"))


@query(NODES + " SELECT repo_id, path, round(weight::double, 3) AS area FROM nodes")
def treemap_area(spark, sf_dir):
    """Every cell's area is its weight."""
    return treemap.lay_out(_nodes(spark, sf_dir)).select("repo_id", "path", F.round(F.col("w") * F.col("h"), 3).alias("area"))


# tiles


@query(ZOOMS + " SELECT repo_id, z::int AS z, count(*) AS features FROM cut GROUP BY repo_id, z")
def tile_features(spark, sf_dir):
    """Features over all tiles of a zoom: each visible node is in one tile."""
    return pyramid.tiles(_placed(spark, sf_dir)).groupBy("repo_id", "z").agg(F.sum(F.size("features")).cast("long").alias("features"))


@query()
def tile_counts(spark, sf_dir):
    return pyramid.tiles(_placed(spark, sf_dir)).select("repo_id", "z", "tx", "ty", F.size("features").alias("features"))


@query()
def tile_layers(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    tiled = staged(pyramid.tiles(placed))
    return pyramid.layers(tiled, placed).select("layer", "repo_id", "z", "tx", "ty", F.size("values").alias("n"), F.array_max("values").alias("most"))


@query(ZOOMS + " SELECT 'lines' AS layer, repo_id, z::int AS z, count(*) AS n FROM cut GROUP BY repo_id, z UNION ALL SELECT 'language', repo_id, z::int, count(*) FROM cut GROUP BY repo_id, z")
def layer_alignment(spark, sf_dir):
    """Values by layer and zoom: as many as features."""
    tiled = staged(pyramid.tiles(_placed(spark, sf_dir)))
    return pyramid.layers(tiled, tiled.select("repo_id", F.explode("features.language").alias("language")).distinct()).groupBy("layer", "repo_id", "z").agg(F.sum(F.size("values")).cast("long").alias("n"))


@query(NODES + " SELECT repo_id, 2 AS format_version, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS directories, count(DISTINCT language) AS categories, true AS no_edges FROM nodes GROUP BY repo_id")
def manifest_summary(spark, sf_dir):
    files = _indexed(spark, sf_dir)
    nodes = _nodes(spark, sf_dir, files)
    m = pyramid.read_manifest(pyramid.manifest(nodes, files, staged(tree.node_zooms(nodes))))
    cats = F.size(F.element_at("m.layers", 1)["categories"]).cast("long")
    return m.select("repo_id", F.col("m.formatVersion").alias("format_version"), "m.stats.files", "m.stats.directories", cats.alias("categories"), (~F.col("m.hasEdges")).alias("no_edges"))


@query()
def viewport_tiles(spark, sf_dir):
    """Eight fixed boxes of the world as cameras of every repository."""
    files = _indexed(spark, sf_dir)
    keys = staged(pyramid.tile_keys(pyramid.tiles(_placed(spark, sf_dir, files))))
    box = lambda f: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(0.0).alias("c"), d.alias("d")) for a, b, d in f])
    worlds = tree.world(files)
    cams = worlds.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    lo = F.col("k") * F.col("side") / 16
    cams = cams.select(
        F.concat_ws(":", "repo_id", "k").alias("camera_id"), "repo_id", box([(1.0, 0.0, -lo), (-1.0, 0.0, lo + F.col("side") / 2), (0.0, 1.0, -lo), (0.0, -1.0, lo + F.col("side") / 2)]).alias("planes"),
        F.struct((lo + F.col("side") / 4).alias("x"), (lo + F.col("side") / 4).alias("y"), (F.col("side") / (F.col("k") + 1)).alias("z")).alias("eye"),
        F.lit(1000.0).alias("viewport_h"), F.lit(1000.0).alias("px_per_world"), F.lit(1.0).alias("max_height"),
    )
    return viewport.select_tiles(cams, keys, worlds)


@query()
def readable_roofs(spark, sf_dir):
    return viewport.readable(viewport.roofs(_placed(spark, sf_dir)), px_per_world=40.0, aim_line=600).select("repo_id", "file_id", "tier", "first_line")


_WANTED = """WITH wanted AS (SELECT doc_id AS qid, (doc_id % 6 + 2)::int AS z, (doc_id * 7919) % (1 << (doc_id % 6 + 2)::int) AS x, (doc_id * 104729) % (1 << (doc_id % 6 + 2)::int) AS y FROM documents),
available AS (SELECT DISTINCT (z // 2)::int AS z, x >> (z - z // 2) AS x, y >> (z - z // 2) AS y FROM wanted WHERE qid % 3 = 0)"""


def _wanted(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    wanted = docs.select(F.col("doc_id").alias("qid"), F.expr("cast(doc_id % 6 + 2 as int)").alias("z")).withColumns({"x": F.expr("(qid * 7919) % shiftleft(1L, z)"), "y": F.expr("(qid * 104729) % shiftleft(1L, z)")})
    available = wanted.where("qid % 3 = 0").selectExpr("cast(z div 2 as int) AS z", "shiftright(x, cast(z - z div 2 as int)) AS x", "shiftright(y, cast(z - z div 2 as int)) AS y").distinct()
    return wanted, available


@query(_WANTED + """, up AS (SELECT qid, (z - k)::int AS z, x >> k AS x, y >> k AS y FROM (SELECT *, unnest(range(0, z + 1))::int AS k FROM wanted))
SELECT qid, z, x, y FROM (SELECT u.*, row_number() OVER (PARTITION BY qid ORDER BY u.z DESC) AS r FROM up u JOIN available a ON u.z = a.z AND u.x = a.x AND u.y = a.y) WHERE r = 1""")
def ancestor_fallback(spark, sf_dir):
    return viewport.nearest_available(*_wanted(spark, sf_dir))


@query(_WANTED + ", keys AS (SELECT DISTINCT z, x, y FROM wanted) SELECT k.z, k.x, k.y, EXISTS (SELECT 1 FROM keys c WHERE c.z = k.z + 1 AND c.x >> 1 = k.x AND c.y >> 1 = k.y) AS has_children FROM keys k")
def tile_children(spark, sf_dir):
    keys = _wanted(spark, sf_dir)[0].select("z", "x", "y").distinct().withColumn("repo_id", F.lit("r"))
    return viewport.has_children(keys).select("z", "x", "y", "has_children")


@query(_WANTED + " SELECT DISTINCT w.z, w.x, w.y, w.z AS priority FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM available a WHERE a.z = w.z AND a.x = w.x AND a.y = w.y) AND NOT EXISTS (SELECT 1 FROM wanted r WHERE r.qid % 7 = 0 AND r.z = w.z AND r.x = w.x AND r.y = w.y)")
def tiles_to_request(spark, sf_dir):
    wanted, available = _wanted(spark, sf_dir)
    return viewport.to_request(wanted, available, wanted.where("qid % 7 = 0").select("z", "x", "y").distinct())


# text


@query("""WITH l AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS lines FROM documents)
SELECT doc_id, greatest(coalesce(list_max(list_transform(lines, lambda x: least(length(x), 120))), 1), 1)::int AS cols, greatest(len(lines), 1)::int AS lines FROM l""")
def text_grid(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", c.text_grid(F.col("text")).alias("g"))
    return docs.select("doc_id", "g.cols", "g.lines")


_CLASSED = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
ch AS (SELECT doc_id, line::int AS line, unnest(string_split(line_text, '')) AS ch, unnest(range(0, len(string_split(line_text, ''))))::int AS col FROM l WHERE line_text <> ''),
classed AS (SELECT doc_id, line, col, CASE WHEN ch BETWEEN '0' AND '9' THEN 2 WHEN contains('.,;:!?', ch) THEN 3 ELSE 1 END AS cls FROM ch WHERE col < 120 AND ch NOT IN (' ', chr(9), chr(13)))"""


def _char_class():
    return F.when(F.col("ch").between("0", "9"), 2).when(F.instr(F.lit(".,;:!?"), F.col("ch")) > 0, 3).otherwise(1)


@query(_CLASSED + """, m AS (SELECT *, CASE WHEN lag(cls) OVER w = cls AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS new FROM classed WINDOW w AS (PARTITION BY doc_id, line ORDER BY col)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line ORDER BY col) AS run FROM m)
SELECT doc_id, line, cls, min(col) AS first_col, max(col) AS last_col FROM n GROUP BY doc_id, line, run, cls""")
def text_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return textgrid.runs(textgrid.characters(textgrid.lines_in_window(docs)).withColumn("cls", _char_class()))


# the words between single spaces, with their class: 1 letters, 2 digits, 3 anything else first
_SPANS = """words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS k FROM documents),
placed AS (SELECT doc_id, k, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1)::bigint AS start FROM words),
sp AS (SELECT doc_id, k, start, length(w)::bigint AS len, CASE WHEN w[1] BETWEEN '0' AND '9' THEN 2 WHEN regexp_matches(w, '^[A-Za-z]') THEN 1 ELSE 3 END AS cls FROM placed WHERE w <> '')"""


def _word_spans(spark, sf_dir):
    words = F.split("text", " ")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("k", "w"))
    before = W.partitionBy("doc_id").orderBy("k")
    rows = rows.withColumn("start", F.sum(F.length("w") + 1).over(before) - F.length("w") - 1).where("w <> ''")
    cls = F.when(F.substring("w", 1, 1).between("0", "9"), 2).when(F.col("w").rlike("^[A-Za-z]"), 1).otherwise(3)
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "start", F.length("w").cast("long").alias("len"), cls.alias("cls"))


@query(f"WITH {_SPANS} SELECT doc_id, k, start - coalesce(lag(start + len) OVER (PARTITION BY doc_id ORDER BY start), 0) AS gap, start AS again FROM sp")
def span_delta(spark, sf_dir):
    """Gaps between the words of every text, and the starts that they give back."""
    deltas = textgrid.span_deltas(_word_spans(spark, sf_dir)).select("doc_id", "k", "gap", "len")
    return textgrid.span_starts(deltas, "k").select("doc_id", "k", "gap", F.col("start").alias("again"))


@query(f"WITH {_SPANS}, off AS (SELECT doc_id, unnest(range(0, length(text), 7)) AS off FROM documents) SELECT o.doc_id, o.off, coalesce(s.cls, 0) AS cls FROM off o LEFT JOIN sp s ON o.doc_id = s.doc_id AND o.off >= s.start AND o.off < s.start + s.len")
def token_class_lookup(spark, sf_dir):
    """The class at every seventh character of every text."""
    docs = _table(spark, sf_dir, "documents").where(F.length("text") > 0)
    docs = docs.select("doc_id", F.split("text", " ").alias("words"), F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(7).cast("long")).alias("offs"))
    cls = lambda w: F.when(F.substring(w, 1, 1).between("0", "9"), 2).when(w.rlike("^[A-Za-z]"), 1).otherwise(3)
    lists = {"gaps": lambda w, i: F.when(i > 0, 1).otherwise(0), "lens": lambda w: F.length(w), "classes": cls}
    return textgrid.classed_in_lists(docs.select("doc_id", "offs", *[F.transform("words", f).alias(name) for name, f in lists.items()]))


@query("SELECT l.doc_id, line, first FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents) l, (SELECT greatest(k * 512 - 256, 0) AS first FROM range(0, 400) r(k)) w WHERE line >= first AND line < first + 1024")
def line_windows(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", F.col("line").cast("long").alias("line"))
    return textgrid.windows_of_lines(lines)


# extraction


@query()
def symbols_count(spark, sf_dir):
    return extract.symbols(_files(spark, sf_dir)).groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def imports_count(spark, sf_dir):
    return extract.imports(_files(spark, sf_dir)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("module").alias("modules"))


@query()
def token_histogram(spark, sf_dir):
    return extract.spans(_files(spark, sf_dir)).groupBy("repo_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))


@query()
def index_summary(spark, sf_dir):
    every = staged(_classified(spark, sf_dir))
    files = classify.kept_files(every)
    parsed = staged(extract.parse(files, spans=False, text=False))
    return profile.index_summary(files, extract.symbols(parsed), extract.imports(parsed), classify.excluded_paths(every))


# sources


HOSTS = ["example.com", "www.example.org", "news0.example.com"]
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_PART = lambda k: f"regexp_extract(url, '{_URL}', {k})"


@query(f"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '{_URL}') OR {_PART(3)} = '' OR regexp_matches(url, '\\s') THEN 'not a valid URL'
WHEN lower({_PART(1)}) <> 'https' THEN 'only https:// sources are allowed' WHEN {_PART(2)} NOT IN ('', '@', ':@') THEN 'credentials in the URL are not allowed'
WHEN {_PART(4)} NOT IN ('', ':', ':443') THEN 'only the default https port is allowed' WHEN length({_PART(6)}) > 1 OR length({_PART(7)}) > 1 THEN 'query strings and fragments are not allowed'
WHEN starts_with({_PART(3)}, '[') OR regexp_matches({_PART(3)}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 'IP-literal hosts are not allowed'
WHEN lower({_PART(3)}) NOT IN ({", ".join(repr(h) for h in HOSTS)}) THEN 'host ' || lower({_PART(3)}) || ' is not in the allowlist' END AS problem FROM pages""")
def url_validation(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", c.source_problem(F.col("url"), HOSTS).alias("problem"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\.git$', '') AS name FROM pages")
def repo_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", c.source_name(F.col("url")).alias("name"))


_DECORATED = "CASE doc_id % 5 WHEN 1 THEN '/' || path WHEN 2 THEN '../' || path WHEN 3 THEN replace(path, '/', '//') ELSE path END"


@query(corpus.CORPUS_SQL + rf""", d AS (SELECT doc_id, {_DECORATED} AS rel FROM corpus)
SELECT doc_id, CASE WHEN NOT (rel = '' OR length(rel) > 1024 OR contains(rel, '\') OR starts_with(rel, '/') OR regexp_matches(rel, '^[A-Za-z]:') OR len(list_filter(string_split(rel, '/'), lambda x: x IN ('', '.', '..'))) > 0) THEN rel END AS rel FROM d""")
def safe_paths(spark, sf_dir):
    rows = corpus.corpus_files(_table(spark, sf_dir, "documents")).select("doc_id", F.expr(_DECORATED).alias("rel"))
    return rows.select("doc_id", c.safe_relative_path(F.col("rel")).alias("rel"))


_IP = "concat_ws('.', cast((event_id * 7919) % 256 as {s}), cast((event_id * 31) % 256 as {s}), cast((event_id * 17) % 4 as {s}), cast(event_id % 256 as {s}))"
_NUMBER = "((event_id * 7919) % 256) * 16777216 + ((event_id * 31) % 256) * 65536 + ((event_id * 17) % 4) * 256 + event_id % 256"


@query(f"SELECT event_id, {_IP.format(s='varchar')} AS address, " + " OR ".join(f"{_NUMBER} BETWEEN {c.v4_int(a)} AND {c.v4_int(b)}" for a, b in c.FORBIDDEN_V4) + " AS forbidden FROM events")
def forbidden_ip(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_IP.format(s="string")).alias("address"))
    return rows.withColumn("forbidden", c.forbidden_address(F.col("address")))


# catalog


def _jobs(spark, sf_dir):
    return catalog.jobs(_table(spark, sf_dir, "events"))


@query(catalog.JOBS_SQL + " SELECT job_id, repo_id, created_at, status FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) WHERE r = 1")
def latest_job(spark, sf_dir):
    return catalog.latest(_jobs(spark, sf_dir), "repo_id").select("job_id", "repo_id", "created_at", "status")


@query(catalog.JOBS_SQL + ", active AS (SELECT repo_id, arg_min(job_id, (created_at, job_id)) AS a FROM jobs WHERE status IN ('QUEUED', 'RUNNING') GROUP BY repo_id) SELECT c.c_custkey AS repo_id, coalesce(a, c.c_custkey + 1000000000) AS job_id, a IS NULL AS created FROM customer c LEFT JOIN active ON repo_id = c.c_custkey")
def active_job_dedupe(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), (F.col("c_custkey") + 1_000_000_000).alias("new_id"))
    return catalog.enqueue(asked, _jobs(spark, sf_dir))


@query(r"""WITH p AS (SELECT page_id, starts_with(url, 'https:') AS safe, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS source FROM pages),
o AS (SELECT source, min(page_id) AS id, 'old' AS state FROM p WHERE safe GROUP BY source), n AS (SELECT source, min(page_id) + 1000000 AS id, 'new' AS state FROM p WHERE NOT safe GROUP BY source)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE source NOT IN (SELECT source FROM o)""")
def repo_upsert(spark, sf_dir):
    """Hosts of https pages are there already; those of all other pages come in."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.startswith("url", F.lit("https:")).alias("safe"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1).alias("source"))
    old = pages.where("safe").groupBy("source").agg(F.min("page_id").alias("id"), F.lit("old").alias("state"))
    new = pages.where("not safe").select("source", (F.col("page_id") + 1_000_000).alias("id"), F.lit("new").alias("state"))
    return catalog.upsert(old, new, "source")


@query(catalog.JOBS_SQL + " SELECT job_id, repo_id, status, (epoch_us(lead(created_at) OVER (PARTITION BY repo_id ORDER BY created_at, job_id)) - epoch_us(created_at)) // 1000 AS ms FROM jobs")
def stage_durations(spark, sf_dir):
    return catalog.stage_durations(_jobs(spark, sf_dir)).select("job_id", "repo_id", "status", "ms")


@query(catalog.JOBS_SQL + " SELECT job_id, repo_id, created_at, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 20")
def newest_20(spark, sf_dir):
    return catalog.newest(_jobs(spark, sf_dir)).select("job_id", "repo_id", "created_at", "status")


@query(catalog.JOBS_SQL + " SELECT job_id, created_at FROM jobs WHERE status = 'QUEUED' ORDER BY created_at, job_id LIMIT 1")
def oldest_queued(spark, sf_dir):
    return catalog.oldest_queued(_jobs(spark, sf_dir)).select("job_id", "created_at")


@query(catalog.JOBS_SQL + f" SELECT job_id, CASE WHEN status = 'RUNNING' AND created_at < timestamp '2024-01-31' - interval 7200 second THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' AND created_at < timestamp '2024-01-31' - interval 7200 second THEN '{catalog.TIMED_OUT}' END AS error FROM jobs")
def stale_jobs(spark, sf_dir):
    import datetime

    return catalog.fail_stale(_jobs(spark, sf_dir), datetime.datetime(2024, 1, 31), 7200).select("job_id", "status", "error")


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type)
SELECT event_type, n, mean, max, s[(round((n - 1) * 0.5::double) + 1)::int] AS p50, s[(round((n - 1) * 0.95::double) + 1)::int] AS p95, s[(round((n - 1) * 0.99::double) + 1)::int] AS p99 FROM v""")
def latency_percentiles(spark, sf_dir):
    return profile.nearest_rank(_table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query(CLASSIFIED + ", b AS (SELECT path, lines + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS lines FROM classified) SELECT 'a' AS side, path, lines FROM (SELECT path, lines FROM classified EXCEPT ALL SELECT path, lines FROM b) UNION ALL SELECT 'b', path, lines FROM (SELECT path, lines FROM b EXCEPT ALL SELECT path, lines FROM classified)")
def run_diff(spark, sf_dir):
    a = _classified(spark, sf_dir)
    b = a.select("path", (F.col("lines") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("lines"))
    return checks.differences(a.select("path", "lines"), b)


@query(CLASSIFIED + " SELECT repo_id, path FROM classified WHERE doc_id % 4 = 0")
def changed_files(spark, sf_dir):
    """What an incremental run has to index, where every fourth document was another before."""
    now = _classified(spark, sf_dir)
    before = now.withColumn("hash", F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("hash")))
    return evolution.changed_files(now, before).select("repo_id", "path")


@query("WITH " + ZOOMS.split("WITH ", 1)[1] + """, e AS (SELECT a.repo_id, a.path AS src_path, b.path AS dst_path FROM files a JOIN files b ON a.repo_id = b.repo_id AND b.file_id = a.file_id + 7),
s AS (SELECT e.repo_id, e.src_path, e.dst_path, c.z, c.id FROM e JOIN cut c ON e.repo_id = c.repo_id AND (e.src_path = c.path OR starts_with(e.src_path, c.path || '/'))),
d AS (SELECT e.repo_id, e.src_path, e.dst_path, c.z, c.id FROM e JOIN cut c ON e.repo_id = c.repo_id AND (e.dst_path = c.path OR starts_with(e.dst_path, c.path || '/')))
SELECT s.repo_id, s.z::int AS z, s.id AS src_id, d.id AS dst_id, sum(length(src_path) % 3 + 1)::bigint AS n FROM s JOIN d USING (repo_id, src_path, dst_path, z) WHERE s.id <> d.id GROUP BY ALL""")
def bundled_edges(spark, sf_dir):
    """Edges from each file to the seventh after it, summed between the nodes that are drawn at each zoom."""
    files = _indexed(spark, sf_dir)
    dst = files.select("repo_id", (F.col("file_id") - 7).alias("file_id"), F.col("path").alias("dst_path"))
    edges = files.join(dst, ["repo_id", "file_id"]).select("repo_id", F.col("path").alias("src_path"), "dst_path")
    # each edge comes once to three times
    edges = edges.select("*", F.explode(F.sequence(F.lit(1), (F.length("src_path") % 3 + 1).cast("int")))).drop("col")
    return evolution.bundle_edges(edges, tree.visible_cut(_zoomed(spark, sf_dir, files)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory sums with each directory's dominant language."""
    files = staged(_files(spark, sf_dir).select("repo_id", "path", "language", "lines", "bytes"))
    return tree.dir_rollup(files).join(tree.dominant_language(files).hint("merge"), ["repo_id", "dir"])
