"""Registered queries on tiles, roofs, cameras and text blocks, and their SQL.

Treemaps aren't SQL; what follows from a layout is. These queries place the nodes of the corpus by simple arithmetic on
their ids, which both engines do alike, and check every tile, feature, roof and camera row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.operators import checks, pyramid, textgrid, tree, viewport
from cartolith.plans.queries import _COLOR, FILES, NODES, ZOOMS, _indexed, _nodes, _table, _zoomed, query
from cartolith.sources.storage import new_folder, staged


def _scattered(spark, sf_dir, files=None):
    """The nodes with zooms, each in a cell that its id and weight give."""
    rows = _zoomed(spark, sf_dir, files)
    sides = rows.where("parent_path = ''").groupBy("repo_id").agg(F.sqrt(F.greatest(F.sum("weight"), F.lit(1)).cast("double")).alias("__side"))
    rows = rows.join(sides.hint("shuffle_hash"), "repo_id")
    at = lambda a, b: F.col("__side") * ((F.col("id") * a) % b).cast("double") / F.lit(float(b))
    root = F.sqrt(F.col("weight").cast("double"))
    return staged(rows.withColumns({"x": at(37, 997), "y": at(61, 991), "w": root, "h": root * (1 + (F.col("id") % 3).cast("double") / 10)}).drop("__side"))


SCATTERED = (
    ZOOMS
    + """,
side AS (SELECT repo_id, sqrt(greatest(sum(weight), 1)::double) AS side FROM nodes WHERE parent_path = '' GROUP BY repo_id),
scat AS (SELECT z.*, s.side, s.side * ((id * 37) % 997)::double / 997 AS x, s.side * ((id * 61) % 991)::double / 991 AS y, sqrt(weight::double) AS w,
  sqrt(weight::double) * (1 + (id % 3)::double / 10) AS h FROM zoomed z JOIN side s USING (repo_id)),
shown AS (SELECT s.*, c.z::int AS z FROM scat s JOIN cut c USING (repo_id, id)),
tiled AS (SELECT *, least(greatest(floor((x + w / 2) / side * (1 << z)), 0), (1 << z) - 1)::bigint AS tx, least(greatest(floor((y + h / 2) / side * (1 << z)), 0), (1 << z) - 1)::bigint AS ty,
  side / (1 << z)::double AS tile FROM shown),
feats AS (SELECT *, (row_number() OVER (PARTITION BY repo_id, z, tx, ty ORDER BY min_file_path, id) - 1)::int AS pos FROM tiled)"""
)
_AT = "repo_id, z, tx, ty"


def _tiles(spark, sf_dir, files=None):
    return staged(pyramid.tiles(_scattered(spark, sf_dir, files)))


@query(SCATTERED + f""" SELECT {_AT}, pos, id, kind, depth, parent_id, lines, language, round((x - tx * tile)::float::double, 3) AS x0, round((y - ty * tile)::float::double, 3) AS y0,
 round((x + w - tx * tile)::float::double, 3) AS x2, round((y + h - ty * tile)::float::double, 3) AS y2, '0,1,2,0,2,3' AS indices FROM feats""")
def tile_geometry(spark, sf_dir):
    """Each feature of each tile at its place, with two corners in the tile's own coordinates."""
    rows = _tiles(spark, sf_dir).select("repo_id", "z", "tx", "ty", F.posexplode("features").alias("pos", "f"))
    corner = lambda i, k: F.round(F.element_at("f.vertices", i)[k].cast("double"), 3)
    return rows.select("repo_id", "z", "tx", "ty", "pos", "f.id", "f.kind", "f.depth", "f.parent_id", "f.lines", "f.language", corner(1, "x").alias("x0"), corner(1, "y").alias("y0"), corner(3, "x").alias("x2"), corner(3, "y").alias("y2"), F.array_join(F.transform("f.indices", lambda i: i.cast("string")), ",").alias("indices"))


@query(SCATTERED + f", k AS (SELECT DISTINCT {_AT} FROM feats) SELECT repo_id, z, tx AS x, ty AS y FROM k")
def tile_keys(spark, sf_dir):
    return pyramid.tile_keys(_tiles(spark, sf_dir))


@query(SCATTERED + f""" SELECT {_AT}, round(min((x - tx * tile)::float)::double, 3) AS min_x, round(max((x + w - tx * tile)::float)::double, 3) AS max_x,
 round(min((y - ty * tile)::float)::double, 3) AS min_y, round(max((y + h - ty * tile)::float)::double, 3) AS max_y FROM feats GROUP BY {_AT}""")
def tile_boxes(spark, sf_dir):
    boxes = pyramid.bounding_boxes(_tiles(spark, sf_dir))
    return boxes.select("repo_id", "z", "tx", "ty", *[F.round(F.col(n).cast("double"), 3).alias(n) for n in ("min_x", "max_x", "min_y", "max_y")])


@query(SCATTERED + """, k AS (SELECT repo_id, count(DISTINCT (z, tx, ty)) AS tiles FROM feats GROUP BY repo_id),
s AS (SELECT repo_id, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS directories FROM nodes GROUP BY repo_id)
SELECT s.*, max_z::int AS max_zoom, tiles FROM s JOIN maxz USING (repo_id) JOIN k USING (repo_id)""")
def page_statistics(spark, sf_dir):
    """What a page shows of each tile set: counts and greatest zoom from its manifest, and its tiles."""
    files = _indexed(spark, sf_dir)
    nodes = _nodes(spark, sf_dir, files)
    tiled = _tiles(spark, sf_dir, files)
    document = pyramid.manifest(nodes, files, staged(tree.node_zooms(nodes)))
    return pyramid.summary(pyramid.TileSetFrames(tiled, tiled, files, pyramid.tile_keys(tiled), document))


_CELL = lambda c_, size: f"least(greatest(floor(({c_} + {size} / 2) / side * 32), 0), 31)::bigint"


@query(SCATTERED + f", cells AS (SELECT repo_id, id, {_CELL('x', 'w')} AS tx, {_CELL('y', 'h')} AS ty FROM scat WHERE repo_id = (SELECT min(repo_id) FROM scat)) SELECT repo_id, 5 AS z, tx, ty, count(*) AS nodes, max(id) AS last FROM cells WHERE tx BETWEEN 3 AND 21 AND ty BETWEEN 6 AND 17 GROUP BY repo_id, tx, ty")
def tiles_in_box(spark, sf_dir):
    """All nodes by tiles of one zoom, stored along the curve, and a view of the first repository read from them."""
    root, rows = new_folder(spark), _scattered(spark, sf_dir)
    sides = rows.where("parent_path = ''").groupBy("repo_id").agg(F.sqrt(F.greatest(F.sum("weight"), F.lit(1)).cast("double")).alias("side"))
    cell = lambda at, size: c.tile_coord(F.col(at) + F.col(size) / 2, F.col("side"), F.lit(5))
    tiled = rows.join(sides.hint("shuffle_hash"), "repo_id").select("repo_id", F.lit(5).alias("z"), cell("x", "w").alias("tx"), cell("y", "h").alias("ty"), "id")
    tiled = tiled.groupBy("repo_id", "z", "tx", "ty").agg(F.count(F.lit(1)).alias("nodes"), F.max("id").alias("last"))
    pyramid.along_curve(tiled).write.option("parquet.block.size", pyramid.ROW_GROUP).partitionBy("z").parquet(f"{root}/tiles")
    first = rows.agg(F.min("repo_id")).first()[0]
    return pyramid.in_box(spark.read.parquet(f"{root}/tiles"), first, 5, 3, 6, 21, 17).select("repo_id", F.col("z").cast("int").alias("z"), "tx", "ty", "nodes", "last")


_LAYERS = ", names AS (SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY language) - 1 AS idx FROM (SELECT DISTINCT repo_id, language FROM nodes))"


@query(SCATTERED + _LAYERS + f" SELECT 'lines' AS layer, {_AT}, pos, lines::double AS value FROM feats UNION ALL SELECT 'language', {_AT}, pos, idx::double FROM feats JOIN names USING (repo_id, language)")
def tile_layer_values(spark, sf_dir):
    placed = _scattered(spark, sf_dir)
    rows = pyramid.layers(staged(pyramid.tiles(placed)), placed)
    return rows.select("layer", "repo_id", "z", "tx", "ty", F.posexplode("values").alias("pos", "value"))


@query(SCATTERED + f", n AS (SELECT *, count(*) OVER (PARTITION BY {_AT}) AS n FROM feats) SELECT {_AT}, id, CASE WHEN tx % 2 = 0 AND pos < n - 1 THEN lines::double ELSE -1 END AS value FROM n")
def layer_by_position(spark, sf_dir):
    """A layer that lacks each tile's last value, and every second column of tiles, joined by position with a default."""
    tiled = _tiles(spark, sf_dir)
    short = tiled.where("tx % 2 = 0").select("repo_id", "z", "tx", "ty", F.transform(F.slice("features", F.lit(1), F.size("features") - 1), lambda f: f["lines"].cast("double")).alias("values"))
    rows = pyramid.aligned(tiled, short, default=-1.0).select("repo_id", "z", "tx", "ty", F.explode("features").alias("f"))
    return rows.select("repo_id", "z", "tx", "ty", "f.id", "f.value")


# invariants, on tile sets that break them


@query(SCATTERED + f", m AS (SELECT repo_id, max(z) AS z FROM feats WHERE tx % 3 > 0 GROUP BY repo_id), seen AS (SELECT DISTINCT f.repo_id, f.id FROM feats f JOIN m USING (repo_id, z) WHERE tx % 3 > 0 AND kind = 'file') SELECT repo_id, file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.repo_id = f.repo_id AND s.id = f.file_id)")
def files_without_tile(spark, sf_dir):
    files = _indexed(spark, sf_dir)
    return checks.not_once_at_max_zoom(_tiles(spark, sf_dir, files).where("tx % 3 > 0"), files).select("repo_id", "file_id")


@query(SCATTERED + " SELECT repo_id, round(abs(sum(w * h) FILTER (kind = 'file') - any_value(side * side)) / any_value(side * side), 6) AS error FROM scat GROUP BY repo_id")
def area_errors(spark, sf_dir):
    return checks.area_error(_scattered(spark, sf_dir)).withColumn("error", F.round("error", 6))


@query(SCATTERED + f" SELECT {_AT}, count(*)::int AS n FROM feats GROUP BY {_AT} HAVING count(*) > 3")
def crowded_tiles(spark, sf_dir):
    return checks.over_budget(_tiles(spark, sf_dir), most_features=3, most_bytes=1 << 30).select("repo_id", "z", "tx", "ty", "n")


@query(SCATTERED + f" SELECT {_AT}, count(*)::int AS n, CASE WHEN ty % 2 = 0 THEN (count(*) - 1)::int END AS m FROM feats GROUP BY {_AT}")
def unequal_layers(spark, sf_dir):
    """A layer that is short by one value and lacks every second row of tiles."""
    tiled = _tiles(spark, sf_dir)
    layer = tiled.where("ty % 2 = 0").select("repo_id", "z", "tx", "ty", F.lit("lines").alias("layer"), F.slice("features", F.lit(1), F.size("features") - 1).alias("values"))
    return checks.misaligned(tiled, layer).select("repo_id", "z", "tx", "ty", "n", "m")


# the tree


@query(NODES + " SELECT repo_id, coalesce(sum(weight) FILTER (parent_path = ''), 0)::bigint AS world_weight, round(sqrt(greatest(sum(weight) FILTER (parent_path = ''), 1)::double), 6) AS side FROM nodes GROUP BY repo_id")
def world_bounds(spark, sf_dir):
    return tree.world(_indexed(spark, sf_dir)).withColumn("side", F.round("side", 6))


_PAINT = _COLOR.replace("\nSELECT language, ", ", paint AS (SELECT language, ", 1) + ")"


@query(NODES + "," + _PAINT + " SELECT DISTINCT n.repo_id, n.language, paint.color FROM nodes n JOIN paint USING (language)")
def legend(spark, sf_dir):
    return viewport.legend(_nodes(spark, sf_dir))


# cameras


@query(SCATTERED + f""", keys AS (SELECT DISTINCT {_AT} FROM feats), sides AS (SELECT DISTINCT repo_id, side FROM scat),
cams AS (SELECT repo_id || ':' || k AS camera_id, repo_id, side, k * side / 16 AS lo, side / (k + 1) AS ez FROM sides, (SELECT unnest(range(0, 8)) AS k)),
boxed AS (SELECT k.repo_id, k.z, tx, ty, w.side / (1 << k.z)::double AS size, tx * (w.side / (1 << k.z)::double) AS x0, ty * (w.side / (1 << k.z)::double) AS y0,
  EXISTS (SELECT 1 FROM keys c WHERE c.repo_id = k.repo_id AND c.z = k.z + 1 AND c.tx >> 1 = k.tx AND c.ty >> 1 = k.ty) AS has_children FROM keys k JOIN sides w USING (repo_id)),
judged AS (SELECT camera_id, b.*, x0 + size - lo >= 0 AND lo + side / 2 - x0 >= 0 AND y0 + size - lo >= 0 AND lo + side / 2 - y0 >= 0 AS visible,
  size / greatest(sqrt(((x0 + (x0 + size)) / 2 - (lo + side / 4)) * ((x0 + (x0 + size)) / 2 - (lo + side / 4)) + ((y0 + (y0 + size)) / 2 - (lo + side / 4)) * ((y0 + (y0 + size)) / 2 - (lo + side / 4)) + ez * ez), 0.001) * 1000 <= 1000 * {viewport.SPLIT_FRACTION}::double OR NOT has_children AS stop
  FROM boxed b JOIN cams USING (repo_id)),
chosen AS (SELECT * FROM judged j WHERE visible AND stop AND (SELECT count(*) FROM judged a WHERE a.camera_id = j.camera_id AND a.z < j.z AND a.tx = j.tx >> (j.z - a.z) AND a.ty = j.ty >> (j.z - a.z) AND a.visible AND NOT a.stop) = j.z)
SELECT camera_id, repo_id, z, tx AS x, ty AS y FROM chosen
UNION ALL SELECT camera_id, c.repo_id, z, tx, ty FROM cams c JOIN keys k ON k.repo_id = c.repo_id AND k.z = 0 WHERE camera_id NOT IN (SELECT camera_id FROM chosen)""")
def camera_tiles(spark, sf_dir):
    """Eight fixed boxes of the world as cameras of every repository."""
    files = _indexed(spark, sf_dir)
    keys = staged(pyramid.tile_keys(_tiles(spark, sf_dir, files)))
    worlds = tree.world(files)
    plane = lambda a, b, d: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(0.0).alias("c"), d.alias("d"))
    cams = worlds.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    lo, half = F.col("k") * F.col("side") / 16, F.col("side") / 2
    middle = lo + F.col("side") / 4
    cams = cams.select(
        F.concat_ws(":", "repo_id", "k").alias("camera_id"), "repo_id", F.array(plane(1.0, 0.0, -lo), plane(-1.0, 0.0, lo + half), plane(0.0, 1.0, -lo), plane(0.0, -1.0, lo + half)).alias("planes"),
        F.struct(middle.alias("x"), middle.alias("y"), (F.col("side") / (F.col("k") + 1)).alias("z")).alias("eye"), F.lit(1000.0).alias("viewport_h"), F.lit(1000.0).alias("px_per_world"), F.lit(1.0).alias("max_height"),
    )
    return viewport.select_tiles(cams, keys, worlds)


_ROOFS = ", roofs AS (SELECT repo_id, id AS file_id, path, lines, x + w * 0.05::double AS rx, y + h * 0.05::double AS ry, w * 0.9::double AS rw, h * 0.9::double AS rh FROM scat WHERE kind = 'file' AND w > 0 AND h > 0)"


@query(SCATTERED + _ROOFS + " SELECT repo_id, file_id, path, lines, round(rx, 4) AS x, round(ry, 4) AS y, round(rw, 4) AS w, round(rh, 4) AS h FROM roofs")
def roof_rectangles(spark, sf_dir):
    rows = viewport.roofs(_scattered(spark, sf_dir))
    return rows.select("repo_id", "file_id", "path", "lines", *[F.round(k, 4).alias(k) for k in "xywh"])


@query(SCATTERED + _ROOFS + """, em AS (SELECT *, greatest(least(rw * 0.92::double / (80 * 0.6::double), rh * 0.92::double / (greatest(lines, 1) * 1.2::double)), 0) * 1.2::double * 40 AS px FROM roofs WHERE rh * 40 >= 24)
SELECT repo_id, file_id, CASE WHEN px >= 6 THEN 'glyphs' ELSE 'bars' END AS tier, 256::bigint AS first_line FROM em WHERE px >= 1""")
def readable_texts(spark, sf_dir):
    return viewport.readable(viewport.roofs(_scattered(spark, sf_dir)), px_per_world=40.0, aim_line=600).select("repo_id", "file_id", "tier", "first_line")


@query(SCATTERED + _ROOFS + " SELECT repo_id, file_id, path FROM roofs WHERE contains(path, 'de/p1') ORDER BY rw * rh DESC, file_id, repo_id LIMIT 1")
def focus_path(spark, sf_dir):
    return viewport.focus(viewport.roofs(_scattered(spark, sf_dir)), "de/p1").select("repo_id", "file_id", "path")


@query(FILES + ", asked AS (SELECT repo_id, file_id * 2 AS file_id FROM files) SELECT a.repo_id, a.file_id, path, lines FROM asked a LEFT JOIN files f USING (repo_id, file_id)")
def described_files(spark, sf_dir):
    """Every second id, of which some are unknown."""
    files = _indexed(spark, sf_dir)
    return viewport.describe(files.select("repo_id", (F.col("file_id") * 2).alias("file_id")), files)


@query(FILES + " SELECT repo_id, file_id, file_id >> 12 AS bucket, round(0.12::double * 100 / greatest(log2(100000::double + 1), 1) * log2(greatest(lines, 0)::double + 1), 6) AS height FROM files")
def heights_and_buckets(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    return rows.select("repo_id", "file_id", c.storage_bucket(F.col("file_id")).alias("bucket"), F.round(c.height(F.col("lines"), F.lit(100_000), F.lit(100.0)), 6).alias("height"))


_RUNS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, regexp_extract(t, '^[^ \\t\\r]+', 0) AS word FROM l WHERE regexp_matches(t, '^[^ \\t\\r]')),
runs AS (SELECT doc_id, line::int AS line, 1 AS cls, 0 AS first_col, least(length(word), 120) - 1 AS last_col FROM w),
roofs AS (SELECT doc_id, (doc_id % 10)::double AS x, 2::double AS y, 30::double AS w, 20::double AS h, 80 AS cols, greatest(len(string_split(text, chr(10))), 1) AS lines FROM documents),
em AS (SELECT r.*, greatest(least(w * 0.92::double / (greatest(cols, 1) * 0.6::double), h * 0.92::double / (greatest(lines, 1) * 1.2::double)), 0) AS em FROM roofs r)"""


def _first_words(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(r"^[^ \t\r]"))
    word = F.regexp_extract("t", r"^[^ \t\r]+", 0)
    return lines.select("doc_id", "line", F.lit(1).alias("cls"), F.lit(0).alias("first_col"), (F.least(F.length(word), F.lit(120)) - 1).alias("last_col"))


@query(_RUNS + """ SELECT doc_id, line, cls, round(x + (w - cols * 0.6::double * em) / 2 + first_col * 0.6::double * em, 5) AS rx, round(y + (h + lines * 1.2::double * em) / 2 - (line + 1) * 1.2::double * em, 5) AS ry,
 round((last_col - first_col + 1) * 0.6::double * em, 5) AS rw, round(1.2::double * em, 5) AS rh FROM runs JOIN em USING (doc_id)""")
def text_rectangles(spark, sf_dir):
    """The first word of each line as a rectangle on its document's roof."""
    docs = _table(spark, sf_dir, "documents")
    roofs = docs.select("doc_id", (F.col("doc_id") % 10).cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(30.0).alias("w"), F.lit(20.0).alias("h"), F.lit(80).alias("cols"), F.greatest(F.size(F.split("text", "\n")), F.lit(1)).alias("lines"))
    rows = textgrid.placed_runs(_first_words(spark, sf_dir), roofs)
    return rows.select("doc_id", "line", "cls", *[F.round(k, 5).alias(k) for k in ("rx", "ry", "rw", "rh")])


@query(_RUNS + " SELECT doc_id, line, last_col FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_col DESC, line) AS r FROM runs) WHERE r <= 5")
def longest_first_words(spark, sf_dir):
    """A display limit: at most five rows of each document."""
    return textgrid.capped(_first_words(spark, sf_dir), "doc_id", [F.desc("last_col"), "line"], 5).select("doc_id", "line", "last_col")


@query(NODES + " SELECT repo_id, 'language' AS key, 'categorical' AS kind, count(DISTINCT language)::int AS categories, NULL::double AS most FROM nodes GROUP BY repo_id UNION ALL SELECT repo_id, 'lines', 'scalar', NULL, max(lines)::double FROM files GROUP BY repo_id")
def manifest_layer_rows(spark, sf_dir):
    files = _indexed(spark, sf_dir)
    nodes = _nodes(spark, sf_dir, files)
    rows = pyramid.manifest_layers(pyramid.manifest(nodes, files, staged(tree.node_zooms(nodes))))
    return rows.select("repo_id", "key", "kind", F.when(F.col("categories").isNotNull(), F.size("categories")).alias("categories"), F.col("range.max").alias("most"))

