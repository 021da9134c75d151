"""The tile pyramid: features by tile, value layers aligned with them, and the manifest."""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.operators import profile, tree, treemap
from cartolith.sources import corpus
from cartolith.sources.storage import staged

FORMAT_VERSION = 2
FEATURE = "struct<ord:string,id:bigint,kind:string,depth:int,parent_id:bigint,lines:bigint,language:string,vertices:array<struct<x:float,y:float>>,indices:array<int>>"


def feature_geometry(x: Column, y: Column) -> Column:
    """A cell's corners relative to its tile, counter-clockwise."""
    at = lambda px, py: F.struct((px - x).cast("float").alias("x"), (py - y).cast("float").alias("y"))
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))


def tiles(placed: DataFrame) -> DataFrame:
    """repo_id, z, tx, ty and features: of each zoom's visible nodes, those whose centre lies in the tile, depth first.

    placed: nodes with zooms and rectangles. Bounded by the visible cut, a tile holds few thousand features.
    """
    sides = placed.where("parent_path = ''").groupBy("repo_id").agg(F.sqrt(F.greatest(F.sum("weight"), F.lit(1)).cast("double")).alias("side"))
    cut = tree.visible_cut(placed).join(sides.hint("shuffle_hash"), "repo_id")
    cut = cut.withColumn("tx", c.tile_coord(F.col("x") + F.col("w") / 2, F.col("side"), F.col("z"))).withColumn("ty", c.tile_coord(F.col("y") + F.col("h") / 2, F.col("side"), F.col("z")))
    tile = F.col("side") / F.pow(F.lit(2.0), F.col("z"))
    feature = F.struct(
        F.col("min_file_path").alias("ord"), "id", "kind", "depth", "parent_id", c.clamp_u32(F.col("lines")).alias("lines"), "language",
        feature_geometry(F.col("tx") * tile, F.col("ty") * tile).alias("vertices"), F.array(*[F.lit(i) for i in (0, 1, 2, 0, 2, 3)]).alias("indices"),
    )
    return cut.groupBy("repo_id", "z", "tx", "ty").agg(F.array_sort(F.collect_list(feature)).alias("features"))


def layers(tiled: DataFrame, categories: DataFrame) -> DataFrame:
    """layer, repo_id, z, tx, ty, values: one value for each feature, at its position."""
    names = categories.groupBy("repo_id").agg(F.array_sort(F.collect_set("language")).alias("names"))
    rows = tiled.join(names.hint("shuffle_hash"), "repo_id", "left")
    lines = rows.select(F.lit("lines").alias("layer"), "repo_id", "z", "tx", "ty", F.transform("features", lambda f: f["lines"].cast("double")).alias("values"))
    langs = rows.select(F.lit("language").alias("layer"), "repo_id", "z", "tx", "ty", F.transform("features", lambda f: F.greatest(F.coalesce(F.array_position(F.col("names"), f["language"]), F.lit(0)) - 1, F.lit(0)).cast("double")).alias("values"))
    return lines.unionByName(langs)


def aligned(tiled: DataFrame, layered: DataFrame, default: float = 0.0) -> DataFrame:
    """Features with one layer's values by position: missing values get the default, surplus ones go."""
    at = ["repo_id", "z", "tx", "ty"]
    rows = tiled.join(layered.hint("merge"), at, "left")
    value = lambda i: F.coalesce(F.try_element_at(F.coalesce("values", F.array().cast("array<double>")), (i + 1).cast("int")), F.lit(default))
    return rows.select(*at, F.transform("features", lambda f, i: F.struct(f["id"].alias("id"), value(i).alias("value"))).alias("features"))


def bounding_boxes(tiled: DataFrame) -> DataFrame:
    """repo_id, z, tx, ty and the least and greatest x and y of all vertices in the tile; null where it has none."""
    of = lambda k: F.flatten(F.transform("features", lambda f: F.transform(f["vertices"], lambda v: v[k])))
    return tiled.select("repo_id", "z", "tx", "ty", *[f(of(k)).alias(f"{name}_{k}") for k in "xy" for name, f in (("min", F.array_min), ("max", F.array_max))])


def tile_keys(tiled: DataFrame) -> DataFrame:
    return tiled.select("repo_id", "z", F.col("tx").alias("x"), F.col("ty").alias("y")).distinct().orderBy("repo_id", "z", "x", "y")


def path_index(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "file_id", c.clamp_u32(F.col("lines")).alias("lines"), c.clamp_u32(F.col("bytes")).alias("bytes"), "path").orderBy("repo_id", "file_id")


def manifest(nodes: DataFrame, files: DataFrame, zoomed: DataFrame, has_text: bool = False, generated_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """repo_id and its JSON document; absent options are left out."""
    cats = nodes.select("repo_id", "language").distinct().groupBy("repo_id").agg(F.array_sort(F.collect_set("language")).alias("names"))
    rows = profile.repo_stats(nodes).join(tree.world(files), "repo_id").join(profile.layer_range(files), "repo_id").join(tree.max_zoom(zoomed), "repo_id").join(cats, "repo_id")
    category = lambda name: F.struct(name.alias("label"), c.color(name).alias("color"))
    kind = "struct<key:string,label:string,kind:string,unit:string,categories:array<struct<label:string,color:string>>,range:struct<min:double,max:double>>"
    language = F.struct(F.lit("language").alias("key"), F.lit("Language").alias("label"), F.lit("categorical").alias("kind"), F.lit(None).alias("unit"), F.transform("names", category).alias("categories"), F.lit(None).alias("range")).cast(kind)
    lines = F.struct(F.lit("lines").alias("key"), F.lit("Lines").alias("label"), F.lit("scalar").alias("kind"), F.lit("lines").alias("unit"), F.lit(None).alias("categories"), F.struct(F.col("min_lines").cast("double").alias("min"), F.col("max_lines").cast("double").alias("max")).alias("range")).cast(kind)
    doc = F.struct(
        F.lit(FORMAT_VERSION).alias("formatVersion"), F.struct(F.col("repo_id").alias("name"), F.lit("").alias("source"), F.lit("").alias("commitSha")).alias("repo"),
        F.lit(generated_at).alias("generatedAt"),
        F.struct(F.lit(0.0).alias("minX"), F.lit(0.0).alias("minY"), F.col("side").alias("maxX"), F.col("side").alias("maxY")).alias("bounds"),
        F.col("max_z").alias("maxZoom"), F.struct(F.lit("rectangle").alias("source")).alias("shape"),
        F.struct("files", "directories", "lines", "bytes", "languages").alias("stats"), F.array(language, lines).alias("layers"),
        F.lit(False).alias("hasEdges"), F.lit(has_text).alias("hasText"),
    )
    return rows.select("repo_id", F.to_json(doc).alias("manifest"))


MANIFEST = "struct<formatVersion:int,repo:struct<name:string,source:string,commitSha:string>,generatedAt:string,bounds:struct<minX:double,minY:double,maxX:double,maxY:double>,maxZoom:int,shape:struct<source:string,seed:bigint>,stats:struct<files:bigint,directories:bigint,lines:bigint,bytes:bigint,languages:bigint>,layers:array<struct<key:string,label:string,kind:string,unit:string,categories:array<struct<label:string,color:string>>,range:struct<min:double,max:double>>>,hasEdges:boolean,hasText:boolean>"


def read_manifest(manifests: DataFrame) -> DataFrame:
    """manifests(manifest) parsed; another format version is an error."""
    rows = manifests.withColumn("m", F.from_json("manifest", MANIFEST))
    checked = F.when(F.col("m.formatVersion") == FORMAT_VERSION, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("format version "), F.coalesce(F.col("m.formatVersion").cast("string"), F.lit("missing")))).cast(MANIFEST))
    return rows.withColumn("m", checked)


#: Bytes of a row group in stored tiles: what a read of one tile takes at least.
ROW_GROUP = 1 << 20


def along_curve(rows: DataFrame, *first: str) -> DataFrame:
    """rows(repo_id, z, tx, ty) with `morton`, dealt and sorted so that neighbours on the map are neighbours in files."""
    order = [*first, "repo_id", "z", "morton"]
    return rows.withColumn("morton", c.morton(F.col("tx"), F.col("ty"))).repartitionByRange(*order).sortWithinPartitions(*order)


def in_box(stored: DataFrame, repo_id: str, z: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The rows of a stored table of tiles or layers from tile (x0, y0) to (x1, y1) of a repository and zoom.

    A few ranges of the curve hold the box; files and row groups outside them aren't read.
    """
    near = F.lit(False)
    for low, high in c.morton_ranges(z, x0, y0, x1, y1):
        near = near | F.col("morton").between(low, high)
    return stored.where((F.col("repo_id") == repo_id) & (F.col("z") == z) & near & F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))


@dataclass
class TileSetFrames:
    """A tile set's tables, read lazily. Stored tiles and layers have a column morton; see in_box."""

    tiles: DataFrame
    layers: DataFrame
    paths: DataFrame
    keys: DataFrame
    manifest: DataFrame

    def write(self, root: str) -> None:
        along_curve(self.tiles.drop("morton")).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("z").parquet(f"{root}/tiles")
        # adding a layer rewrites its own partitions only
        dealt = along_curve(self.layers.drop("morton"), "layer")
        dealt.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z").parquet(f"{root}/layers")
        for name in ("paths", "keys", "manifest"):
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")

    @staticmethod
    def open(spark: SparkSession, root: str) -> TileSetFrames:
        return TileSetFrames(*[corpus.read_table(spark, root, name) for name in ("tiles", "layers", "paths", "keys", "manifest")])


def write_text(text: DataFrame, root: str) -> None:
    """One row per parsed file whose text is known, in buckets of 4096 file ids."""
    text.where("content is not null").withColumn("bucket", c.storage_bucket(F.col("file_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/text")


def build_tileset(files: DataFrame, has_text: bool = False) -> TileSetFrames:
    """From files(repo_id, file_id, path, language, bytes, lines) to all tables of a tile set."""
    files = staged(files)
    nodes = staged(tree.tree_nodes(files))
    zoomed = staged(tree.node_zooms(nodes))
    tiled = staged(tiles(staged(treemap.lay_out(zoomed))))
    return TileSetFrames(tiled, layers(tiled, nodes), path_index(files), tile_keys(tiled), manifest(nodes, files, zoomed, has_text))


def summary(frames: TileSetFrames) -> DataFrame:
    """One row per repository: tiles, and the manifest's counts."""
    counts = frames.keys.groupBy("repo_id").agg(F.count(F.lit(1)).alias("tiles"))
    m = read_manifest(frames.manifest)
    return m.select("repo_id", "m.stats.files", "m.stats.directories", F.col("m.maxZoom").alias("max_zoom")).join(counts, "repo_id", "left").na.fill(0, ["tiles"])


def manifest_layers(manifests: DataFrame) -> DataFrame:
    """One row per layer of each manifest, unique by tile set and key."""
    return read_manifest(manifests).select("repo_id", F.explode("m.layers").alias("l")).select("repo_id", "l.*").dropDuplicates(["repo_id", "key"])


