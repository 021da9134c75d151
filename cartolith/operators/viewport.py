"""Which tiles and texts a camera needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.sources.storage import staged

SPLIT_FRACTION = 0.6


def with_boxes(keys: DataFrame, sides: DataFrame) -> DataFrame:
    """keys(repo_id, z, x, y) with x0, y0 and size of each tile in the world square."""
    size = F.col("side") / F.pow(F.lit(2.0), F.col("z"))
    return keys.join(sides.select("repo_id", "side").hint("shuffle_hash"), "repo_id").withColumns({"size": size, "x0": F.col("x") * size, "y0": F.col("y") * size})


def has_children(keys: DataFrame) -> DataFrame:
    """keys with has_children: whether a tile of the next zoom lies in it."""
    up = keys.where("z > 0").select("repo_id", (F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()
    return keys.join(up.withColumn("has_children", F.lit(True)).hint("merge"), ["repo_id", "z", "x", "y"], "left").na.fill(False, ["has_children"])


def select_tiles(cameras: DataFrame, keys: DataFrame, sides: DataFrame) -> DataFrame:
    """camera_id, repo_id, z, x, y of the tiles to draw, the most detailed in view.

    cameras: camera_id, repo_id, planes (array of structs a, b, c, d; inside is a*x + b*y + c*z + d >= 0), eye (struct
    x, y, z), viewport_h, px_per_world, max_height. Descending from the roots stops at tiles that are small enough on
    the screen or have no children; a tile is chosen when it is in view, stops, and every tile above it exists, is in
    view and doesn't stop. Without any the roots are chosen. Cameras meet the tiles of their own repository only.
    """
    boxed = staged(with_boxes(has_children(keys), sides))
    top = lambda n, lo, hi: F.when(n >= 0, hi).otherwise(lo)
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("size"), F.col("y0") + F.col("size")
    visible = F.forall("planes", lambda p: p["a"] * top(p["a"], x0, x1) + p["b"] * top(p["b"], y0, y1) + p["c"] * top(p["c"], F.lit(0.0), F.col("max_height")) + p["d"] >= 0)
    dx, dy, dz = (x0 + x1) / 2 - F.col("eye.x"), (y0 + y1) / 2 - F.col("eye.y"), F.col("eye.z")
    dist = F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(0.001))
    small = F.col("size") / dist * F.col("px_per_world") <= F.col("viewport_h") * SPLIT_FRACTION
    at = ["camera_id", "repo_id", "z", "x", "y"]
    lens = ["planes", "eye", "viewport_h", "px_per_world", "max_height"]
    # level by level, so a camera meets the tiles below those that it opens, not all of its repository's
    roots = cameras.join(boxed.where("z = 0").hint("shuffle_hash"), "repo_id")
    chosen, z, asked = None, 0, roots
    while True:
        judged = staged(asked.where(visible).withColumn("stop", small | ~F.col("has_children")).select(*at, *lens, "stop"))
        stops = judged.where("stop").select(*at)
        chosen = stops if chosen is None else chosen.unionByName(stops)
        open_ = judged.where("not stop")
        if open_.isEmpty():
            break
        below = F.explode(F.array(*[F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)]))
        z += 1
        wanted = open_.select("camera_id", "repo_id", *lens, below.alias("t")).select("camera_id", "repo_id", *lens, F.lit(z).alias("z"), "t.x", "t.y")
        asked = wanted.join(boxed.where(F.col("z") == z).hint("merge"), ["repo_id", "z", "x", "y"])
    none = cameras.select("camera_id", "repo_id").join(chosen.select("camera_id").distinct().hint("merge"), "camera_id", "left_anti")
    return chosen.unionByName(keys.where("z = 0").join(none.hint("merge"), "repo_id").select(*at))


def nearest_available(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Per wanted tile (qid, z, x, y) itself or the deepest available tile above it; tiles without one are left out."""
    up = wanted.select("qid", F.explode(c.ancestors(F.col("z"), F.col("x"), F.col("y"))).alias("a")).select("qid", "a.z", "a.x", "a.y")
    hit = up.join(available.select("z", "x", "y").distinct().hint("merge"), ["z", "x", "y"])
    return hit.groupBy("qid").agg(F.max_by(F.struct("z", "x", "y"), F.col("z")).alias("t")).select("qid", "t.z", "t.x", "t.y")


def to_request(wanted: DataFrame, available: DataFrame, requested: DataFrame) -> DataFrame:
    """Wanted tiles that are neither there nor on the way; priority is the zoom."""
    at = ["z", "x", "y"]
    return wanted.select(*at).distinct().join(available, at, "left_anti").join(requested, at, "left_anti").withColumn("priority", F.col("z"))


def roofs(placed: DataFrame, inset: float = 0.9) -> DataFrame:
    """The roof of each file: its cell shrunk toward the centre; empty cells have none."""
    gap = (1 - inset) / 2
    rows = placed.where("kind = 'file' and w > 0 and h > 0")
    return rows.select("repo_id", F.col("id").alias("file_id"), "path", "lines", (F.col("x") + F.col("w") * gap).alias("x"), (F.col("y") + F.col("h") * gap).alias("y"), (F.col("w") * inset).alias("w"), (F.col("h") * inset).alias("h"))


def readable(roofed: DataFrame, px_per_world: float, aim_line: int = 0) -> DataFrame:
    """Roofs at least 24 pixels high whose lines are bars or glyphs, with the line window at the aim."""
    near = roofed.where(F.col("h") * px_per_world >= 24)  # one product before anything else
    em = c.em_scale(F.col("w"), F.col("h"), F.lit(80), F.greatest("lines", F.lit(1)))
    return near.withColumn("tier", c.tier(em * 1.2 * px_per_world)).where("tier <> 'none'").withColumn("first_line", c.window_start(F.lit(aim_line)))


def focus(roofed: DataFrame, needle: str) -> DataFrame:
    """The largest roof whose path holds the text; of equal ones the smallest id."""
    return roofed.where(F.contains("path", F.lit(needle))).orderBy(F.desc(F.col("w") * F.col("h")), "file_id").limit(1)


def describe(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(repo_id, file_id) with path and lines, null where unknown."""
    return asked.join(files.select("repo_id", "file_id", "path", "lines"), ["repo_id", "file_id"], "left")


def legend(nodes: DataFrame) -> DataFrame:
    """Per repository each language with its colour."""
    return nodes.select("repo_id", "language").distinct().withColumn("color", c.color(F.col("language")))
