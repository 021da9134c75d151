"""Characters, classes and runs of text on a line and column grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.functions import columns as c

MAX_COLS, TAB, WINDOW = 120, 4, 1024
MAX_GLYPHS, MAX_BARS = 48_000, 12_000


def lines_in_window(texts: DataFrame, first: int | None = None) -> DataFrame:
    """texts(doc_id, content) as doc_id, line, text; with `first` only the window's lines are made."""
    lines = F.split("content", "\n")
    if first is not None:
        lines = F.slice(lines, first + 1, WINDOW)
    return texts.select("doc_id", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + (first or 0))


def characters(lines: DataFrame) -> DataFrame:
    """doc_id, line, pos, ch, col of visible characters: tabs go to stops, and columns from MAX_COLS on are left out."""
    # a character takes a column at least
    chars = F.filter(F.split(F.substring("text", 1, MAX_COLS), ""), lambda x: x != "")
    step = lambda acc, ch: F.struct(
        F.when(ch == "\t", (F.floor(acc["col"] / TAB).cast("int") + 1) * TAB).otherwise(acc["col"] + 1).alias("col"),
        F.concat(acc["at"], F.array(acc["col"])).alias("at"),
    )
    at = F.aggregate(chars, F.struct(F.lit(0).alias("col"), F.array().cast("array<int>").alias("at")), step, lambda a: a["at"])
    rows = lines.select("doc_id", "line", F.posexplode(F.arrays_zip(chars.alias("ch"), at.alias("col"))).alias("pos", "c"))
    return rows.select("doc_id", "line", "pos", "c.ch", "c.col").where((F.col("col") < MAX_COLS) & ~F.col("ch").isin(" ", "\t", "\r"))


def classed_at(offsets: DataFrame, spans: DataFrame, default: int = 0) -> DataFrame:
    """offsets(doc_id, off) with cls of the span that holds each, else the default.

    Spans are disjoint, so the last one that starts at or before an offset is the only candidate: one sort of both per
    document takes the place of a range join.
    """
    both = offsets.select("doc_id", "off", F.lit(1).alias("k"), F.lit(None).cast("struct<stop:bigint,cls:int>").alias("s"))
    both = both.unionByName(spans.select("doc_id", F.col("start").alias("off"), F.lit(0).alias("k"), F.struct((F.col("start") + F.col("len")).cast("long").alias("stop"), F.col("cls").cast("int").alias("cls")).alias("s")))
    last = F.last("s", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("off", "k").rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("s", last).where("k = 1")
    return rows.select("doc_id", "off", F.when(F.col("s.stop") > F.col("off"), F.col("s.cls")).otherwise(F.lit(default)).alias("cls"))


def classed_in_lists(rows: DataFrame, default: int = 0) -> DataFrame:
    """classed_at where a document's offsets and its spans are lists in its one row: doc_id, off, cls of rows(doc_id, offs,
    gaps, lens, classes). The spans are in order, a gap is the distance from the end of the one before. Nothing is
    shuffled."""

    def run(batches):
        for batch in batches:
            docs, offs, found = [], [], []
            for i, lists in enumerate(zip(*[batch.column(c) for c in ("offs", "gaps", "lens", "classes")], strict=True)):
                off, gap, size, cls = (x.values.to_numpy().astype(np.int64) for x in lists)
                stops = np.cumsum(gap + size)
                at = np.searchsorted(stops - size, off, "right") - 1
                held = (at >= 0) & (off < np.concatenate((stops, [0]))[at])
                docs.append(np.full(len(off), i))
                offs.append(off)
                found.append(np.where(held, np.concatenate((cls, [default]))[at], default))
            if docs:
                columns = [batch.column("doc_id").take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(offs)), pa.array(np.concatenate(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "off", "cls"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "offs", "gaps", "lens", "classes").mapInArrow(run, f"doc_id {kind}, off long, cls int")


def runs(chars: DataFrame) -> DataFrame:
    """Gaps and islands: neighbouring characters of a line with one class and next columns are one run.

    chars: doc_id, line, col, cls. Gives doc_id, line, cls, first_col, last_col.
    """
    w = W.partitionBy("doc_id", "line").orderBy("col")
    same = (F.lag("cls").over(w) == F.col("cls")) & (F.lag("col").over(w) == F.col("col") - 1)
    marked = chars.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "line", "run", "cls").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("run")


def placed_runs(rows: DataFrame, roofs: DataFrame, advance: float = 0.6, line_height: float = 1.2) -> DataFrame:
    """Rectangles of runs in a block centred on its roof. roofs: doc_id, x, y, w, h, cols, lines."""
    em = c.em_scale(F.col("w"), F.col("h"), F.col("cols"), F.col("lines"), advance, line_height)
    r = rows.join(roofs.hint("merge"), "doc_id").withColumn("em", em)
    left = F.col("x") + (F.col("w") - F.col("cols") * advance * F.col("em")) / 2
    top = F.col("y") + (F.col("h") + F.col("lines") * line_height * F.col("em")) / 2
    return r.select("doc_id", "line", "cls", (left + F.col("first_col") * advance * F.col("em")).alias("rx"), (top - (F.col("line") + 1) * line_height * F.col("em")).alias("ry"), ((F.col("last_col") - F.col("first_col") + 1) * advance * F.col("em")).alias("rw"), (line_height * F.col("em")).alias("rh"))


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key: a display limit."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def span_deltas(spans: DataFrame) -> DataFrame:
    """spans with gap: the distance from the end of the one before."""
    w = W.partitionBy("doc_id").orderBy("start")
    return spans.withColumn("gap", F.col("start") - F.lag(F.col("start") + F.col("len"), 1, 0).over(w))


def span_starts(deltas: DataFrame, order: str = "ord") -> DataFrame:
    """The starts that gaps and lengths stand for."""
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumn("start", F.sum(F.col("gap") + F.col("len")).over(w) - F.col("len"))


def windows_of_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line) with every window of WINDOW lines, one each 512 lines, that shows them."""
    k = F.floor((F.col("line") + 256) / 512)
    starts = F.array_distinct(F.transform(F.sequence(F.greatest(k - 2, F.lit(0)), k), lambda i: F.greatest(i * 512 - 256, F.lit(0)).cast("long")))
    ok = F.filter(starts, lambda s: (s <= F.col("line")) & (F.col("line") < s + WINDOW))
    return lines.select("doc_id", "line", F.explode(ok).alias("first"))
