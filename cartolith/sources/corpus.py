"""Corpora: folders of files, tables of texts, and the stored tables made from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.sources.folder import listing, scan_folder, total_size  # noqa: F401

INDEX_TABLES = ("files", "symbols", "imports", "text", "excluded", "meta", "edges")
EDGES = "repo_id string, src_file_id long, dst_file_id long, kind string, confidence string"
SCHEMA_VERSION = "2"


#: How `documents` become files: see corpus_files.
DIRS = ["core", "lib", "web", "tools", "docs", "vendor", "core-ext", "node_modules", "src"]
EXTENSIONS = [".rs", ".py", ".ts", ".tsx", ".go", ".c", ".java", ".md", ".min.js", ".JSON", "", ".zig"]


def corpus_files(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang, source) as a corpus of many repositories: repo_id, doc_id, path, content (text)."""
    q = F.expr("doc_id div 20")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (q % n + 1).cast("int"))
    doc = F.col("doc_id").cast("string")
    name = (
        F.when(q % 11 == 10, F.concat(F.lit("d"), doc, F.lit("/Cargo.lock")))
        .when(q % 13 == 12, F.concat(F.lit("d"), doc, F.lit("/Makefile")))
        .otherwise(F.concat(F.lit("f"), doc, pick(EXTENSIONS, 12)))
    )
    path = F.concat_ws("/", pick(DIRS, 9), F.col("lang"), F.concat(F.lit("p"), (q % 4).cast("string")), name)
    head = F.when(q % 17 == 16, F.lit("// @generated\n")).otherwise(F.lit(""))
    content = F.concat(head, F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("")))
    return documents.select(F.col("source").alias("repo_id"), "doc_id", path.alias("path"), content.alias("content"))


CORPUS_SQL = f"""
WITH raw AS (SELECT doc_id, text, lang, source, doc_id // 20 AS q FROM documents),
corpus AS (SELECT source AS repo_id, doc_id,
  ({DIRS!r})[(q % 9 + 1)::int] || '/' || lang || '/p' || (q % 4)::varchar || '/' ||
  CASE WHEN q % 11 = 10 THEN 'd' || doc_id::varchar || '/Cargo.lock' WHEN q % 13 = 12 THEN 'd' || doc_id::varchar || '/Makefile'
  ELSE 'f' || doc_id::varchar || ({EXTENSIONS!r})[(q % 12 + 1)::int] END AS path,
  CASE WHEN q % 17 = 16 THEN '// @generated' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS content
  FROM raw)"""


def in_ranges(df: DataFrame) -> DataFrame:
    """The rows in ranges of repositories and paths, as an index has them."""
    return df.repartitionByRange("repo_id", *[c for c in ("path",) if c in df.columns]).sortWithinPartitions("repo_id")


def write_index(tables: dict[str, DataFrame], root: str, ranged: tuple[str, ...] = ()) -> None:
    """One Parquet table for each of INDEX_TABLES that is given, replaced whole. Rows lie in ranges of repositories, so a
    reader of one repository skips most files, and many small repositories share one. Those of the tables named in `ranged`
    do so already, having been made of narrower rows in ranges."""
    for name, df in tables.items():
        dealt = in_ranges(df) if "repo_id" in df.columns and name not in ranged else df
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A stored table; an empty frame of the schema if it isn't there."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, root: str, ordered: bool = False) -> DataFrame:
    """The columns that layouts need; in byte order of the path only where that is asked for."""
    rows = read_table(spark, root, "files").select("repo_id", "file_id", "path", "language", "bytes", "lines")
    return rows.orderBy("repo_id", "path") if ordered else rows


def meta_table(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted((values | {"schema_version": SCHEMA_VERSION}).items()), "key string, value string")


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """A catalog table in a database."""
    df.write.mode("overwrite").jdbc(url, table, properties=properties or {})


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, column: str | None = None, partitions: int = 16) -> DataFrame:
    """A catalog table from a database: one query, or with a number or time `column` one for each of `partitions` ranges
    between its least and greatest value. Rows in which it is null come with the first range."""
    properties = properties or {}
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = spark.read.jdbc(url, f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}) ends", properties=properties).first()
    if ends[0] is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=ends[0], upperBound=ends[1], numPartitions=partitions, properties=properties)
