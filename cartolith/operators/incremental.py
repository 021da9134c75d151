"""An index that is kept up by deltas: only changed files are extracted again, and sums follow by signed differences.

Every table lies in versions. A version holds the rows of the files that it touched, and for directories what they add to
or take from sums and from the weights of languages. What is live is read from all versions since the last base; a
version counts once it is committed, so one that was written in part is written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import extract, tree
from cartolith.sources.storage import staged

FILES = ["repo_id", "path", "hash", "language", "bytes", "lines", "parsed"]
SUMS = ["files", "lines", "bytes", "weight"]
COMMITS = "version int, base boolean"
SCHEMAS = {
    "files": "repo_id string, path string, hash string, language string, bytes long, lines long, parsed boolean, version int, bucket int",
    "parsed": f"repo_id string, path string, content string, {extract.PARSED}, grammar string, version int, bucket int",
    "touched": "repo_id string, path string, version int, bucket int",
    "sums": "repo_id string, dir string, files long, lines long, bytes long, weight long, version int",
    "langs": "repo_id string, dir string, language string, weight long, version int",
}


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_id", "path"), F.lit(buckets)).cast("int")


def changes(now: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of now whose path or hash is new, and repo_id, path of the live files that are gone."""
    changed = now.join(live.select("repo_id", "path", "hash").hint("merge"), ["repo_id", "path", "hash"], "left_anti")
    gone = live.select("repo_id", "path").join(now.select("repo_id", "path").hint("merge"), ["repo_id", "path"], "left_anti")
    return changed, gone


def signed_sums(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By directory what rows(repo_id, path, language, bytes, lines, sign) add to its sums, and by language to its weight."""
    up = tree.closure(rows.withColumn("weight", F.greatest("lines", F.lit(1))))
    total = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    sums = up.groupBy("repo_id", "dir").agg(F.sum("sign").alias("files"), total("lines"), total("bytes"), total("weight"))
    langs = up.groupBy("repo_id", "dir", "language").agg(total("weight"))
    moved = F.lit(False)
    for c in SUMS:
        moved = moved | (F.col(c) != 0)
    return sums.where(moved), langs.where("weight <> 0")


@dataclass
class IndexStore:
    """The versions below a root: files, parsed, sums, langs, touched and commits.

    Files and what was parsed of them lie in buckets by their path, as partitions: an update reads the buckets that it
    touches, and no others.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException:
            return self.spark.range(0).select(F.lit(0).alias("version"), F.lit(True).alias("base"))

    def versions(self) -> tuple[int, int]:
        """The last base and the last version; (-1, -1) for a store that is empty."""
        row = self._commits().agg(F.max(F.when(F.col("base"), F.col("version"))), F.max("version")).first()
        return (-1, -1) if row[1] is None else (row[0], row[1])

    def _table(self, name: str) -> DataFrame:
        base, last = self.versions()
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}").where(F.col("version").between(base, last))

    def live(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The live rows of `files` or `parsed`, of all buckets or the given ones."""
        base, _ = self.versions()
        rows, touched = self._table(name), self._table("touched")
        if only is not None:
            rows, touched = rows.where(F.col("bucket").isin(only)), touched.where(F.col("bucket").isin(only))
        last = touched.groupBy("repo_id", "path").agg(F.max("version").alias("__last"))
        rows = rows.join(last.hint("merge"), ["repo_id", "path"], "left").where(F.coalesce("__last", F.lit(base)) == F.col("version"))
        return rows.drop("__last", "version", "bucket")

    def rollup(self) -> DataFrame:
        """repo_id, dir, files, lines, bytes, weight of every directory that has files."""
        rows = self._table("sums").groupBy("repo_id", "dir").agg(*[F.sum(c).alias(c) for c in SUMS])
        return rows.where("files > 0")

    def dominant(self) -> DataFrame:
        """repo_id, dir, language: the language with the largest weight, by name where equal."""
        rows = self._table("langs").groupBy("repo_id", "dir", "language").agg(F.sum("weight").alias("w")).where("w > 0")
        return rows.groupBy("repo_id", "dir").agg(F.min_by("language", F.struct(-F.col("w"), F.col("language"))).alias("language"))

    def symbols(self) -> DataFrame:
        return extract.symbols(self.live("parsed"))

    def imports(self) -> DataFrame:
        return extract.imports(self.live("parsed"))

    def _write(self, rows: DataFrame, name: str, version: int, in_buckets: bool) -> None:
        target = f"{self.root}/{name}/version={version}"
        if in_buckets:
            # however few buckets there are, each is cut into parts of one size, which many tasks write and read
            dealt = rows.withColumn("bucket", bucket_of(self.buckets)).hint("rebalance", F.col("bucket"))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
        else:
            rows.write.mode("overwrite").parquet(target)

    def _commit(self, version: int, base: bool) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.lit(base).alias("base")).write.mode("append").parquet(f"{self.root}/commits")

    def create(self, files: DataFrame, spans: bool = False) -> None:
        """A base of files: kept files of `classify`, with content and grammar."""
        version = self.versions()[1] + 1
        files = staged(files)
        sums, langs = signed_sums(files.select("repo_id", "path", "language", "bytes", "lines", F.lit(1).alias("sign")))
        self._write(files.select(*FILES), "files", version, True)
        self._write(extract.parse(files, spans), "parsed", version, True)
        self._write(files.select("repo_id", "path").limit(0), "touched", version, True)
        self._write(sums, "sums", version, False)
        self._write(langs, "langs", version, False)
        self._commit(version, True)

    def update(self, now: DataFrame, spans: bool = False) -> int:
        """Bring the store to `now`, all kept files of the corpus; returns how many paths it touched. Of what is live only
        paths and hashes are read to find the changes."""
        return self.apply(*changes(now, self.live("files")), spans=spans)

    def apply(self, changed: DataFrame, removed: DataFrame, spans: bool = False) -> int:
        """Write a version with the new or changed files, and without the removed paths (repo_id, path).

        Reads and work follow the change: the changed files are extracted, the buckets they lie in are read for what the
        files were before, and the directories above them get signed sums.
        """
        version = self.versions()[1] + 1
        changed = staged(changed.select(*FILES, "grammar", "content"))
        touched = changed.select("repo_id", "path").unionByName(removed.select("repo_id", "path")).distinct().withColumn("bucket", bucket_of(self.buckets))
        touched = staged(touched)
        paths, buckets = touched.agg(F.count(F.lit(1)), F.collect_set("bucket")).first()  # numbers below self.buckets
        if not paths:
            return 0
        old = self.live("files", sorted(buckets)).join(touched.drop("bucket").hint("merge"), ["repo_id", "path"], "left_semi")
        plain = ["repo_id", "path", "language", "bytes", "lines"]
        rows = staged(changed.select(*plain, F.lit(1).alias("sign")).unionByName(old.select(*plain, F.lit(-1).alias("sign"))))
        sums, langs = signed_sums(rows)
        self._write(changed.select(*FILES), "files", version, True)
        self._write(extract.parse(changed, spans), "parsed", version, True)
        self._write(touched.drop("bucket"), "touched", version, True)
        self._write(sums, "sums", version, False)
        self._write(langs, "langs", version, False)
        self._commit(version, False)
        return paths

    def compact(self) -> None:
        """All that is live as a new base; older versions aren't read from then on."""
        version = self.versions()[1] + 1
        for name in ("files", "parsed"):
            self._write(self.live(name), name, version, True)
        self._write(self.live("files").select("repo_id", "path").limit(0), "touched", version, True)
        self._write(self.rollup(), "sums", version, False)
        self._write(self._table("langs").groupBy("repo_id", "dir", "language").agg(F.sum("weight").alias("weight")).where("weight > 0"), "langs", version, False)
        self._commit(version, True)
