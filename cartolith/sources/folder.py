"""Folders of files as a data source: planned partitions of directories, links never followed, hidden names seen."""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartolith.functions import tables as t
from cartolith.sources.storage import staged

#: Never entered or listed, whether a directory or a file that names one.
GIT = b".git"
LISTING = "path string, raw binary, length long, modified double, kind string"
#: Bytes of content that one Arrow batch holds, about.
BATCH_BYTES = 32 << 20


class LocalStore:
    """Directories that the driver and all tasks see under one path. What is a link isn't looked behind."""

    def entries(self, path: bytes) -> Iterator[tuple[bytes, bool, int, float]]:
        """(name, is a directory, length, time of change) of regular files and directories, by name; what can't be read,
        or is gone, isn't there."""
        try:
            with os.scandir(path) as found:
                every = sorted(found, key=lambda e: e.name)
        except OSError:
            return
        for e in every:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                yield e.name, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime

    def write(self, path: bytes, source) -> int:
        """A file with what source gives, in its place at once; its length."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = path + b".%d.part" % os.getpid()
        with open(part, "wb") as f:
            shutil.copyfileobj(source, f, 1 << 20)
            size = f.tell()
        os.replace(part, path)
        return size

    def open(self, path: bytes):
        """A regular file, opened without following a link in its place."""
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
        if not stat.S_ISREG(os.fstat(handle).st_mode):
            os.close(handle)
            raise OSError("not a regular file")
        return os.fdopen(handle, "rb")


class RemoteStore:
    """Object stores and distributed file systems by their URI; they have no links."""

    def __init__(self, files):
        self.files = files

    def entries(self, path: bytes) -> Iterator[tuple[bytes, bool, int, float]]:
        from pyarrow.fs import FileSelector, FileType

        try:
            every = sorted(self.files.get_file_info(FileSelector(path.decode())), key=lambda i: i.base_name)
        except OSError:
            return
        for i in every:
            if i.type in (FileType.File, FileType.Directory):
                yield i.base_name.encode(), i.type == FileType.Directory, i.size or 0, (i.mtime_ns or 0) / 1e9

    def write(self, path: bytes, source) -> int:
        self.files.create_dir(os.path.dirname(path.decode()), recursive=True)
        with self.files.open_output_stream(path.decode()) as f:  # an object is there once it is whole
            shutil.copyfileobj(source, f, 1 << 20)
            return f.tell()

    def open(self, path: bytes):
        return self.files.open_input_stream(path.decode())


def store_of(root: str) -> tuple[LocalStore | RemoteStore, bytes]:
    """The store of a root and the root's own path in it; the root itself may be a link."""
    if "://" in root and not root.startswith("file:"):
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(root)
        return RemoteStore(files), path.rstrip("/").encode()
    path = os.path.realpath(os.fsencode(root.removeprefix("file://").removeprefix("file:")))
    if not os.path.isdir(path):
        raise NotADirectoryError(root)
    return LocalStore(), path


@dataclass
class Split(InputPartition):
    """Directories to list, relative to the root: those in `deep` with all below them, those in `flat` by themselves."""

    deep: list[bytes]
    flat: list[bytes]


def join(a: bytes, b: bytes) -> bytes:
    return a + b"/" + b if a and b else a or b


class FolderReader(DataSourceReader):
    def __init__(self, root: str, splits: int, pruned: frozenset[bytes]):
        self.root, self.splits, self.pruned = root, splits, pruned

    def partitions(self) -> list[Split]:
        """Opens directories level by level, looking at directories only, until there are enough to deal."""
        store, root = store_of(self.root)
        todo, flat = deque([b""]), []
        while todo and len(todo) < self.splits and len(flat) < 16 * self.splits:
            at = todo.popleft()
            flat.append(at)
            todo.extend(join(at, name) for name, is_dir, *_ in store.entries(join(root, at)) if is_dir and name != GIT and name not in self.pruned)
        n = max(1, min(self.splits, len(todo) + len(flat)))
        return [Split(list(todo)[k::n], flat[k::n]) for k in range(n)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.root)
        rows: list[tuple] = []
        todo = [(d, False) for d in partition.flat] + [(d, True) for d in partition.deep]
        while todo:
            at, deep = todo.pop()
            for name, is_dir, size, changed in store.entries(join(root, at)):
                path = join(at, name)
                if name == GIT:
                    continue
                if is_dir and name in self.pruned:
                    rows.append((path, None, changed, "pruned"))
                elif is_dir:
                    if deep:
                        todo.append((path, True))
                else:
                    rows.append((path, size, changed, "file"))
            if len(rows) >= 4096:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        path, size, changed, kind = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([p.decode("utf-8", "replace") for p in path], pa.string()), pa.array(path, pa.binary()), pa.array(size, pa.int64()), pa.array(changed, pa.float64()), pa.array(kind, pa.string())], ["path", "raw", "length", "modified", "kind"])


class FolderSource(DataSource):
    """spark.read.format("folder").option("path", root): the regular files below root.

    Options: splits, the partitions to plan for (64), and prune, names of directories, divided by commas, which are listed
    once, as kind `pruned`, and not entered. path is relative and in UTF-8; raw is the name's bytes as they are.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        prune = frozenset(os.fsencode(x.strip()) for x in self.options.get("prune", "").split(",") if x.strip())
        return FolderReader(self.options["path"], int(self.options.get("splits", "64")), prune)


def read_listing(spark: SparkSession, root: str, splits: int = 64, prune: tuple[str, ...] = ()) -> DataFrame:
    """path, raw, length, modified, kind of what lies below root; see FolderSource. root must be a folder."""
    store_of(root)
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("path", root).option("splits", str(splits)).option("prune", ",".join(prune)).load()


def read_contents(listing: DataFrame, root: str, most: int = t.MAX_FILE_BYTES) -> DataFrame:
    """The files of a listing with path, bytes, content, hash and has_nul.

    Rows are dealt anew, so a directory with most files is read by all tasks. A file of more than `most` bytes isn't held:
    its content is null, and its hash and whether its first bytes have a NUL are taken in pieces; both are null for other
    files, whose content tells. A file that can't be read, or has become a link since, isn't there.
    """
    sniff = t.SNIFF_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        rows, held = [], 0

        def flush():
            path, size, content, digest, nul = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(content, pa.binary()), pa.array(digest, pa.string()), pa.array(nul, pa.bool_())], ["path", "bytes", "content", "hash", "has_nul"])

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                try:
                    with store.open(join(base, raw)) as f:
                        content = f.read(most + 1)
                        if len(content) <= most:
                            rows.append((path, len(content), content, None, None))
                            held += len(content)
                        else:
                            digest, size, nul = hashlib.sha256(content), len(content), b"\0" in content[:sniff]
                            while piece := f.read(1 << 20):
                                digest.update(piece)
                                size += len(piece)
                            rows.append((path, size, None, digest.hexdigest(), nul))
                except OSError:
                    continue
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    dealt = listing.where("kind = 'file'").select("path", "raw").repartition(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "path string, bytes long, content binary, hash string, has_nul boolean")


def scan_folder(spark: SparkSession, root: str, repo_id: str, content: bool = True, prune: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, path, bytes, and with content also content, hash and has_nul, of the regular files below root.

    Hidden files are seen, .git is left out at any depth, links are neither followed nor listed. Directories named in
    `prune` are not entered.
    """
    listed = read_listing(spark, root, prune=prune)
    if not content:
        return listed.where("kind = 'file'").select(F.lit(repo_id).alias("repo_id"), "path", F.col("length").alias("bytes"))
    return read_contents(listed, root).select(F.lit(repo_id).alias("repo_id"), "*")


def copy_folder(spark: SparkSession, root: str, target: str, at_once: int = 16) -> DataFrame:
    """Copy the regular files below root to target, `at_once` of them at a time; path and length of each, sorted.

    target is a folder that all tasks see, or a URI. A file that is copied twice, as its task was lost, is there once.
    """
    listed = read_listing(spark, root).where("kind = 'file'").select("path", "raw")
    if "://" not in target or target.startswith("file:"):
        os.makedirs(target.removeprefix("file://").removeprefix("file:"), exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (source, base), (sink, to) = store_of(root), store_of(target)
        for batch in batches:
            done = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                with source.open(join(base, raw)) as f:
                    done.append((path, sink.write(join(to, raw), f)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "length"])

    return staged(listed.repartition(at_once).mapInArrow(run, "path string, length long")).orderBy("path")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the regular files below root, sorted; contents aren't read."""
    return read_listing(spark, root).where("kind = 'file'").select("path", "length").orderBy("path")


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
