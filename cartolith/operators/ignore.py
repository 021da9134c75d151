"""Ignore rules: compiled globs in per-folder tables, decided folder by folder so that an ignored folder ends its subtree."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.operators.tree import parent_path
from cartolith.sources.storage import staged

#: Parts into which the entries that one chain of rule files decides are dealt.
SALTS = 32
_SPECIAL = re.compile(r"[*?\[\\]")


def glob_regex(glob: str) -> str | None:
    """A regular expression for the whole of a path, or None for a glob that matches nothing.

    `*` and `?` and classes stay within a component; `**` as a whole component stands for any number of them, at the end
    for everything inside; a backslash takes the next character as it is.
    """
    out, i, n = [], 0, len(glob)
    while i < n:
        ch = glob[i]
        if ch == "\\":
            if i + 1 == n:
                return None
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif ch == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            whole = j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/")
            if whole and j == n:
                out.append(".+")
            elif whole:
                out.append("(?:[^/]+/)*")
                j += 1
            else:
                out.append("[^/]*")
            i = j
        elif ch == "?":
            out.append("[^/]")
            i += 1
        elif ch == "[":
            found = _class(glob, i + 1)
            if found is None:
                return None
            text, i = found
            out.append(text)
        else:
            out.append(re.escape(ch))
            i += 1
    return "".join(out)


def _class(glob: str, i: int) -> tuple[str, int] | None:
    """The class that begins behind a bracket, and where the glob goes on; None if it doesn't end."""
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    parts, first = [], True
    while i < len(glob) and (first or glob[i] != "]"):
        first = False
        if glob[i] == "\\":
            i += 1
            if i == len(glob):
                return None
        low = glob[i]
        i += 1
        if glob[i : i + 1] == "-" and glob[i + 1 : i + 2] not in ("", "]"):
            i += 1
            if glob[i] == "\\":
                i += 1
                if i == len(glob):
                    return None
            high = glob[i]
            i += 1
            if low <= high:
                parts.append(f"{re.escape(low)}-{re.escape(high)}")
        else:
            parts.append(re.escape(low))
    if i >= len(glob):
        return None
    if not parts:  # ranges that run backwards hold nothing
        return ("[^/]" if negated else r"(?!)"), i + 1
    return f"(?!/)[{'^' if negated else ''}{''.join(parts)}]", i + 1


class RuleTable:
    """The rules of one folder, by what finds them: a name, a path, a name's ending, or an expression. Of the rules that
    match, the last counts."""

    def __init__(self, text: str):
        self.negated: list[bool] = []
        self.names: dict[str, list[int]] = {}
        self.paths: dict[str, list[int]] = {}
        self.endings: dict[int, dict[str, list[int]]] = {}
        self.others: list[tuple[int, bool, bool, re.Pattern]] = []  # number, for directories only, of the name, pattern
        for line in re.split(r"\r?\n", text):
            self._add(line)
        self.others.reverse()

    def _add(self, line: str) -> None:
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            return
        negated = line.startswith("!")
        line = line[negated:]
        dirs = line.endswith("/") and not line.endswith("\\/")
        line = line[: len(line) - dirs]
        anchored = "/" in line
        line = line.removeprefix("/")
        if not line:
            return
        number = len(self.negated)
        plain = not _SPECIAL.search(line)
        regex = None if plain else glob_regex(line)
        if not plain and regex is None:
            return
        self.negated.append(negated)
        if plain:
            slot = (self.paths if anchored else self.names).setdefault(line, [-1, -1])
        elif not anchored and line[0] == "*" and not _SPECIAL.search(line[1:]):
            slot = self.endings.setdefault(len(line) - 1, {}).setdefault(line[1:], [-1, -1])
        else:
            self.others.append((number, dirs, not anchored, re.compile(regex, re.S)))
            return
        slot[1] = number
        if not dirs:
            slot[0] = number

    def last(self, path: str, name: str, is_dir: bool) -> int:
        """The number of the last rule that matches a path below the folder, or -1."""
        best = -1
        for found in (self.names.get(name), self.paths.get(path), *[table.get(name[len(name) - n :]) for n, table in self.endings.items() if len(name) >= n]):
            if found and found[is_dir] > best:
                best = found[is_dir]
        for number, dirs, of_name, pattern in self.others:
            if number < best:
                break
            if (is_dir or not dirs) and pattern.fullmatch(name if of_name else path):
                return number
        return best


@functools.lru_cache(maxsize=4096)
def rule_table(text: str) -> RuleTable:
    return RuleTable(text)


def is_ignored(chain: list[tuple[str, str]], path: str, is_dir: bool) -> bool:
    """Whether the rule files (base, text) of the folders above a path, outermost first, ignore it itself. The deepest
    folder with a rule that matches decides."""
    name = path.rsplit("/", 1)[-1]
    for base, text in reversed(chain):
        table = rule_table(text)
        if (k := table.last(path[len(base) + 1 if base else 0 :], name, is_dir)) >= 0:
            return not table.negated[k]
    return False


def ignore_rules(files: DataFrame) -> DataFrame:
    """repo_id, base, text of the rule files in files(repo_id, path, content): .gitignore in each folder (base, empty for
    the root) and .git/info/exclude, whose rules come before those of the root's own file."""
    name = c.file_name(F.col("path"))
    rows = files.where((name == ".gitignore") | (F.col("path") == ".git/info/exclude"))
    own = F.col("path") != ".git/info/exclude"
    base = F.when(own, F.regexp_replace("path", r"/?\.gitignore$", "")).otherwise(F.lit(""))
    rows = rows.select("repo_id", base.alias("base"), F.struct(own.alias("own"), F.col("content").cast("string").alias("text")).alias("r"))
    return rows.groupBy("repo_id", "base").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n").alias("text"))


def _folders(path) -> Column:
    """A folder's path and those above it, the root (empty) first."""
    p = c.parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))


def decided(entries: DataFrame, chains: DataFrame) -> DataFrame:
    """repo_id, path of the entries(repo_id, bases, path, is_dir) that the rule files of their chain ignore.

    chains: repo_id, bases, rules (base and text of each). Each chain stands once before the entries that it decides, in
    each of the parts into which they are dealt, so rules aren't copied to every entry and no repository is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list = []
        for batch in batches:
            repos, paths, dirs, rules = (batch.column(x).to_pylist() for x in ("repo_id", "path", "is_dir", "rules"))
            out = []
            for repo, path, is_dir, given in zip(repos, paths, dirs, rules, strict=True):
                if path is None:
                    chain = [(g["base"], g["text"]) for g in given]
                elif is_ignored(chain, path, is_dir):
                    out.append((repo, path))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["repo_id", "path"])

    heads = chains.select("repo_id", "bases", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("is_dir"), "rules")
    rows = entries.select("repo_id", "bases", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), "path", "is_dir", F.lit(None).cast(dict(chains.dtypes)["rules"]).alias("rules"))
    dealt = heads.unionByName(rows).repartition("repo_id", "bases", "salt").sortWithinPartitions("repo_id", "bases", "salt", F.asc_nulls_first("path"))
    return dealt.mapInArrow(run, "repo_id string, path string")


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files without the ignored ones. rules: see ignore_rules.

    First the folders are decided, which are far fewer than the files; what lies below an ignored folder is gone whatever
    other rules say. Then the files of the folders that are left. A folder's chain is the list of the rule files above
    it; folders share chains, and each chain's texts are put together once.
    """
    rules = staged(rules)
    folders = files.select("repo_id", parent_path(F.col("path")).alias("dir")).distinct()
    folders = staged(folders.select("repo_id", F.explode(_folders(F.col("dir"))).alias("dir")).distinct())
    above = folders.select("repo_id", "dir", F.explode(_folders(F.col("dir"))).alias("base"))
    based = above.join(rules.select("repo_id", "base").hint("merge"), ["repo_id", "base"]).groupBy("repo_id", "dir").agg(F.array_sort(F.collect_list("base")).alias("bases"))
    based = staged(based)
    wanted = based.select("repo_id", "bases").distinct().select("repo_id", "bases", F.explode("bases").alias("base"))
    chains = wanted.join(rules.hint("merge"), ["repo_id", "base"]).groupBy("repo_id", "bases").agg(F.array_sort(F.collect_list(F.struct("base", "text"))).alias("rules"))
    chains = staged(chains)
    inner = folders.where("dir <> ''").select("repo_id", F.col("dir").alias("path"), parent_path(F.col("dir")).alias("dir"), F.lit(True).alias("is_dir"))
    gone = decided(inner.join(based.hint("merge"), ["repo_id", "dir"]), chains).withColumnRenamed("path", "base")
    gone = staged(above.join(gone.hint("merge"), ["repo_id", "base"], "left_semi").select("repo_id", "dir").distinct())
    left = files.withColumn("__dir", parent_path(F.col("path"))).join(gone.withColumnRenamed("dir", "__dir").hint("merge"), ["repo_id", "__dir"], "left_anti")
    own = left.select("repo_id", "path", F.col("__dir").alias("dir"), F.lit(False).alias("is_dir")).distinct()
    dropped = decided(own.join(based.hint("merge"), ["repo_id", "dir"]), chains).distinct()
    return left.join(dropped.hint("merge"), ["repo_id", "path"], "left_anti").select(*files.columns)
