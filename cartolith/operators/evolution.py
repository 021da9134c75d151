"""Value layers from commits, uploads and imports, and incremental indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.sources.storage import staged


def churn(commits: DataFrame, since=None) -> DataFrame:
    """Per file its commits and changed lines. commits: repo_id, path, commit, author, at, added, deleted, message."""
    rows = commits if since is None else commits.where(F.col("at") >= F.lit(since))
    return rows.groupBy("repo_id", "path").agg(F.countDistinct("commit").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("changed"))


def age(commits: DataFrame, as_of) -> DataFrame:
    return commits.groupBy("repo_id", "path").agg(F.datediff(F.lit(as_of), F.max("at")).alias("days"))


def owner(commits: DataFrame) -> DataFrame:
    """The author with most commits, hashed."""
    n = commits.groupBy("repo_id", "path", "author").agg(F.countDistinct("commit").alias("n"))
    return n.groupBy("repo_id", "path").agg(F.sha2(F.min_by("author", F.struct(-F.col("n"), F.col("author"))), 256).alias("owner"))


def agent_share(commits: DataFrame) -> DataFrame:
    """The share of a file's commits with a co-author trailer."""
    return commits.groupBy("repo_id", "path").agg(F.avg(F.col("message").rlike(r"(?im)^co-authored-by:").cast("double")).alias("agent"))


def custom_layer(values: DataFrame, files: DataFrame, most: int = 1_000_000) -> DataFrame:
    """An upload's values(row, path, value) for known files: its first `most` rows, and of a path given twice the first."""
    given = values.where(F.col("row") < most).groupBy("path").agg(F.min_by("value", "row").alias("value"))
    return files.join(given.hint("merge"), "path").select("repo_id", "file_id", "path", "value")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def _endings(path: Column, most: int) -> Column:
    """A path's last one, two, ... components, at most `most`."""
    p = c.parts(path)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(most))), lambda i: F.array_join(F.slice(p, F.size(p) - i + 1, i), "/"))


def suffix_index(files: DataFrame, most: int = 8) -> DataFrame:
    """repo_id, key, n, dst: of every ending of the files' paths, without extension and without a last index, mod or
    __init__, how many files have it, and one of them. A row for each component at most, and one for each ending after."""
    stem = _stem(F.col("path"))
    forms = F.array_distinct(F.array(stem, F.regexp_replace(stem, r"/(index|mod|__init__)$", "")))
    keys = files.select("repo_id", F.col("path").alias("dst"), F.explode(F.array_distinct(F.flatten(F.transform(forms, lambda f: _endings(f, most))))).alias("key"))
    return keys.groupBy("repo_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))


def resolve_imports(imports: DataFrame, files: DataFrame, most: int = 8) -> DataFrame:
    """repo_id, src, dst, confidence: exact for a path (relative or whole), heuristic for a unique path ending.

    imports: repo_id, path, module. Modules are tried as given, beside the importing file, and with dots as slashes, those
    that begin with ./ or ../ only from the importing file's folder. Where
    no path is exact, the longest ending of the module, of at most `most` components, that ends any file's path is taken
    if it ends one only. Endings are looked up once for each module of a repository, however many files import it.
    """
    known = files.select("repo_id", F.col("path").alias("dst"))
    stem = _stem(F.col("dst"))
    keys = known.select("repo_id", "dst", F.explode(F.array_distinct(F.array("dst", stem, F.regexp_replace(stem, r"/(index|mod|__init__)$", "")))).alias("key"))
    here = F.regexp_replace("path", r"[^/]*$", "")
    tidy = F.regexp_replace(F.regexp_replace("module", r"^(\.\.?/)+", ""), r"^(crate|self|super)::", "")
    beside = F.regexp_replace(F.regexp_replace("module", r"^(\./)+", ""), r"^(crate|self)::", "")
    slashed = F.regexp_replace(F.regexp_replace(beside, "::", "/"), r"(?<=\w)\.(?=\w)", "/")
    up = F.length(F.regexp_extract("module", r"^(?:\./)*((?:\.\./)*)", 1)) / 3
    folders = c.parts(here)
    above = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - up.cast("int"), F.lit(0))), "/")
    relative = F.concat_ws("/", F.nullif(above, F.lit("")), F.regexp_replace("module", r"^(\.\.?/)+", ""))
    tries = F.when(F.col("module").rlike(r"^\.\.?/"), F.array(relative)).otherwise(F.array_distinct(F.array(F.concat(here, beside), beside, slashed, F.concat(here, slashed))))
    exact = imports.select("repo_id", F.col("path").alias("src"), "module", F.explode(tries).alias("key")).join(keys.hint("merge"), ["repo_id", "key"]).select("repo_id", "src", "module", "dst")
    exact = exact.where("src <> dst").groupBy("repo_id", "src", "module").agg(F.min("dst").alias("dst"))
    exact = staged(exact)
    left = imports.select("repo_id", F.col("path").alias("src"), "module").join(exact.select("repo_id", "src", "module").hint("merge"), ["repo_id", "src", "module"], "left_anti")
    path = F.regexp_replace(tidy, "::", "/")
    path = F.when(F.contains(path, F.lit("/")), path).otherwise(F.regexp_replace(path, r"\.", "/"))
    asked = left.select("repo_id", "module").distinct().select("repo_id", "module", F.posexplode(_endings(path, most)).alias("size", "key"))
    found = asked.join(suffix_index(files, most).hint("merge"), ["repo_id", "key"])
    longest = found.groupBy("repo_id", "module").agg(F.max(F.struct("size", "n", "dst")).alias("f")).where("f.n = 1")
    guess = left.join(longest.select("repo_id", "module", "f.dst").hint("merge"), ["repo_id", "module"]).where("src <> dst")
    both = exact.withColumn("confidence", F.lit("exact")).unionByName(guess.select("repo_id", "src", "module", "dst", F.lit("heuristic").alias("confidence")))
    return both.groupBy("repo_id", "src", "dst").agg(F.min("confidence").alias("confidence"))


def bundle_edges(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """Edges between the nodes that are drawn at each zoom: edges(repo_id, src_path, dst_path) summed by the visible
    ancestors (or selves) of both ends. cut: visible nodes (repo_id, z, id, path)."""
    p = lambda name: F.transform(F.sequence(F.lit(1), F.size(F.split(name, "/"))), lambda i: F.array_join(F.slice(F.split(name, "/"), F.lit(1), i), "/"))
    ends = ["repo_id", "src_path", "dst_path"]
    counted = edges.groupBy(*ends).agg(F.count(F.lit(1)).alias("n"))
    shown = cut.select("repo_id", "z", "id", "path").hint("merge")
    src = counted.select("*", F.explode(p("src_path")).alias("path")).join(shown, ["repo_id", "path"]).select(*ends, "z", "n", F.col("id").alias("src_id"))
    dst = counted.select(*ends, F.explode(p("dst_path")).alias("path")).join(shown, ["repo_id", "path"]).select(*ends, "z", F.col("id").alias("dst_id"))
    both = src.join(dst.hint("merge"), [*ends, "z"]).where("src_id <> dst_id")
    return both.groupBy("repo_id", "z", "src_id", "dst_id").agg(F.sum("n").alias("n"))


def contracted(edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(repo_id, path, dst) with chains as one edge each: (repo_id, path, dst, hops), and the nodes inside chains with
    the node before their chain and their hops from it.

    A node with one way in and one way out that is no entry is inside a chain. Each looks at the node before it; in every
    round it looks as far again as the one it sees, so a chain of n nodes takes log n rounds. What never sees a chain's
    beginning lies on a circle without a way in, and is dropped.
    """
    node = ["repo_id", "path"]
    ways_in = edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("before")).where("n = 1")
    ways_out = edges.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*node)
    inside = ways_in.join(ways_out.hint("merge"), node, "left_semi").join(entries.select(*node).hint("merge"), node, "left_anti")
    inside = inside.select(*node, "before", F.lit(1).cast("long").alias("hops"))
    names = inside.select("repo_id", F.col("path").alias("before"), F.lit(True).alias("__in"))
    # open: the node before is inside a chain as well
    inside = staged(inside.join(names.hint("merge"), ["repo_id", "before"], "left").withColumn("open", F.coalesce("__in", F.lit(False))).drop("__in"))
    now, done = inside.where("open"), [staged(inside.where("not open"))]
    left = now.count()
    while left:
        every = now
        for d in done:
            every = every.unionByName(d)
        # a node is open still if the one that it sees is, so a round is one join
        ahead = every.select("repo_id", F.col("path").alias("before"), F.col("before").alias("__far"), F.col("hops").alias("__more"), F.col("open").alias("__open"))
        moved = now.drop("open").join(ahead.hint("merge"), ["repo_id", "before"])
        moved = staged(moved.select(*node, F.col("__far").alias("before"), (F.col("hops") + F.col("__more")).alias("hops"), F.col("__open").alias("open")))
        now = moved.where("open")
        if (still := now.count()) == left:  # only circles are left
            break
        done.append(staged(moved.where("not open")))  # read in every round that follows
        left = still
    chains = done[0]
    for d in done[1:]:
        chains = chains.unionByName(d)
    chains = staged(chains.drop("open"))
    ends = edges.withColumnRenamed("dst", "__dst").join(inside.select("repo_id", F.col("path").alias("__dst")).hint("merge"), ["repo_id", "__dst"], "left_anti")
    out = ends.join(chains.hint("merge"), node, "left").join(now.select(*node).hint("merge"), node, "left_anti")
    out = out.select("repo_id", F.coalesce("before", "path").alias("path"), F.col("__dst").alias("dst"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
    return out.groupBy("repo_id", "path", "dst").agg(F.min("hops").alias("hops")), chains


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """repo_id, path, hops of all files that the entry points reach, by the shortest way.

    Chains are one edge each (see contracted). Then rounds of joins take the nodes whose hops have become fewer one edge
    further, until there are none; what has been reached is one table, written anew in each round.
    """
    node = ["repo_id", "path"]
    steps = staged(edges.select("repo_id", F.col("src").alias("path"), "dst").where("path <> dst").distinct())
    begin = staged(entries.select(*node).distinct())
    short, chains = contracted(steps, begin)
    short = staged(short)
    seen = front = staged(begin.withColumn("hops", F.lit(0).cast("long")))
    while not front.isEmpty():
        nxt = front.join(short.withColumnRenamed("hops", "__far").hint("merge"), node).groupBy("repo_id", F.col("dst").alias("path")).agg(F.min(F.col("hops") + F.col("__far")).alias("hops"))
        better = nxt.join(seen.withColumnRenamed("hops", "__had").hint("merge"), node, "left").where("__had is null or hops < __had").drop("__had")
        front = staged(better)
        seen = staged(seen.unionByName(front).groupBy(*node).agg(F.min("hops").alias("hops")))
    inner = chains.withColumnRenamed("path", "__path").withColumnRenamed("hops", "__far").join(seen.withColumnRenamed("path", "before").hint("merge"), ["repo_id", "before"])
    inner = inner.select("repo_id", F.col("__path").alias("path"), (F.col("hops") + F.col("__far")).alias("hops"))
    return seen.unionByName(inner).groupBy(*node).agg(F.min("hops").cast("int").alias("hops"))


def version_key(version):
    """A version as an array in whose order versions stand: numbers by value, and words (rc, alpha) before the release."""
    part = lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), F.try_to_number(x, F.lit("999999999999")).cast("long")).otherwise(F.lit(-2).cast("long")).alias("n"), F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("s"))
    pieces = F.filter(F.split(F.regexp_replace(F.lower(version), r"(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", "."), r"[.\-_]"), lambda x: x != "")
    return F.concat(F.transform(pieces, part), F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit("").alias("s"))))


def vulnerable(packages: DataFrame, advisories: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that import a package with a version inside an advisory's range [introduced, fixed)."""
    key = lambda name: version_key(F.regexp_replace(name, r"\+.*$", ""))
    # versions meet each different range of a package once, however many advisories have it
    bounds = ["package", "introduced", "fixed"]
    versions = packages.select("repo_id", "package", "version").distinct().withColumn("__v", key("version"))
    ranges = advisories.select(*bounds).distinct().withColumns({"__from": key("introduced"), "__to": F.when(F.col("fixed").isNotNull(), key("fixed"))})
    hit = versions.join(ranges.hint("merge"), "package").where((F.col("__v") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("__v") < F.col("__to"))))
    hit = hit.select("repo_id", *bounds).distinct()
    same = hit["package"].eqNullSafe(advisories["package"]) & hit["introduced"].eqNullSafe(advisories["introduced"]) & hit["fixed"].eqNullSafe(advisories["fixed"])
    # an advisory of one package meets a file once for each import of it; only those of several packages may meet it again
    several = advisories.groupBy("advisory").agg(F.min("package").alias("a"), F.max("package").alias("b")).where("a <> b").select("advisory")
    found = advisories.hint("merge").join(hit, same).select("repo_id", advisories["package"].alias("module"), "advisory").distinct()
    asked = imports.select("repo_id", "path", "module").distinct()
    out = found.join(asked.hint("merge"), ["repo_id", "module"]).select("repo_id", "path", "advisory")
    return out if several.isEmpty() else out.distinct()


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose path or hash is new: what an incremental run has to index."""
    return now.join(before.select("repo_id", "path", "hash"), ["repo_id", "path", "hash"], "left_anti")


def reused_rows(rows: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of an earlier index (symbols, imports, ...) whose files haven't changed."""
    same = now.select("repo_id", "path", "hash").join(before.select("repo_id", "path", "hash"), ["repo_id", "path", "hash"], "left_semi").select("repo_id", "path")
    return rows.join(same.hint("merge"), ["repo_id", "path"], "left_semi")
