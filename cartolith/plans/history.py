"""Registered queries on commits, packages, claims, jobs and ignore rules made of the tables, and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cartolith.functions import columns as c
from cartolith.operators import catalog, checks, classify, evolution, ignore, incremental
from cartolith.plans.queries import CLASSIFIED, DIRS, FILES, HOSTS, _classified, _files, _indexed, _jobs, _table, query
from cartolith.sources import corpus
from cartolith.sources.storage import new_folder, staged

#: Lines of orders as changed files of commits.
COMMITS = """WITH commits AS (SELECT (l_suppkey % 10)::varchar AS repo_id, 'src/m' || (l_partkey % 20) || '/p' || l_partkey || '.py' AS path, l_orderkey AS commit, l_linestatus || l_suppkey AS author,
  l_shipdate AS day, l_quantity::bigint AS added, l_linenumber::bigint AS deleted, CASE WHEN l_returnflag = 'R' THEN 'fix' || chr(10) || 'Co-authored-by: b' ELSE 'fix' END AS message FROM lineitem)"""
SINCE = datetime.datetime(1996, 1, 1)


def _commits(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    path = F.concat(F.lit("src/m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/p"), part, F.lit(".py"))
    message = F.when(F.col("l_returnflag") == "R", "fix\nCo-authored-by: b").otherwise("fix")
    return rows.select(
        (F.col("l_suppkey") % 10).cast("string").alias("repo_id"), path.alias("path"), F.col("l_orderkey").alias("commit"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("author"),
        F.col("l_shipdate").alias("at"), F.round("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"), message.alias("message"),
    )


@query(COMMITS + " SELECT repo_id, path, count(DISTINCT commit) AS commits, sum(added + deleted)::bigint AS changed FROM commits WHERE day >= timestamp '1996-01-01' GROUP BY repo_id, path")
def churn(spark, sf_dir):
    return evolution.churn(_commits(spark, sf_dir), SINCE)


@query(COMMITS + " SELECT repo_id, path, date_diff('day', max(day)::date, date '2000-01-01') AS days FROM commits GROUP BY repo_id, path")
def file_age(spark, sf_dir):
    return evolution.age(_commits(spark, sf_dir), datetime.date(2000, 1, 1)).withColumn("days", F.col("days").cast("long"))


@query(COMMITS + " SELECT repo_id, path, sha256(author) AS owner FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY n DESC, author) AS r FROM (SELECT repo_id, path, author, count(DISTINCT commit) AS n FROM commits GROUP BY ALL)) WHERE r = 1")
def file_owner(spark, sf_dir):
    return evolution.owner(_commits(spark, sf_dir))


@query(COMMITS + " SELECT repo_id, path, round(avg((message LIKE '%Co-authored-by:%')::int), 6) AS agent FROM commits GROUP BY repo_id, path")
def agent_share(spark, sf_dir):
    return evolution.agent_share(_commits(spark, sf_dir)).withColumn("agent", F.round("agent", 6))


_UPLOAD = ", up AS (SELECT doc_id AS row, path, (doc_id % 17)::double AS value FROM classified UNION ALL SELECT doc_id + 1000000, path, -1 FROM classified UNION ALL SELECT doc_id, path || '.gone', 5 FROM classified)"


@query(FILES + _UPLOAD + " SELECT repo_id, file_id, path, value FROM files JOIN (SELECT path, arg_min(value, row) AS value FROM up WHERE row < 1000000 GROUP BY path) USING (path)")
def uploaded_layer(spark, sf_dir):
    """An upload that names each path twice, the second time behind its row limit, and paths that aren't there."""
    every = staged(_classified(spark, sf_dir).select("doc_id", "path"))
    up = every.select(F.col("doc_id").alias("row"), "path", (F.col("doc_id") % 17).cast("double").alias("value"))
    up = up.unionByName(every.select((F.col("doc_id") + 1_000_000).alias("row"), "path", F.lit(-1.0).alias("value"))).unionByName(every.select(F.col("doc_id").alias("row"), F.concat("path", F.lit(".gone")).alias("path"), F.lit(5.0).alias("value")))
    return evolution.custom_layer(up, _indexed(spark, sf_dir))


@query(FILES.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, e AS (SELECT a.repo_id, a.path AS src, b.path AS dst FROM files a JOIN files b ON a.repo_id = b.repo_id AND b.file_id IN (a.file_id * 2, a.file_id * 2 + 1)),
walk(repo_id, path, hops) AS (SELECT repo_id, path, 0 FROM files WHERE file_id = 1 UNION ALL SELECT e.repo_id, e.dst, hops + 1 FROM walk w JOIN e ON e.repo_id = w.repo_id AND e.src = w.path)
SELECT repo_id, path, min(hops) AS hops FROM walk GROUP BY repo_id, path""")
def reached_files(spark, sf_dir):
    """From each repository's first file over edges from n to 2n and 2n + 1."""
    files = _indexed(spark, sf_dir).select("repo_id", "file_id", "path")
    halves = files.select("repo_id", F.expr("file_id div 2").alias("file_id"), F.col("path").alias("dst"))
    edges = files.withColumnRenamed("path", "src").join(halves.hint("merge"), ["repo_id", "file_id"]).select("repo_id", "src", "dst")
    return evolution.reachable(staged(edges), files.where("file_id = 1"))


@query(FILES + " SELECT repo_id, path, (file_id - 3)::int AS hops FROM files WHERE file_id >= 3")
def chained_files(spark, sf_dir):
    """From each repository's third file over edges from each file to the next, and back to the first two."""
    files = _indexed(spark, sf_dir).select("repo_id", "file_id", "path")
    following = files.select("repo_id", (F.col("file_id") - 1).alias("file_id"), F.col("path").alias("dst"))
    edges = files.withColumnRenamed("path", "src").join(following.hint("merge"), ["repo_id", "file_id"])
    return evolution.reachable(staged(edges), files.where("file_id = 3"))


_MODULES = FILES + """,
targets AS (SELECT a.repo_id, a.path AS src, a.doc_id, p2 AS parts FROM files a JOIN (SELECT repo_id, doc_id, string_split(regexp_replace(path, '\\.[^./]*$', ''), '/') AS p2 FROM files) b ON b.repo_id = a.repo_id AND b.doc_id = a.doc_id + 20),
modules AS (SELECT repo_id, src, CASE WHEN doc_id % 3 = 0 THEN 'org/acme/' ELSE '' END || array_to_string(parts[-(doc_id % 4 + 1):], '/') AS module FROM targets),
stems AS (SELECT repo_id, path AS dst, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM files),
endings AS (SELECT DISTINCT repo_id, dst, array_to_string(s[-k:], '/') AS key FROM (SELECT repo_id, dst, string_split(stem, '/') AS s, unnest(range(1, len(string_split(stem, '/')) + 1)) AS k FROM stems)),
idx AS (SELECT repo_id, key, count(*) AS n, min(dst) AS dst FROM endings GROUP BY ALL),
exact AS (SELECT m.repo_id, src, module, min(dst) AS dst FROM modules m JOIN stems s ON s.repo_id = m.repo_id AND s.stem IN (module, regexp_replace(src, '[^/]*$', '') || module) WHERE src <> dst GROUP BY ALL),
rest AS (SELECT * FROM modules ANTI JOIN exact USING (repo_id, src, module)),
tried AS (SELECT repo_id, src, module, k, array_to_string(s[-k:], '/') AS key FROM (SELECT *, string_split(module, '/') AS s, unnest(range(1, len(string_split(module, '/')) + 1)) AS k FROM rest)),
longest AS (SELECT t.repo_id, src, n, dst FROM tried t JOIN idx USING (repo_id, key) QUALIFY row_number() OVER (PARTITION BY t.repo_id, src, module ORDER BY k DESC) = 1)"""


@query(_MODULES + " SELECT repo_id, src, dst, 'exact' AS confidence FROM exact UNION ALL SELECT repo_id, src, dst, 'heuristic' FROM longest WHERE n = 1 AND src <> dst")
def suffix_edges(spark, sf_dir):
    """Each file imports the one made of the document twenty further on by the last one to four components of its path,
    some behind a package that isn't there; names that several files have lead nowhere unless more of the path is given."""
    files = staged(_files(spark, sf_dir).select("repo_id", "doc_id", "path"))
    parts = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    targets = files.select("repo_id", (F.col("doc_id") - 20).alias("doc_id"), parts.alias("parts"))
    asked = (F.col("doc_id") % 4 + 1).cast("int")
    some = F.least(asked, F.size("parts"))
    module = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("org/acme/")).otherwise(F.lit("")), F.array_join(F.slice("parts", F.size("parts") - some + 1, some), "/"))
    imports = files.join(targets.hint("merge"), ["repo_id", "doc_id"]).select("repo_id", "path", module.alias("module"))
    return evolution.resolve_imports(imports, files.select("repo_id", "path"))


_PACKAGES = """WITH packages AS (SELECT DISTINCT (l_suppkey % 10)::varchar AS repo_id, 'p' || l_partkey % 50 AS package, l_linenumber || '.' || (l_quantity::int % 12) || '.' || (l_orderkey % 3) AS version, l_linenumber AS a, l_quantity::int % 12 AS b, l_orderkey % 3 AS c FROM lineitem),
advisories AS (SELECT DISTINCT p_partkey AS advisory, 'p' || p_partkey % 50 AS package, p_size % 5 + 1 AS a, p_size % 9 AS b FROM part),
imports AS (SELECT DISTINCT (l_suppkey % 10)::varchar AS repo_id, 'src/' || l_orderkey % 40 AS path, 'p' || l_partkey % 50 AS module FROM lineitem)"""


@query(_PACKAGES + """, hit AS (SELECT DISTINCT p.repo_id, p.package, advisory FROM packages p JOIN advisories v USING (package) WHERE (p.a, p.b, p.c) >= (v.a, v.b, 0) AND (p.a < v.a + 1 OR (p.a = v.a + 1 AND p.b < 5)))
SELECT DISTINCT i.repo_id, i.path, advisory FROM imports i JOIN hit h ON h.repo_id = i.repo_id AND h.package = i.module""")
def vulnerable_files(spark, sf_dir):
    """Packages and imports from the lines of orders, advisories for versions [a.b.0, (a + 1).5.0) from the parts."""
    lines, parts = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    repo, name = (F.col("l_suppkey") % 10).cast("string").alias("repo_id"), lambda k: F.concat(F.lit("p"), (F.col(k) % 50).cast("string"))
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.round("l_quantity").cast("int") % 12).cast("string"), (F.col("l_orderkey") % 3).cast("string"))
    packages = lines.select(repo, name("l_partkey").alias("package"), version.alias("version")).distinct()
    a, b = F.col("p_size") % 5 + 1, F.col("p_size") % 9
    advisories = parts.select(F.col("p_partkey").alias("advisory"), name("p_partkey").alias("package"), F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("0")).alias("introduced"), F.concat((a + 1).cast("string"), F.lit(".5.0")).alias("fixed"))
    imports = lines.select(repo, F.concat(F.lit("src/"), (F.col("l_orderkey") % 40).cast("string")).alias("path"), name("l_partkey").alias("module")).distinct()
    return evolution.vulnerable(packages, advisories, imports)


@query(CLASSIFIED + " SELECT repo_id, path, lines FROM classified WHERE bytes % 4 <> 0")
def reused_files(spark, sf_dir):
    """Rows of an earlier index stay where the file is the same; files whose size divides by four were others."""
    now = staged(_classified(spark, sf_dir).select("repo_id", "path", "bytes", "lines", "hash"))
    before = now.withColumn("hash", F.when(F.col("bytes") % 4 == 0, F.lit("")).otherwise(F.col("hash")))
    return evolution.reused_rows(now.select("repo_id", "path", "lines"), now, before)


@query(DIRS + " SELECT repo_id, dir, files, lines, bytes, weight, language FROM dirs JOIN dominant USING (repo_id, dir)")
def incremental_index(spark, sf_dir):
    """An index of an older corpus, in which some files differ, some aren't there yet and some have gone since, brought up
    to the corpus by two updates and put together."""
    files = staged(corpus.corpus_files(_table(spark, sf_dir, "documents")))
    size = F.length("content")
    older = files.where(size % 7 != 0).withColumn("content", F.when(size % 5 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")))
    gone = files.where(size % 11 == 0).withColumn("path", F.concat(F.lit("old/"), "path"))
    kept = lambda rows: classify.kept_files(classify.classify(rows))
    store = incremental.IndexStore(spark, new_folder(spark), buckets=8)
    store.create(kept(older.unionByName(gone)))
    now = staged(kept(files))
    store.apply(*incremental.changes(now.where("bytes % 2 = 0"), store.live("files").where("bytes % 2 = 0")))
    store.update(now)
    store.compact()
    return store.rollup().join(store.dominant().hint("merge"), ["repo_id", "dir"])


# ignore rules and paths


@query(CLASSIFIED + """ SELECT repo_id, path FROM classified WHERE NOT (path LIKE 'vendor/%' OR path LIKE '%/vendor/%' OR (path LIKE '%.md' AND path NOT LIKE '%/p1/%') OR starts_with(path, 'docs/') OR (starts_with(path, 'web/') AND regexp_matches(path, '/p[23]/')))""")
def unignored_files(spark, sf_dir):
    """The corpus with two ignore files in every repository."""
    files = staged(corpus.corpus_files(_table(spark, sf_dir, "documents")).select("repo_id", "path", F.lit("").alias("content")))
    repos = files.select("repo_id").distinct()
    texts = {".gitignore": "# rules\nvendor/\n*.md\n!**/p1/*.md\n/docs\n", "web/.gitignore": "p2/\np3/\n"}
    rules = None
    for path, text in texts.items():
        rows = repos.select("repo_id", F.lit(path).alias("path"), F.lit(text).alias("content"))
        rules = rows if rules is None else rules.unionByName(rows)
    return ignore.drop_ignored(files, ignore.ignore_rules(rules)).select("repo_id", "path")


#: Rule files of one repository each, by the number of its source, and the paths that they ignore, in SQL.
SHAPES = [
    ({".gitignore": "*.md\n"}, "suffix(path, '.md')"),
    ({".gitignore": "/docs\n"}, "starts_with(path, 'docs/')"),
    ({".gitignore": "Makefile/\nd[0-9]*/\n"}, "regexp_matches(path, '/d[0-9][^/]*/')"),
    ({".gitignore": "f[!1-4]*.py\n"}, "regexp_matches(path, '/f[^1-4/][^/]*\\.py$')"),
    ({".gitignore": "f\\*.py\n\\f*.rs\n"}, "regexp_matches(path, '/f[^/]*\\.rs$')"),
    ({".gitignore": "**/p1/**\n"}, "contains(path, '/p1/')"),
    ({".gitignore": "core/**/Makefile\n"}, "starts_with(path, 'core/') AND suffix(path, '/Makefile')"),
    ({".gitignore": "web/*/p2\n"}, "starts_with(path, 'web/') AND p[3] = 'p2'"),
    ({".gitignore": "*.md\n!**/p1/*.md\n"}, "suffix(path, '.md') AND p[3] <> 'p1'"),
    ({".gitignore": "vendor/\n!vendor/en/\n"}, "starts_with(path, 'vendor/')"),
    ({".gitignore": "/lib/*\n!/lib/en\n"}, "starts_with(path, 'lib/') AND p[2] <> 'en'"),
    ({".gitignore": "f????.c\n"}, "regexp_matches(path, '/f....\\.c$')"),
    ({".gitignore": "# *.rs\n\\#x\n   \n*.go  \n"}, "suffix(path, '.go')"),
    ({"tools/.gitignore": "*\n!*/\n!*.java\n"}, "starts_with(path, 'tools/') AND NOT suffix(path, '.java')"),
    ({".gitignore": "p[0-2]/\n"}, "p[3] IN ('p0', 'p1', 'p2')"),
    ({".gitignore": "f[\n*.ts[x]\n*.zig\\\n"}, "suffix(path, '.tsx')"),
    ({".gitignore": "docs/en/p[13]\n", "docs/.gitignore": "!en/\n!/en/p1\n"}, "regexp_matches(path, '^docs/en/p3/')"),
    ({".gitignore": "*\n!*/\n!f*[02468].*\n"}, "NOT regexp_matches(path, '/f[^/]*[02468]\\.[^/]*$')"),
    ({".git/info/exclude": "*.c\n*.zig\n", ".gitignore": "!*.c\n"}, "suffix(path, '.zig')"),
    ({".gitignore": "src/*/p?/f*.[jt]s*\n", "src/de/.gitignore": "!*.min.js\n"}, "regexp_matches(path, '^src/[^/]+/p./f[^/]*\\.[jt]s[^/]*$') AND NOT (starts_with(path, 'src/de/') AND suffix(path, '.min.js'))"),
]


@query(CLASSIFIED + " SELECT repo_id, path FROM classified WHERE NOT CASE substr(repo_id, 4)::int % 20 " + " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(SHAPES)) + " END")
def ignore_shapes(spark, sf_dir):
    """A rule file, or two, of another shape in each repository, over the whole corpus."""
    files = staged(corpus.corpus_files(_table(spark, sf_dir, "documents")).select("repo_id", "path"))
    number = F.regexp_extract("repo_id", "([0-9]+)$", 1).cast("int") % len(SHAPES)
    given = F.array(*[F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("content")) for path, text in texts.items()]) for texts, _ in SHAPES])
    rules = files.select("repo_id").distinct().select("repo_id", F.inline(F.get(given, number)))
    return ignore.drop_ignored(files, ignore.ignore_rules(rules)).select("repo_id", "path")


@query(corpus.CORPUS_SQL + " SELECT doc_id, path FROM corpus")
def slashed_paths(spark, sf_dir):
    """Paths with backslashes, as slashes again."""
    rows = corpus.corpus_files(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", c.slashes(F.translate("path", "/", "\\")).alias("path"))


@query("SELECT page_id, list_filter(list_transform(string_split(' ' || upper(url) || ' ,, b.ORG', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS hosts FROM pages")
def allowed_hosts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", c.allowlist(F.concat(F.lit(" "), F.upper("url"), F.lit(" ,, b.ORG"))).alias("hosts"))


# catalog


@query(catalog.JOBS_SQL + ", last AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) SELECT c_custkey AS repo_id, job_id, status FROM customer LEFT JOIN last ON repo_id = c_custkey AND r = 1")
def repos_with_latest(spark, sf_dir):
    repos = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"))
    return catalog.with_latest(repos, _jobs(spark, sf_dir)).select("repo_id", "job_id", "status")


@query(catalog.JOBS_SQL + """, d AS (SELECT repo_id, status, (epoch_us(lead(created_at) OVER (PARTITION BY repo_id ORDER BY created_at, job_id)) - epoch_us(created_at)) // 1000 AS ms FROM jobs),
s AS (SELECT repo_id, status, sum(ms)::bigint AS ms FROM d WHERE ms IS NOT NULL AND status IS NOT NULL GROUP BY repo_id, status) SELECT repo_id, string_agg(status || '=' || ms, ',' ORDER BY status) AS timings FROM s GROUP BY repo_id""")
def stage_timings(spark, sf_dir):
    """The map from stage to its whole time, as text."""
    rows = catalog.timings(_jobs(spark, sf_dir).where("status is not null"))
    return rows.select("repo_id", F.array_join(F.transform(F.map_entries("timings_ms"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("timings"))


@query(catalog.JOBS_SQL + " SELECT repo_id, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created FROM jobs GROUP BY repo_id")
def repos_newest_first(spark, sf_dir):
    repos = _jobs(spark, sf_dir).groupBy("repo_id").agg(F.min("created_at").alias("created_at"))
    return catalog.newest_repos(repos).select("repo_id", catalog.iso(F.col("created_at")).alias("created"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def claimed_twice(spark, sf_dir):
    return catalog.duplicates(_table(spark, sf_dir, "events"), "user_id")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def never_claimed(spark, sf_dir):
    return catalog.unclaimed(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), _table(spark, sf_dir, "events"), "user_id")


# integrity


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphan_lines(spark, sf_dir):
    """Lines whose part isn't among the larger ones."""
    lines = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return checks.orphans(lines, _table(spark, sf_dir, "part").where("p_size > 10"), ["p_partkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey % 10 AS k, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return checks.repeated(_table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("k")), ["l_orderkey", "k"])


@query("SELECT event_id FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'error')")
def unknown_types(spark, sf_dir):
    return checks.bad_values(_table(spark, sf_dir, "events"), "event_type", ["view", "error"]).select("event_id")


@query(CLASSIFIED + " SELECT count(*) AS n, true AS same FROM classified WHERE outcome = 'file'")
def equal_fingerprints(spark, sf_dir):
    """Two runs in different orders have one fingerprint; one with a changed row hasn't."""
    rows = _files(spark, sf_dir).select("repo_id", "path", "lines")
    one, two = checks.fingerprint(rows), checks.fingerprint(rows.repartition(7, "path")).toDF("n2", "mark2", "total2")
    other = checks.fingerprint(rows.withColumn("lines", F.col("lines") + 1)).toDF("n3", "mark3", "total3")
    both = one.crossJoin(two).crossJoin(other)  # one row each
    return both.select("n", ((F.col("mark") == F.col("mark2")) & (F.col("total") == F.col("total2")) & (F.col("total") != F.col("total3"))).alias("same"))
