"""What the queries on code do once, and the list forms that they use."""

import time

import pytest
from cartolith.operators import checks, evolution, extract, profile, textgrid, tree
from cartolith.plans import code
from pyspark.sql import functions as F


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = [(i, " ".join(f"word{'x' * (i % 4)} other {j} third" for j in range(i)), "en", f"src{i % 3}") for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_code_is_made_once(spark, sf_dir, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), code.code_files

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    monkeypatch.setattr(code, "code_files", lambda docs: real(docs).withColumn("content", seen("content")))
    assert code._code(spark, sf_dir).count() == made.value == 36


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_code_is_parsed_once(spark, sf_dir, monkeypatch):
    calls, real = [], extract.parse
    monkeypatch.setattr(extract, "parse", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert code.code_summary(spark, sf_dir).first().files == 36
    assert len(calls) == 1


def test_files_that_come_twice(spark):
    """Equal files are parsed once, and files of one path with other texts give each symbol once."""
    text, other = "def a(x):\n    return 1\n", "def a(x):\n    return 1\ndef b(x):\n    return 1\n"
    rows = [("r", "p.py", "Python", True, text), ("r", "p.py", "Python", True, text), ("r", "q.py", "Python", True, text)]
    files = spark.createDataFrame(rows, "repo_id string, path string, grammar string, parsed boolean, content string")
    once, single = extract.each_once(files)
    assert once.count() == 2 and single
    assert rows_of(extract.symbols(files), "path", "name") == [("p.py", "a"), ("q.py", "a")]
    more = files.unionByName(spark.createDataFrame([("r", "p.py", "Python", True, other)], files.schema))
    assert not extract.each_once(more)[1]
    assert rows_of(extract.symbols(more), "path", "name") == [("p.py", "a"), ("p.py", "b"), ("q.py", "a")]


SPANS = [("r", "p", [0, 4, 4, 9, 9, 3], [4, 2, 5, 3, 3, 1], [1, 2, 3, 5, 4, 6]), ("r", "q", [0, 5], [5, 6], [1, 2]), ("s", "p", [], [], [])]


def test_spans_in_lists(spark):
    lists = spark.createDataFrame(SPANS, "repo_id string, path string, starts array<int>, lens array<int>, classes array<tinyint>")
    columns = ["repo_id", "path", "start", "len", "cls"]
    flat = extract.spans(lists)
    assert rows_of(extract.spans(extract.longest_per_start(lists)), *columns) == rows_of(extract.one_per_start(flat), *columns)
    texts = spark.createDataFrame([("r", "p", "x" * 12), ("r", "q", "x" * 10), ("s", "p", "")], "repo_id string, path string, content string")
    single = extract.longest_per_start(lists)
    sized = single.join(texts.selectExpr("repo_id", "path", "length(content) as size"), ["repo_id", "path"])
    want = rows_of(checks.bad_spans(extract.spans(single), texts), *columns[:3])
    assert rows_of(checks.bad_spans_in_lists(sized), *columns[:3]) == want and len(want) > 1


def test_classes_in_lists(spark):
    rows = [(1, [0, 1, 4, 5, 9, 30], [0, 1, 0, 2], [1, 3, 0, 6], [1, 2, 3, 4]), (2, [0, 7], [], [], []), (3, [], [3], [2], [7])]
    lists = spark.createDataFrame(rows, "doc_id long, offs array<long>, gaps array<int>, lens array<int>, classes array<int>")
    starts = [(1, 0, 1, 1), (1, 2, 3, 2), (1, 7, 6, 4), (3, 3, 2, 7)]
    spans = spark.createDataFrame(starts, "doc_id long, start long, len long, cls int")
    got = rows_of(textgrid.classed_in_lists(lists), "doc_id", "off", "cls")
    assert got == rows_of(textgrid.classed_at(lists.select("doc_id", F.explode("offs").alias("off")), spans), "doc_id", "off", "cls")


def test_ids_of_lists(spark):
    rows = [(f"r{i % 2}", 1000 + i // 2, [f"{k:03}" for k in range(i % 5)]) for i in range(120)]
    lists = spark.createDataFrame(rows, "repo_id string, file_id long, names array<string>")
    want = tree.ids_in_order(lists.select("repo_id", "file_id", F.explode("names").alias("item")), ["file_id", "item"])
    assert rows_of(tree.ids_of_lists(lists, "names"), "repo_id", "file_id", "item", "id") == rows_of(want, "repo_id", "file_id", "item", "id")


def test_wide_blank_lines_take_no_time():
    began = time.monotonic()
    assert [d[1] for d in extract.definitions("class A {\n" + " " * 2000 + "\n}\n", "Java")] == ["A"]
    assert time.monotonic() - began < 5


def test_advisories_with_one_range(spark):
    """Advisories of one range meet the versions together; only those of several packages need a last distinct."""
    packages = spark.createDataFrame([("r", "p", "1.2.0"), ("r", "q", "3.0.0"), ("s", "p", "2.0.0"), ("r", "p", "1.3.0")], "repo_id string, package string, version string")
    imports = spark.createDataFrame([("r", "a.py", "p"), ("r", "a.py", "q"), ("r", "a.py", "p"), ("s", "b.py", "p")], "repo_id string, path string, module string")
    rows = [(1, "p", "1.0", "2.0"), (2, "p", "1.0", "2.0"), (3, "q", "2.0", None), (4, "p", "2.5", None), (5, "p", None, "9.0")]
    single = evolution.vulnerable(packages, spark.createDataFrame(rows, "advisory long, package string, introduced string, fixed string"), imports)
    assert rows_of(single, "repo_id", "path", "advisory") == [("r", "a.py", 1), ("r", "a.py", 2), ("r", "a.py", 3)]
    assert single._jdf.queryExecution().optimizedPlan().toString().startswith("Project")
    rows = [(1, "p", "1.0", None), (1, "q", "1.0", None)]
    several = evolution.vulnerable(packages, spark.createDataFrame(rows, "advisory long, package string, introduced string, fixed string"), imports)
    assert rows_of(several, "repo_id", "path", "advisory") == [("r", "a.py", 1), ("s", "b.py", 1)]


def written(monkeypatch):
    """The frames that the queries on code write out, as they do so."""
    frames, real = [], code.staged
    monkeypatch.setattr(code, "staged", lambda df: frames.append(df) or real(df))
    return frames


def test_texts_are_written_once_and_not_sorted(spark, sf_dir, monkeypatch):
    frames = written(monkeypatch)
    symbols = code.code_symbols(spark, sf_dir)
    assert [f.columns for f in frames] == [["repo_id", "doc_id", "path", "content"]]
    plan = symbols._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    # numbers are no words
    assert symbols.count() == 3 * sum(range(36))


def test_counts_from_lists(spark, sf_dir, monkeypatch):
    """An import that comes twice in a line, others of one line, calls that import nothing, and names that are empty."""
    js = "import a from 'm'; import b from 'n';\nconst x = require('y'), z = require('y'), w = other('y');\nfunction f() {}\n" + "require('')\n"
    rows = [("r", "a.js", "JavaScript", js), ("r", "b.py", "Python", "import os\nimport os\nclass A:\n  def f(self): pass\n"), ("s", "c.rb", "Ruby", "")]
    files = spark.createDataFrame(rows, "repo_id string, path string, grammar string, content string").withColumn("parsed", F.lit(True))
    parsed = extract.parse(files, spans=False)
    want = profile.counts_by_file(files.select("repo_id", "path"), extract.symbols(parsed), extract.imports(parsed))
    columns = ["repo_id", "path", "n_symbols", "n_imports"]
    assert rows_of(extract.list_counts(parsed), *columns) == rows_of(want, *columns) and want.agg(F.sum("n_imports")).first()[0] > 3
    frames = written(monkeypatch)
    assert code.counts_by_file(spark, sf_dir).count() == 36
    assert [f.columns for f in frames[1:]] == [columns]


def test_ids_are_given_to_sizes(spark, sf_dir, monkeypatch):
    """Texts are written out once, lists once, and files without either; the ids follow the paths and lines."""
    frames = written(monkeypatch)
    rows = code.symbol_ids(spark, sf_dir).collect()
    assert ["content" in f.columns for f in frames] == [True, False, False]
    assert dict(frames[1].dtypes)["symbols"] == "array<string>" and "symbols" not in frames[2].columns
    lines = {(s.repo_id, s.path, s.name): s.start_line for s in extract.symbols(code._kept_code(spark, sf_dir)).collect()}
    rows.sort(key=lambda r: (r.repo_id, r.id))
    order = [(r.repo_id, r.path.split("/"), lines[r.repo_id, r.path, r.name]) for r in rows]
    assert order == sorted(order) and len(rows) == len(lines)
    ids = {}
    for r in rows:
        ids.setdefault(r.repo_id, []).append(r.id)
    assert all(some == list(range(1, len(some) + 1)) for some in ids.values())


def test_packed_lists(spark):
    """As texts they are the same rows, with modules that hold white space and colons."""
    rows = [("r", "a.rs", "Rust", "use a::{b,\n  c};\nuse d;\nfn f() {\n}\nmod m {\n}\n"), ("r", "b.py", "Python", "import os\nimport os\n"), ("s", "c.rb", "Ruby", "")]
    files = spark.createDataFrame(rows, "repo_id string, path string, grammar string, content string").withColumn("parsed", F.lit(True))
    parsed = extract.parse(files, spans=False)
    lists = extract.packed(parsed)
    for got, want in ((extract.packed_symbols(lists), extract.symbols(parsed)), (extract.packed_imports(lists), extract.imports(parsed))):
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and want.count() > 1
