import hashlib
import os

import pyarrow.fs
import pytest
from cartolith.operators import classify, ignore
from cartolith.sources import corpus, folder


def put(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def test_links_are_never_followed(spark, tmp_path):
    """Neither a link to a file nor one to a directory outside the root, inside it or to nowhere gives a row."""
    put(tmp_path / "outside", {"secret.txt": "TOP SECRET", "dir/hidden.rs": "fn hidden() {}"})
    put(tmp_path / "root", {"ok.rs": "fn ok() {}\n", "a/b.rs": "x"})
    root = tmp_path / "root"
    (root / "leak.txt").symlink_to(tmp_path / "outside" / "secret.txt")
    (root / "escape").symlink_to(tmp_path / "outside" / "dir")
    (root / "a" / "loop").symlink_to(root)
    (root / "a" / "gone").symlink_to(root / "nowhere")
    os.mkfifo(root / "pipe")
    rows = corpus.scan_folder(spark, str(root), "r").collect()
    assert {(r.path, bytes(r.content)) for r in rows} == {("ok.rs", b"fn ok() {}\n"), ("a/b.rs", b"x")}
    assert [r.path for r in corpus.listing(spark, str(root)).collect()] == ["a/b.rs", "ok.rs"]
    assert corpus.total_size(corpus.listing(spark, str(root))).first().bytes == 12
    # the root itself may be a link
    (tmp_path / "alias").symlink_to(root)
    assert corpus.scan_folder(spark, str(tmp_path / "alias"), "r", content=False).count() == 2


def test_a_file_that_becomes_a_link_is_not_read(spark, tmp_path):
    put(tmp_path, {"root/a.txt": "a", "root/b.txt": "b", "secret": "s"})
    listed = folder.read_listing(spark, str(tmp_path / "root")).cache()
    assert listed.count() == 2
    (tmp_path / "root" / "a.txt").unlink()
    (tmp_path / "root" / "a.txt").symlink_to(tmp_path / "secret")
    assert [r.path for r in folder.read_contents(listed, str(tmp_path / "root")).collect()] == ["b.txt"]


@pytest.mark.parametrize("splits", [1, 3, 50])
def test_hidden_names_and_pruned_folders(spark, tmp_path, splits):
    """Hidden names are seen, .git isn't at any depth, whatever the partitions that are planned."""
    files = {f"d{i}/e{j}/.h{k}": "x" * k for i in range(4) for j in range(3) for k in range(3)} | {".top": "t", "_under/f": "u", "Ünï/漢.rs": "w", "a b/c": "", "empty/": None}
    put(tmp_path, {p: t for p, t in files.items() if t is not None} | {".git/config": "g", "d1/.git/x": "g", "d2/.git": "gitdir: x", "node_modules/m/x.js": "n", "d3/node_modules/y.js": "n"})
    (tmp_path / "empty").mkdir()
    listed = folder.read_listing(spark, str(tmp_path), splits, prune=("node_modules",))
    assert listed.rdd.getNumPartitions() <= splits
    rows = listed.collect()
    assert sorted(r.path for r in rows if r.kind == "file") == sorted(p for p, t in files.items() if t is not None)
    assert sorted(r.path for r in rows if r.kind == "pruned") == ["d3/node_modules", "node_modules"]
    assert {r.path: r.length for r in rows if r.kind == "file"}["d0/e0/.h2"] == 2


def test_not_a_folder(spark, tmp_path):
    put(tmp_path, {"f": "x"})
    with pytest.raises(NotADirectoryError):
        folder.read_listing(spark, str(tmp_path / "f"))


def test_large_files_are_not_held(spark, tmp_path):
    big, nul = b"a" * 5000, b"\0" + b"b" * 5000
    put(tmp_path, {"big.rs": big, "nul.rs": nul, "small.rs": "fn f() {}\n", "blob": b"\0\1"})
    listed = folder.read_listing(spark, str(tmp_path))
    read = folder.read_contents(listed, str(tmp_path), most=4096)
    rows = {r.path: r for r in classify.classify(read.selectExpr("'r' AS repo_id", "*"), max_bytes=4096).collect()}
    assert rows["big.rs"].content is None and (rows["big.rs"].bytes, rows["big.rs"].hash) == (5000, hashlib.sha256(big).hexdigest())
    assert (rows["big.rs"].is_oversize, rows["big.rs"].is_binary, rows["big.rs"].parsed, rows["big.rs"].lines) == (True, False, False, 0)
    assert rows["nul.rs"].is_oversize and rows["nul.rs"].is_binary and rows["nul.rs"].hash == hashlib.sha256(nul).hexdigest()
    assert rows["small.rs"].parsed and rows["small.rs"].lines == 1 and not rows["blob"].is_oversize and rows["blob"].is_binary


def test_remote_store(tmp_path):
    put(tmp_path, {"x/a": "aa", "b": "b"})
    store = folder.RemoteStore(pyarrow.fs.SubTreeFileSystem(str(tmp_path), pyarrow.fs.LocalFileSystem()))
    assert [(n, d, s) for n, d, s, _ in store.entries(b"")] == [(b"b", False, 1), (b"x", True, 0)] or [(n, d) for n, d, *_ in store.entries(b"")] == [(b"b", False), (b"x", True)]
    assert store.open(b"x/a").read() == b"aa" and list(store.entries(b"nowhere")) == []


def test_copied_folder(spark, tmp_path):
    files = {f"d{i % 3}/.f{i}": "x" * i for i in range(40)}
    put(tmp_path / "root", files)
    (tmp_path / "root" / "link").symlink_to(tmp_path / "root" / "d0")
    for _ in range(2):
        rows = folder.copy_folder(spark, str(tmp_path / "root"), str(tmp_path / "to" / "there"), at_once=4).collect()
        assert [(r.path, r.length) for r in rows] == sorted((p, len(t)) for p, t in files.items())
    assert [(r.path, r.length) for r in corpus.listing(spark, str(tmp_path / "to" / "there")).collect()] == sorted((p, len(t)) for p, t in files.items())


def test_partitioned_database_read(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    corpus.write_jdbc(spark.range(100).selectExpr("nullif(id, 7) AS id", "id AS v"), url, "jobs")
    rows = corpus.read_jdbc(spark, url, "jobs", column="id", partitions=5)
    assert rows.rdd.getNumPartitions() == 5 and sorted(r.v for r in rows.collect()) == list(range(100))
    corpus.write_jdbc(spark.range(0), url, "nobody")
    assert corpus.read_jdbc(spark, url, "nobody", column="id").count() == 0


# ignore rules


CASES = [
    # rule lines, path, is a directory, ignored
    ("*.o", "a/b.o", False, True), ("*.o", "b.o.c", False, False), ("/x", "x", False, True), ("/x", "a/x", False, False), ("a/x", "b/a/x", False, False),
    ("x/", "x", False, False), ("x/", "x", True, True), ("x[!a].txt", "xa.txt", False, False), ("x[!a].txt", "xb.txt", False, True), ("x[^a].txt", "xb.txt", False, True),
    (r"lit\*.md", "lit*.md", False, True), (r"lit\*.md", "litx.md", False, False), ("a?c", "a/c", False, False), ("a?c", "abc", False, True), ("[a-c]1", "b1", False, True),
    ("[]x]1", "]1", False, True), ("[a", "[a", False, False), ("a\\", "a\\", False, False), ("**/k", "a/b/k", False, True), ("**/k", "k", False, True),
    ("a/**/k", "a/k", False, True), ("a/**/k", "a/b/c/k", False, True), ("a/**", "a/b/c", False, True), ("a/**", "a", True, False), ("a**b", "axxb", False, True),
    ("a/**b", "a/x/b", False, False), ("a/*", "a/b/c", False, False), (r"\!x", "!x", False, True), (r"\#x", "#x", False, True), ("#x", "#x", False, False),
    ("x ", "x", False, True), ("x\\ ", "x ", False, True), ("*.c\n!k.c", "k.c", False, False), ("!k.c\n*.c", "k.c", False, True), ("*", "any/thing", False, True),
    ("a[b/]c", "a/c", False, False), ("[z-a]", "m", False, False), ("x\r\ny", "x", False, True), ("*.min.*", "a.min.js", False, True), ("[[]x", "[x", False, True),
    (r"[\]]x", "]x", False, True), ("***", "abc", False, True), ("d/\n!d/", "d", True, False), ("K", "k", False, False), ("ä*", "äb", False, True), ("", "x", False, False), ("/", "x", True, False),
]


@pytest.mark.parametrize("rules, path, is_dir, want", CASES)
def test_globs(rules, path, is_dir, want):
    assert ignore.is_ignored([("", rules)], path, is_dir) is want


def test_deeper_rules_and_subtrees(spark):
    rows = [
        (".gitignore", "build/\n*.log\n"), ("build/keep.txt", ""), ("build/.gitignore", "!*"), ("a/x.log", ""), ("a/.gitignore", "!x.log\nsub/*\n!sub/y\n"), ("a/sub/y", ""), ("a/sub/z", ""),
        ("a/b/x.log", ""), ("a/b/.gitignore", "*.log\n"), ("c.log", ""), (".git/info/exclude", "top\n*.log\n!c.log\n"), ("top", ""), ("d/top", ""), ("plain", ""),
    ]
    files = spark.createDataFrame([(r, p, t) for r in ("r", "s") for p, t in rows if r == "r" or not p.endswith("ignore") and "exclude" not in p], "repo_id string, path string, content string")
    got = {(r.repo_id, r.path) for r in ignore.drop_ignored(files, ignore.ignore_rules(files)).collect()}
    kept = {".gitignore", "a/x.log", "a/.gitignore", "a/sub/y", "a/b/.gitignore", ".git/info/exclude", "plain"}
    assert {p for r, p in got if r == "r"} == kept
    assert {p for r, p in got if r == "s"} == {p for p, _ in rows if not p.endswith("ignore") and "exclude" not in p}
    assert ignore.drop_ignored(files, ignore.ignore_rules(files.limit(0))).count() == files.count()
