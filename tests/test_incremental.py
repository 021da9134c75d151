import random

from cartolith.operators import classify, extract, incremental, tree

SCHEMA = "repo_id string, path string, content string"


def corpus_of(rng, n):
    ext = [".py", ".rs", ".go", ".md"]
    out = {}
    for _ in range(n):
        k = rng.randrange(60)
        path = "/".join([f"d{k % 3}", f"e{k % 7}"][: k % 3]) + ("/" if k % 3 else "") + f"f{k}{ext[k % 4]}"
        out[("r" if k % 2 else "s", path)] = f"def f{rng.randrange(9)}():\n    return 1\n" * rng.randrange(4)
    return out


def kept(spark, files):
    rows = spark.createDataFrame([(r, p, t) for (r, p), t in files.items()], SCHEMA)
    return classify.kept_files(classify.classify(rows))


def same_as_full(spark, store, files):
    full = kept(spark, files).cache()
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(store.live("files").select("repo_id", "path", "hash", "lines")) == got(full.select("repo_id", "path", "hash", "lines"))
    assert got(store.rollup()) == got(tree.dir_rollup(full).select("repo_id", "dir", *incremental.SUMS))
    assert got(store.dominant().select("repo_id", "dir", "language")) == got(tree.dominant_language(full).select("repo_id", "dir", "language"))
    columns = ["repo_id", "path", "kind", "name", "start_line", "end_line"]
    assert got(store.symbols().select(columns)) == got(extract.symbols(full).select(columns))


def test_updates_equal_a_full_build(spark, tmp_path):
    """Adds, edits, removals, a path that goes and comes again, a version written in part, and a compaction."""
    rng = random.Random(8)
    store = incremental.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    files = corpus_of(rng, 50)
    store.create(kept(spark, files))
    back = dict(list(files.items())[:5])
    for step in range(3):
        for key in rng.sample(sorted(files), 6):
            files[key] = files.pop(key) + "x = 1\n" if rng.random() < 0.5 else files.pop(key)
        for key in list(back):
            files.pop(key, None)
        if step == 1:
            files |= back
            back = {}
        files |= corpus_of(rng, 4)
        if step == 1:  # a version that dies before it is committed isn't there
            commit, incremental.IndexStore._commit = incremental.IndexStore._commit, lambda *a: 1 / 0
            try:
                store.update(kept(spark, files | {("r", "lost.py"): "x"}))
            except ZeroDivisionError:
                pass
            incremental.IndexStore._commit = commit
        assert store.update(kept(spark, files)) > 0
        if step == 1:
            store.compact()
        if step != 0:
            same_as_full(spark, store, files)
    assert store.update(kept(spark, files)) == 0
    for key in list(files):
        files.pop(key)
    store.apply(kept(spark, {("r", "only.py"): "def a(): pass\n"}), store.live("files").select("repo_id", "path"))
    same_as_full(spark, store, {("r", "only.py"): "def a(): pass\n"})


def test_an_update_reads_the_buckets_of_its_change(spark, tmp_path):
    files = {("r", f"a/f{i}.py"): f"x = {i}\n" for i in range(200)}
    store = incremental.IndexStore(spark, str(tmp_path / "index"), buckets=20)
    store.create(kept(spark, files))
    seen = []
    live = incremental.IndexStore.live
    incremental.IndexStore.live = lambda self, name, only=None: seen.append(live(self, name, only)) or seen[-1]
    try:
        assert store.apply(kept(spark, {("r", "a/f3.py"): "y = 1\n"}), kept(spark, {("r", "a/f9.py"): ""}).select("repo_id", "path")) == 2
    finally:
        incremental.IndexStore.live = live
    (old,) = seen
    assert old.count() <= 40  # two of twenty buckets, of some ten files each
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("\n")[0]
    assert store.rollup().where("dir = 'a'").first().files == 199


def test_staged_folders_are_removed(spark):
    import os

    from cartolith.sources import storage

    aside, storage._taken[:] = storage._taken[:], []
    try:
        assert storage.staged(spark.range(5)).count() == 5
        (path,) = storage._taken
        assert os.path.isdir(path.removeprefix("file:")) and storage.remove_staged(spark) == 1
        assert not os.path.exists(path.removeprefix("file:")) and storage.remove_staged(spark) == 0
    finally:
        storage._taken[:] = aside


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    files = {("r", f"a/f{i}.py"): f"x = '{rng.getrandbits(8000):x}'\n" for i in range(400)}
    store = incremental.IndexStore(spark, str(tmp_path / "index"), buckets=1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        store.create(kept(spark, files).repartition(8))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("index/parsed/version=0/bucket=0/*.parquet"))) > 1
    assert store.live("parsed").count() == 400
