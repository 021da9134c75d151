import pytest
from cartolith.operators.catalog import TIMED_OUT
from cartolith.streaming import jobs as streams

EVENTS = "job_id long, repo_id long, status string, created_at timestamp"


def drop(spark, folder, rows):
    values = ", ".join(f"({j}L, {r}L, '{s}', timestamp'{at}')" for j, r, s, at in rows)
    spark.sql(f"SELECT * FROM VALUES {values} AS t(job_id, repo_id, status, created_at)").coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / name / f"b={i}"))).option("checkpointLocation", str(tmp_path / f"{name}-ckpt")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return q.recentProgress


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_latest_status_and_its_expiry(spark, tmp_path, one_partition):
    """A row for each change, whatever the order of events; a silent repository's state goes."""
    folder, last = tmp_path / "in", []
    batches = [
        [(1, 1, "QUEUED", "2024-01-01 00:00:00"), (1, 1, "RUNNING", "2024-01-01 00:01:00"), (2, 2, "RUNNING", "2024-01-01 00:00:30")],
        [(1, 1, "QUEUED", "2024-01-01 00:00:30"), (2, 2, "SUCCEEDED", "2024-01-01 00:02:00")],
        [(3, 3, "QUEUED", "2024-01-03 00:00:00")],
        [(3, 3, "RUNNING", "2024-01-03 00:00:01")],
    ]
    for rows in batches:
        drop(spark, folder, rows)
        source = spark.readStream.schema(EVENTS).parquet(str(folder))
        last.append(run(streams.latest_status(source, "1 minute", 3600), "update", tmp_path, "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.repo_id, r.status) for r in got.collect()) == [(1, "RUNNING"), (2, "RUNNING"), (2, "SUCCEEDED"), (3, "QUEUED"), (3, "RUNNING")]
    assert str(got.where("repo_id = 2 AND status = 'SUCCEEDED'").first()["at"]) == "2024-01-01 00:02:00"
    sizes = [state_rows(p)[-1] for p in last]
    assert sizes[1] >= sizes[-1] and sizes[-1] < sizes[1] + sizes[0], sizes


def test_stale_jobs(spark, tmp_path, one_partition):
    folder, last = tmp_path / "in", []
    first = [(1, 1, "RUNNING", "2024-01-01 00:00:00"), (2, 2, "RUNNING", "2024-01-01 00:00:00"), (3, 3, "QUEUED", "2024-01-01 00:00:00")]
    later = [[(2, 2, "SUCCEEDED", "2024-01-01 00:30:00"), (2, 2, "RUNNING", "2024-01-01 00:10:00")]] + [[(k, k, "QUEUED", f"2024-01-0{k - 2} 12:00:00")] for k in (4, 5, 6)]
    for rows in [first, *later]:
        drop(spark, folder, rows)
        source = spark.readStream.schema(EVENTS).parquet(str(folder))
        last.append(run(streams.stale_jobs(source, 3600, "1 minute", 86_400), "append", tmp_path, "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.job_id, r.repo_id, r.error) for r in got if r.status == "FAILED"] == [(1, 1, TIMED_OUT)]
    assert sorted(r.job_id for r in got if r.status != "FAILED") == [1, 2, 2, 2, 3, 4, 5, 6]


def test_intake_into_a_table(spark, tmp_path):
    """A key comes once, however often it is sent; a batch that dies after its rows are written is run again."""
    table = streams.KeyedTable(spark, str(tmp_path / "repos"), "url", "url string, at timestamp", ranges=4)
    (tmp_path / "drop").mkdir()
    died = []

    def put(rows, batch):
        if not died and rows.where("url = 'c'").count():
            died.append(batch)
            enter, streams.KeyedTable._enter = streams.KeyedTable._enter, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            try:
                table.put(rows, batch)
            finally:
                streams.KeyedTable._enter = enter
        table.put(rows, batch)

    for k, urls in enumerate((["a", "b", "a"], ["b", "c"], ["d", "a"])):
        (tmp_path / "drop" / f"{k}.json").write_text("\n".join(f'{{"url": "{u}", "at": "2024-01-01T00:0{k}:00Z"}}' for u in urls))
        for _ in range(2 if k == 1 else 1):
            rows = streams.intake(spark, str(tmp_path / "drop"), "url string, at timestamp", "url", "at", "1 second")
            q = streams.for_each_batch(rows, put, str(tmp_path / "ckpt"))
            try:
                assert q.awaitTermination(120)
            except Exception as e:  # the first run of the second batch
                assert "lost" in str(e) and k == 1
            if k == 1 and _ == 0:
                assert sorted(r.url for r in table.rows().collect()) == ["a", "b"]
    assert sorted(r.url for r in table.rows().collect()) == ["a", "b", "c", "d"]
    assert table.rows().where("url = 'b'").first()["at"].minute == 0
    table.compact()
    table.put(spark.createDataFrame([("e", None), ("a", None), ("e", None)], "url string, at timestamp"), 99)
    table.put(spark.createDataFrame([("z", None)], "url string, at timestamp"), 99)
    assert sorted(r.url for r in table.rows().collect()) == ["a", "b", "c", "d", "e"]
