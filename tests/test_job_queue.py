import pytest

from quarry.streaming.job_queue import jobs, run_queue, send


def test_a_queue_is_steered_while_a_file_is_in_work(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events, target, checkpoint = (str(tmp_path / x) for x in ("events", "out", "cp"))
    (tmp_path / "events").mkdir()
    for name in ("z.txt", "a.txt", "m.txt", "late.txt", "odd.xyz"):
        (tmp_path / name).write_text("words of a file " * 30)

    def put(name):
        send(spark, events, "q", "file", str(tmp_path / name))

    seen = []

    def during(path):
        seen.append(path.rsplit("/", 1)[-1])
        if len(seen) == 1:
            raise RuntimeError("killed")  # in the first run, before anything is ingested
        if seen[-1] == "a.txt":
            send(spark, events, "q", "cancel")
            put("late.txt")

    for name in ("z.txt", "odd.xyz", "a.txt", "m.txt"):
        put(name)
    with pytest.raises(Exception, match="killed"):
        run_queue(spark, events, target, checkpoint, during=during)
    run_queue(spark, events, target, checkpoint, during=during)
    assert seen == ["z.txt", "z.txt", "odd.xyz", "a.txt", "late.txt"]  # by arrival, and on after the cancel
    got = {r.path.rsplit("/", 1)[-1]: (r.arrival, r.status, r.error) for r in jobs(spark, target).collect()}
    assert got == {
        "z.txt": (0, "completed", None),
        "odd.xyz": (1, "failed", "Unsupported: .xyz"),
        "a.txt": (2, "completed", None),  # it was in work when the rest was cancelled
        "m.txt": (3, "failed", "Cancelled"),
        "late.txt": (4, "completed", None),
    }
    assert spark.read.parquet(f"{target}/chunks").count() == 3
