"""The ingestion stream: a crash between write and commit, a line that comes again, two writers of one id."""

import json

import pytest
from pyspark.sql import functions as F

from watchloom.streaming import ingestion as G
from watchloom.streaming.windows import shared_folder

VENDOR = ("zeek", "p", "zeek.conn")


def line(i, **more):
    return json.dumps({"ts": 1704067200 + i, "uid": f"C{i}", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "proto": "tcp"} | more)


def run(spark, base, part, writer=None):
    G.start(G.log_lines(spark, f"{base}/{part}", 500), f"{base}/out", f"{base}/checkpoint-{part}", writer or part, "tenant", VENDOR, available_now=True).awaitTermination()


def test_crash_restart_and_two_writers(spark, monkeypatch):
    base = shared_folder(spark)
    put = lambda lines, part: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{base}/{part}")
    put([line(i) for i in range(20)] + ["{broken", line(50, ts="x"), "y" * 600], "a")
    whole = G.write_batch

    def crashing(folder, writer):
        write = whole(folder, writer)

        def then_die(batch, number):
            write(batch, number)
            raise RuntimeError("lost after the write, before the commit")

        return then_die

    monkeypatch.setattr(G, "write_batch", crashing)
    with pytest.raises(Exception, match="lost after the write"):
        run(spark, base, "a")
    monkeypatch.setattr(G, "write_batch", whole)
    run(spark, base, "a")
    seen = lambda: (G.events(spark, f"{base}/out").count(), {(r.code, r.n) for r in G.quarantine(spark, f"{base}/out").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()})
    first = seen()
    assert first == (20, {("DIP_JSON_INVALID", 1), ("UIM_EVENT_TIME_INVALID", 1), ("LINE_TOO_LONG", 1)})
    assert {(r.outcome, r.n) for r in G.outcomes(spark, f"{base}/out").collect()} == {("created", 20)}
    run(spark, base, "a")  # without news
    assert seen() == first
    # another reader finds ten of these lines again, and ten new ones
    put([line(i) for i in range(10, 30)], "b")
    run(spark, base, "b")
    assert seen()[0] == 30
    assert {(r.outcome, r.n) for r in G.outcomes(spark, f"{base}/out").collect()} == {("created", 30), ("duplicate", 10)}
    # a writer that could not see the others' batches yet wrote the same ids: readers see one row each
    rows = spark.read.parquet(f"{base}/out/events/writer=a/batch=0")
    rows.write.partitionBy("domain", "day").parquet(f"{base}/out/events/writer=c/batch=0")
    assert seen()[0] == 30 and G.events(spark, f"{base}/out").where("raw_event_id is null or day is null").count() == 0


def test_files_do_not_grow_as_tasks_times_days(spark):
    """Each task wrote a file for each day: 24 days in 4 tasks were up to 96 files."""
    import glob

    base = shared_folder(spark)
    spark.createDataFrame([(line(i * 3600),) for i in range(24 * 24)], "value string").repartition(4).write.text(f"{base}/d")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run(spark, base, "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{base.removeprefix('file:')}/out/events/**/*.parquet", recursive=True)
    assert len({f.split("day=")[1][:10] for f in files}) == 24 <= len(files) <= 24 + 4
    assert G.events(spark, f"{base}/out", ["outcome"]).columns == ["event_id", "outcome"] and G.events(spark, f"{base}/out").count() == 24 * 24
