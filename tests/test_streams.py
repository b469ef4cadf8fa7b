"""Streaming flows equal the batch result, also when they are stopped and started again."""

from pyspark.sql import functions as F

from lexicarta.streaming import flows


def write(spark, path, rows):
    spark.createDataFrame(rows, "key long, stage string, line_no int").coalesce(1).write.mode("append").parquet(path)


def test_counts_survive_a_restart(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        write(spark, source, [(part * 10 + i, f"s{i % 2}", i) for i in range(10)])
    stream = lambda: flows.table_stream(spark, source, files=1).select("stage", F.lit("ok").alias("status"))
    flows.attempt_counts(stream(), out).awaitTermination()
    assert {r.stage: r.n for r in flows.latest_snapshot(spark, out).collect()} == {"s0": 15, "s1": 15}
    write(spark, source, [(99, "s0", 1)])
    flows.attempt_counts(stream(), out).awaitTermination()
    assert {r.stage: r.n for r in flows.latest_snapshot(spark, out).collect()} == {"s0": 16, "s1": 15}


def test_translate_joins_a_table(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, source, [(1, "one", 0), (1, "two", 1)])
    lines = flows.table_stream(spark, source).select(F.col("key").alias("file"), "line_no", F.col("stage").alias("query"))
    flows.translate(lines, spark.createDataFrame([("one", "က")], "query string, result string"), out).awaitTermination()
    assert {(r.query, r.result) for r in spark.read.parquet(f"{out}/rows").collect()} == {("one", "က"), ("two", "unresolved")}


def folders(path, name):
    return sorted(p.name for p in (path / "out" / name).glob("batch=*"))


def test_items_fail_alone_and_are_tried_again(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, source, [(i, f"s{i}", i) for i in range(6)] + [(1, "s1", 1)])
    done = spark.createDataFrame([(0,), (3,)], "key long")
    broken = {2, 4}

    def work(row):
        if row["key"] in broken:
            raise RuntimeError(f"no {row['stage']}")
        return [(row["stage"], k) for k in range(row["key"] % 5)]

    run = lambda: flows.items(flows.table_stream(spark, source, files=1), work, "name:string,place:int", done, out).awaitTermination()
    run()
    first = {r.key: (r.outcome, r.error, [tuple(e) for e in r.entries]) for r in flows.item_rows(spark, out).collect()}
    assert first == {1: ("done", None, [("s1", 0)]), 2: ("error", "RuntimeError: no s2", []), 4: ("error", "RuntimeError: no s4", []), 5: ("empty", None, [])}
    broken.clear()
    write(spark, source, [(i, f"s{i}", i) for i in (1, 2, 5, 8)])
    run()  # the flow goes on where it stopped; what is done isn't repeated, what failed or was empty is tried again
    later = {(r.key, r.outcome) for r in flows.item_rows(spark, out).where("batch = 1").collect()}
    assert later == {(2, "done"), (5, "empty"), (8, "done")}
    assert sorted(r.key for r in flows.item_rows(spark, out, "done").collect()) == [1, 2, 8]
    assert flows.item_rows(spark, out, "error").count() == 2
    counts = {r.batch: (r.seen, r.skipped, r.finished, r.empty, r.failed, r.entries) for r in flows.batch_rows(spark, f"{out}/counters").collect()}
    assert counts == {0: (7, 3, 1, 1, 2, 1), 1: (4, 1, 2, 1, 0, 5)}


def test_items_wait_for_their_rate(spark, tmp_path):
    import time

    write(spark, f"{tmp_path}/in", [(i, "s", i) for i in range(8)])
    began = time.time()
    flows.items(flows.table_stream(spark, f"{tmp_path}/in"), lambda row: [], "n:int", spark.createDataFrame([], "key long"), f"{tmp_path}/out", per_second=2).awaitTermination()
    assert time.time() - began >= 4


def test_batches_write_what_they_change(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = lambda: flows.table_stream(spark, source, files=1).select(F.col("stage").alias("cache_key"), F.col("key").alias("result"), F.col("line_no").alias("updated_at"))
    write(spark, source, [(i, f"k{i}", i) for i in range(500)])
    flows.changes_to(flows.latest_of(stream()), out, merged=3).awaitTermination()
    want = {f"k{i}": i for i in range(500)}
    for n in range(1, 8):  # stopped and started again each time
        write(spark, source, [(1000 * n + k, f"k{k}", 1000 * n) for k in (n, n + 1)] + [(-1, "k400", -5)])
        flows.changes_to(flows.latest_of(stream()), out, merged=3).awaitTermination()
        want |= {f"k{k}": 1000 * n + k for k in (n, n + 1)}
        assert spark.read.parquet(f"{out}/changes/batch={n}").count() <= 3
        assert {r.cache_key: r.result for r in flows.latest_rows(spark, out, ["cache_key"]).collect()} == want
    assert folders(tmp_path, "whole") == ["batch=2", "batch=5"] and folders(tmp_path, "changes") == [f"batch={k}" for k in (3, 4, 5, 6, 7)]


def test_a_late_row_is_dropped_and_counted(spark, tmp_path):
    from datetime import datetime

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda *rows: spark.createDataFrame([(s, datetime(2024, 1, d, 12)) for s, d in rows], "stage string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    at(("a", 1), ("a", 1), ("b", 2), ("a", 10))
    at(("b", 10))  # from here on the watermark is at the 8th, and the next batch drops what comes behind it
    at(("a", 2), ("a", 9))
    at(("a", 20))
    query = flows.attempt_counts_by_time(flows.table_stream(spark, source, files=1), out)
    query.awaitTermination()
    got = {(r.start.day, r.stage, r.n) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {(1, "a", 2), (2, "b", 1), (9, "a", 1), (10, "a", 1), (10, "b", 1)}
    assert flows.dropped_late(query) == 1


def test_files_of_entries_are_taken_once(spark, tmp_path):
    from lexicarta.operators import entries

    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    put = lambda name, text: (source / name).write_text(text, encoding="utf-8")
    put("a.json", '﻿[{"karen": " က ", "definitions": ["x", " "], "page": 3}, {"karen": "ခ", "source": "own"}]')
    put("broken.json", '[{"karen": ')
    put("object.json", '{"karen": "က"}')
    put("none.json", "[]")
    put("zero.json", "")  # no row, but Spark's own ledger has it
    put("old.json", '[{"karen": "ဂ"}]')
    put("other.txt", '[{"karen": "ဂ"}]')
    done = spark.createDataFrame([(f"file:{source}/old.json",)], "file string")
    run = lambda: flows.ingest_files(flows.file_stream(spark, str(source)), entries.normalise_entries, done, out).awaitTermination()
    run()
    name = lambda f: f.rsplit("/", 1)[1]
    log = {name(r.file): (r.status, r.added) for r in flows.batch_rows(spark, f"{out}/files").collect()}
    assert log == {"a.json": ("added", 2), "broken.json": ("broken", 0), "object.json": ("broken", 0), "none.json": ("empty", 0)}
    got = {(name(r.file), r.pos, r.karen, tuple(r.definitions), r.page, r.source) for r in flows.batch_rows(spark, f"{out}/entries").collect()}
    assert got == {("a.json", 0, "က", ("x",), 3, "bootstrap:a.json"), ("a.json", 1, "ခ", (), None, "own")}
    put("b.json", '[{"karen": "ဃ"}]')
    run()
    assert flows.batch_rows(spark, f"{out}/files").count() == 5 and flows.batch_rows(spark, f"{out}/entries").count() == 3
