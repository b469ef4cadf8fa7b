"""Incremental flows on Structured Streaming: ingest ledgers, item loops, live translation, running counters.

Each flow takes a streaming DataFrame and an output folder, keeps its progress in a checkpoint there, and can be stopped and
started again. Batches write under their own number, so one that runs twice leaves one result.
"""

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, _parse_datatype_string

from lexicarta.sources.files import ENTRY


def table_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The files of a table as a stream, so many at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")  # a pattern serves one file as well as a folder


def append_to(stream: DataFrame, out: str) -> StreamingQuery:
    """Rows added to a table, each input file once, until what is there is read."""
    return stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def batches_of(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose results are there, from the folder's names alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def remove(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def has_succeeded(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def keep_snapshot(df: DataFrame, out: str, batch: int) -> None:
    """A batch's result under its number; those before the last two go."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    for old in batches_of(df.sparkSession, out):
        if old < batch - 1:
            remove(df.sparkSession, f"{out}/batch={old}")


def snapshots_to(stream: DataFrame, out: str, mode: str = "complete") -> StreamingQuery:
    """The whole result after each batch, under the batch's number."""
    return stream.writeStream.foreachBatch(lambda df, batch: keep_snapshot(df, out, batch)).option("checkpointLocation", f"{out}.checkpoint").outputMode(mode).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The result after the last batch; no other is read."""
    return spark.read.parquet(f"{out}/batch={batches_of(spark, out)[-1]}")


#: Batches of changes after which they are merged.
MERGED = 16


def changes_to(stream: DataFrame, out: str, keys: list[str] | None = None, merged: int = MERGED) -> StreamingQuery:
    """Of a keyed aggregation, the rows that each batch changes, and no others; latest_rows() reads the whole.

    A batch writes as much as it changes. After so many batches their changes are merged with the rows before into one table, and what it
    replaces goes once the next merge is done; each key is rewritten once a merge. keys are the grouping columns, the first one
    if not given.
    """
    keys = keys or stream.columns[:1]

    def keep(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")
        if (batch + 1) % merged == 0:
            whole = latest_rows(spark, out, keys, batch)
            whole.write.mode("overwrite").parquet(f"{out}/whole/batch={batch}")
            for kind, last in (("changes", batch - merged), ("whole", batch - merged - 1)):
                for old in batches_of(spark, f"{out}/{kind}"):
                    if old <= last:
                        remove(spark, f"{out}/{kind}/batch={old}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode("update").trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, out: str, keys: list[str], until: int | None = None) -> DataFrame:
    """The latest row of each key that changes_to() wrote: the last merged table, and the changes since; until names the last batch that counts."""
    upto = lambda kind: [k for k in batches_of(spark, f"{out}/{kind}") if until is None or k <= until]
    whole = [k for k in upto("whole") if k != until and has_succeeded(spark, f"{out}/whole/batch={k}")]  # the merge of batch `until` is what asks
    last = whole[-1] if whole else -1
    parts = [(k, f"{out}/changes/batch={k}") for k in upto("changes") if k > last]
    if whole:
        parts.insert(0, (last, f"{out}/whole/batch={last}"))
    rows = None
    for k, path in parts:
        part = spark.read.parquet(path).withColumn("_batch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "_batch"]
    others = [c for c in columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_r"))
    return newest.select(*keys, "_r.*").select(*columns)


def last_rows(stream: DataFrame, order: list[str], out: str, n: int = 300) -> StreamingQuery:
    """The last n rows in an order, after each batch: those of the batch and of the batch before."""

    def keep(df: DataFrame, batch: int) -> None:
        before = [k for k in batches_of(df.sparkSession, out) if k < batch]
        rows = df.unionByName(df.sparkSession.read.schema(df.schema).parquet(f"{out}/batch={before[-1]}")) if before else df
        keep_snapshot(rows.orderBy(*(F.col(c).desc() for c in order)).limit(n), out, batch)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}.checkpoint").trigger(availableNow=True).start()


def ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], out: str) -> StreamingQuery:
    """New entries normalised and appended; the checkpoint is the ledger of files."""
    return append_to(normalise(stream), out)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.json", files: int = 100) -> DataFrame:
    """The files of a folder, whole, as a stream (path, modificationTime, length, content); empty ones as well."""
    return spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(folder)


def ingest_files(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], done: DataFrame, out: str) -> StreamingQuery:
    """New files of entries (JSON arrays), each once: their entries normalised, a log record and a done mark for each.

    stream is file_stream(); done (file) has files that were taken before, by name. Under `entries` stand the entries (file, and what normalise
    gives), sourced `bootstrap:name` where they name no source; under `files` a row for each file: how many entries it added, and its
    status: added, empty (no entry) or broken (no JSON array). Empty and broken files are done as well, and stop nothing; one without a byte is done
    without a row, as Spark skips it. A batch that runs twice leaves one result. File names stay in the tasks.
    """

    def keep(df: DataFrame, batch: int) -> None:
        text = F.btrim(F.decode("content", "UTF-8"), F.lit(" \t\r\n\ufeff"))
        listed = F.when(text.startswith("["), F.from_json(text, f"array<{ENTRY}>"))
        fresh = df.select(F.col("path").alias("file"), listed.alias("listed")).join(done.select("file"), "file", "left_anti")
        status = F.when(F.col("listed").isNull(), "broken").when(F.size("listed") == 0, "empty").otherwise("added")
        rows = fresh.select("file", F.posexplode("listed").alias("pos", "e")).select("file", "pos", "e.*")
        name = F.concat(F.lit("bootstrap:"), F.regexp_extract("file", "([^/]*)$", 1))
        named = rows.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), name))
        at = F.struct("file", "pos")
        made = normalise(named.withColumn("pos", at)).withColumnRenamed("pos", "at")
        made.select("at.file", "at.pos", *(c for c in made.columns if c != "at")).write.mode("overwrite").parquet(f"{out}/entries/batch={batch}")
        log = fresh.select("file", status.alias("status"), F.coalesce(F.size("listed"), F.lit(0)).alias("added"), F.lit("import_bootstrap").alias("action"))
        log.write.mode("overwrite").parquet(f"{out}/files/batch={batch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def batch_rows(spark: SparkSession, out: str) -> DataFrame:
    """All that the batches of a flow have written under a folder."""
    return spark.read.option("basePath", out).parquet(*(f"{out}/batch={k}" for k in batches_of(spark, out)))


def isolated(rows: DataFrame, work: Callable, entry: str) -> DataFrame:
    """rows with `entries` (an array of entry, a schema of fields) and `error`: work(row) gives an item's entries as tuples.

    An item that raises has its error (`ValueError: ...`) and no entries, and stops no other one.
    """
    schema = StructType([*rows.schema.fields, *_parse_datatype_string(f"entries array<struct<{entry}>>, error string").fields])

    def run(batches):
        for b in batches:
            entries, errors = [], []
            for row in b.to_pylist():
                made, error = [], None
                try:
                    made = list(work(row))
                except Exception as x:  # any: it is the item's own
                    error = f"{type(x).__name__}: {x}"
                entries.append(made)
                errors.append(error)
            kind = to_arrow_schema(schema).field("entries").type
            names = [f.name for f in kind.value_type]
            listed = pa.array([[dict(zip(names, e, strict=True)) for e in own] for own in entries], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, listed, pa.array(errors, pa.string())], [*b.schema.names, "entries", "error"])

    return rows.mapInArrow(run, schema)


def item_rows(spark: SparkSession, out: str, outcome: str | None = None) -> DataFrame | None:
    """What the item loop has written, of one outcome (done, empty, error, skipped) or of all; None before the first batch."""
    found = batches_of(spark, f"{out}/items")
    rows = spark.read.option("basePath", f"{out}/items").parquet(*(f"{out}/items/batch={k}" for k in found)) if found else None
    return rows if rows is None or outcome is None else rows.where(F.col("outcome") == outcome)


def items(stream: DataFrame, work: Callable, entry: str, done: DataFrame, out: str, per_second: float | None = None) -> StreamingQuery:
    """Items (key, ...) worked on one by one: work(row) gives an item's entries (tuples of the fields of entry).

    The ledger is done (key) and the keys that the flow itself has finished, those with entries; an item in it is skipped, and so is one
    that comes twice in a batch. One that fails, or has no entries, isn't in it and is tried anew when it comes again. A batch
    is one write, partitioned by outcome: results, errors and ledger can't part when the flow is stopped. counters() of
    the batch (seen, skipped, finished, empty, failed, entries) are observed on the way and stand under `counters`. With per_second, no more items
    than that start in a second: batches wait.
    """

    def keep(df: DataFrame, batch: int) -> None:
        spark, began = df.sparkSession, time.time()
        before = [k for k in batches_of(spark, f"{out}/items") if k < batch]
        ledger = done.select("key")
        if before:
            own = spark.read.option("basePath", f"{out}/items").parquet(*(f"{out}/items/batch={k}" for k in before))
            ledger = ledger.unionByName(own.where("outcome = 'done'").select("key"))
        seen, worked = Observation(), Observation()
        fresh = df.observe(seen, F.count(F.lit(1)).alias("seen")).dropDuplicates(["key"]).join(ledger, "key", "left_anti")
        outcome = F.when(F.col("error").isNotNull(), "error").when(F.size("entries") == 0, "empty").otherwise("done")
        made = isolated(fresh, work, entry).withColumn("outcome", outcome)
        counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "empty", "error")]
        made.observe(worked, *counts, F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("entries")).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/items/batch={batch}")
        got = seen.get | worked.get
        n = got["done"] + got["empty"] + got["error"]
        row = [(batch, got["seen"], got["seen"] - n, got["done"], got["empty"], got["error"], got["entries"])]
        spark.createDataFrame(row, "batch long, seen long, skipped long, finished long, empty long, failed long, entries long").coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/batch={batch}")
        if per_second:
            time.sleep(max(0.0, n / per_second - (time.time() - began)))

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def translate(stream: DataFrame, lexicon: DataFrame, out: str) -> StreamingQuery:
    """Lines (file, line_no, query) looked up in a table (query, result) as they come."""
    found = stream.join(lexicon.groupBy("query").agg(F.min("result").alias("result")), "query", "left")
    return append_to(found.select("file", "line_no", "query", F.coalesce("result", F.lit("unresolved")).alias("result")), out)


def counters(stream: DataFrame, out: str) -> StreamingQuery:
    """Running counts of rows (file, changed, parsed, line_no) and the furthest line of each file."""
    counts = stream.groupBy("file").agg(F.count(F.lit(1)).alias("processed"), F.count_if("changed").alias("changed"), F.count_if("parsed").alias("parsed"), F.max("line_no").alias("last_line"))
    return changes_to(counts, out)


def attempt_counts(stream: DataFrame, out: str) -> StreamingQuery:
    """Counts of attempts (stage, status)."""
    return snapshots_to(stream.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n")), out)


def attempt_counts_by_time(stream: DataFrame, out: str, bucket: str = "1 day", late: str = "2 days") -> StreamingQuery:
    """Our own addition: counts of attempts (stage, ts) in buckets of time, closed once the watermark has passed them.

    A row of a bucket that was closed a batch ago is dropped; dropped_late() counts such rows.
    """
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", bucket), "stage").agg(F.count(F.lit(1)).alias("n"))
    return append_to(counts.select("window.start", "stage", "n"), out)


def dropped_late(query: StreamingQuery) -> int:
    """How many rows came behind the watermark and were dropped, over the batches that the query remembers.

    An aggregation counts what is left after each task has merged the rows of a key and bucket.
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def latest_of(updates: DataFrame) -> DataFrame:
    """The latest value of each key of updates (cache_key, result, updated_at)."""
    return updates.groupBy("cache_key").agg(F.max_by("result", F.struct("updated_at", "result")).alias("result"), F.max("updated_at").alias("updated_at"))


def cache_upserts(stream: DataFrame, out: str) -> StreamingQuery:
    """The latest value of each key, as updates (cache_key, result, updated_at) come; a batch writes the keys that it changes."""
    return changes_to(latest_of(stream), out)
