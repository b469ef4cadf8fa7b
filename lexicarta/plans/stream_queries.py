"""Queries of streaming flows: the given tables come file by file, and the flow's final result is returned."""

from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.operators import entries as entry_ops
from lexicarta.plans import bindings as b
from lexicarta.sources import files
from lexicarta.streaming import flows

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def events(spark, d):
    return flows.table_stream(spark, f"{d}/events.parquet")


def documents(spark, d):
    return flows.table_stream(spark, f"{d}/documents.parquet")


@query("stream_ingest", "WITH " + b.ENTRIES + """
SELECT pos, regexp_replace(karen, '^\\s+|\\s+$', '', 'g') AS karen, len(list_filter(definitions, lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) AS n_definitions, page, flag FROM entries""")
def stream_ingest(spark, d):
    out = files.scratch(spark, "ingest")
    t = F.coalesce("text", F.lit(""))
    stream = documents(spark, d).select(F.col("doc_id").alias("pos"), F.substring_index(t, " ", 1).alias("karen"), F.split(t, "\n").alias("definitions"), (F.col("doc_id") % 600).cast("int").alias("page"), (F.col("doc_id") % 7 == 0).alias("flag"), "source", F.lit("headword").alias("entry_type"))
    flows.ingest(stream, entry_ops.normalise_entries, out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("pos", "karen", F.size("definitions").cast("long").alias("n_definitions"), "page", "flag")


@query("stream_items", """
WITH p AS (SELECT page_id AS key, TRY_CAST(nullif(regexp_extract(url, '[0-9]+'), '') AS BIGINT) + 3 AS page, regexp_extract_all(coalesce(html, ''), '<h[1-3]>([^<]*)</h[1-3]>', 1) AS heads FROM pages WHERE page_id % 5 <> 0)
SELECT key, CASE WHEN page IS NULL THEN 'ValueError: no page number' END AS error, CASE WHEN page IS NULL THEN 'error' WHEN len(heads) = 0 THEN 'empty' ELSE 'done' END AS outcome,
  CASE WHEN page IS NULL THEN '' ELSE array_to_string(list_transform(heads, lambda h: CAST(page AS VARCHAR) || ':' || h), '|') END AS entries FROM p""")
def stream_items(spark, d):
    """Pages as items, a fifth of which is in the ledger: the headings of each as entries with its page number; a page without a number fails."""
    out = files.scratch(spark, "items")
    pages = flows.table_stream(spark, f"{d}/pages.parquet").select(F.col("page_id").alias("key"), "url", "html")
    done = b.table(spark, d, "pages").where("page_id % 5 = 0").select(F.col("page_id").alias("key"))

    def headings(row):
        import re

        number = re.search("[0-9]+", row["url"] or "")
        if not number:
            raise ValueError("no page number")
        for text in re.findall("<h[1-3]>([^<]*)</h[1-3]>", row["html"] or ""):
            yield int(number[0]) + 3, text

    flows.items(pages, headings, "page:long,karen:string", done, out).awaitTermination()
    listed = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["page"].cast("string"), e["karen"])), "|")
    return flows.item_rows(spark, out).select("key", "error", "outcome", listed.alias("entries"))


@query("stream_translate", """
WITH l AS (SELECT doc_id AS file, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT lower(p_name) AS query FROM part UNION SELECT lower(unnest(string_split(p_name, ' '))) FROM part), q AS (SELECT file, line_no, lower(unnest(string_split(raw, ' '))) AS query FROM l)
SELECT file, line_no, q.query, CASE WHEN k.query IS NULL THEN 'unresolved' ELSE translate(k.query, 'abcdefghijklmnopqrstuvwxyz', '%s') END AS result FROM q LEFT JOIN k USING (query)""" % b.NATIVE)
def stream_translate(spark, d):
    out = files.scratch(spark, "translate")
    lines = documents(spark, d).select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).select("file", "line_no", F.explode(F.split(F.lower("raw"), " ")).alias("query"))
    p = b.table(spark, d, "part").select(F.lower("p_name").alias("n"))
    known = p.select(F.col("n").alias("query")).unionByName(p.select(F.explode(F.split("n", " ")).alias("query"))).distinct()
    flows.translate(lines, known.withColumn("result", F.translate("query", b.LATIN, b.NATIVE)), out).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("live_counters", """
WITH l AS (SELECT doc_id AS file, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
SELECT file, count(*) AS processed, count(*) FILTER (WHERE contains(raw, '=')) AS changed, count(*) FILTER (WHERE regexp_matches(raw, '[A-Za-z]')) AS parsed, max(line_no) AS last_line FROM l GROUP BY file""")
def live_counters(spark, d):
    out = files.scratch(spark, "counters")
    lines = documents(spark, d).select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    rows = lines.select("file", "line_no", F.contains("raw", F.lit("=")).alias("changed"), F.col("raw").rlike(text.LATIN_LETTER).alias("parsed"))
    flows.counters(rows, out).awaitTermination()
    return flows.latest_rows(spark, out, ["file"])


@query("live_last_rows", "WITH " + b.LINES + " SELECT file, line_no, md5(raw) AS raw FROM lines ORDER BY file DESC, line_no DESC LIMIT 300")
def live_last_rows(spark, d):
    """The last 300 lines of all, as a live view shows them."""
    out = files.scratch(spark, "last")
    lines = documents(spark, d).select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    flows.last_rows(lines, ["file", "line_no"], out).awaitTermination()
    return flows.latest_snapshot(spark, out).withColumn("raw", F.md5("raw"))


@query("attempt_counts_stream", "SELECT event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'miss' ELSE 'match' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def attempt_counts_stream(spark, d):
    out = files.scratch(spark, "attempts")
    status = F.when(F.col("event_id") % 3 == 0, "miss").otherwise("match")
    flows.attempt_counts(events(spark, d).select(F.col("event_type").alias("stage"), status.alias("status")), out).awaitTermination()
    return flows.latest_snapshot(spark, out)


@query("attempt_buckets_stream", """
WITH e AS (SELECT event_type AS stage, ts, date_trunc('day', ts) AS start, event_id % 50 AS part FROM events),
w AS (SELECT max(ts) FILTER (WHERE part > 1) - INTERVAL 2 DAY AS first_mark, max(ts) - INTERVAL 2 DAY AS last_mark FROM e)
SELECT start, stage, count(*) AS n FROM e, w WHERE start + INTERVAL 1 DAY <= last_mark AND NOT (part = 0 AND start + INTERVAL 1 DAY <= first_mark) GROUP BY start, stage""")
def attempt_buckets_stream(spark, d):
    """Attempts in buckets of a day, in three batches; a fiftieth of them comes last, by when most of their buckets are closed."""
    source, out = files.scratch(spark, "events"), files.scratch(spark, "buckets")
    part = F.col("event_id") % 50
    rows = b.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for own in (part > 1, part == 1, part == 0):
        rows.where(own).coalesce(1).write.mode("append").parquet(source)
    flows.attempt_counts_by_time(flows.table_stream(spark, source, files=1).select("stage", "ts"), out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("cache_upsert_stream", "SELECT event_type || '::' || CAST(user_id AS VARCHAR) AS cache_key, arg_max(event_id, ts) AS result, max(ts) AS updated_at FROM events GROUP BY 1")
def cache_upsert_stream(spark, d):
    out = files.scratch(spark, "cache")
    updates = events(spark, d).select(F.concat_ws("::", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").alias("result"), F.col("ts").alias("updated_at"))
    flows.cache_upserts(updates, out).awaitTermination()
    return flows.latest_rows(spark, out, ["cache_key"])


@query("ingest_new_files", """
SELECT CAST(doc_id % 20 AS BIGINT) AS part, count(*) AS n FROM documents WHERE doc_id % 20 >= 5 GROUP BY 1""")
def ingest_new_files(spark, d):
    """Files written from documents, of which the ledger has a quarter; lines of the others."""
    path = files.scratch(spark, "drop")
    b.table(spark, d, "documents").select((F.col("doc_id") % 20).alias("part"), F.concat_ws(" ", (F.col("doc_id") % 20).cast("string"), F.col("source")).alias("value")).write.partitionBy("part").text(path)
    listed = spark.read.format("binaryFile").load(path).where("part < 5").select(F.col("path").alias("file"))
    lines, _ = files.ingest_new(spark, path, listed)
    return lines.groupBy(F.split_part("value", F.lit(" "), F.lit(1)).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_files", """
WITH d AS (SELECT doc_id % 20 AS part, count(*) AS n, sum(length(regexp_replace(split_part(coalesce(text, ''), ' ', 1), '^\\s+|\\s+$', '', 'g'))) AS letters FROM documents GROUP BY 1)
SELECT CAST(part AS BIGINT) AS part, CASE WHEN part = 7 THEN 'broken' WHEN part = 8 THEN 'empty' ELSE 'added' END AS status, CASE WHEN part IN (7, 8) THEN 0 ELSE n END AS added, CASE WHEN part IN (7, 8) THEN 0 ELSE CAST(letters AS BIGINT) END AS letters FROM d WHERE part >= 5""")
def ingest_files(spark, d):
    """Files of entries made of the documents, of which the ledger has a quarter, one is broken and one is empty: what was added of each."""
    source, out = files.scratch(spark, "drop"), files.scratch(spark, "ingested")
    entries = b.entries(spark, d).withColumn("part", F.col("pos") % 20)
    item = F.to_json(F.struct("karen", "definitions", "page", "flag"))
    listed = entries.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]")).alias("value"))
    value = F.when(F.col("part") == 7, F.concat(F.lit("{"), "value")).when(F.col("part") == 8, "[]").otherwise(F.col("value"))
    listed.select("part", value.alias("value")).repartition("part").write.partitionBy("part").text(source)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part")
    done = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(F.col("path").alias("file")).where(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long") < 5)
    flows.ingest_files(flows.file_stream(spark, source, "*.txt", 4), entry_ops.normalise_entries, done, out).awaitTermination()
    letters = flows.batch_rows(spark, f"{out}/entries").groupBy("file").agg(F.sum(F.length("karen")).alias("letters"))
    log = flows.batch_rows(spark, f"{out}/files").join(letters, "file", "left")
    return log.select(part, "status", F.col("added").cast("long").alias("added"), F.coalesce("letters", F.lit(0)).cast("long").alias("letters"))
