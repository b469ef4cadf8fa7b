"""Readers and writers of the files that dictionary and recognition work leaves behind."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries as files hold them; the analysis stays JSON text.
FIELDS = ["karen", "definitions", "page", "flag", "source", "entry_type", "promoted", "updated_at", "analysis"]
ENTRY = "struct<karen:string,definitions:array<string>,page:int,flag:boolean,source:string,entry_type:string,promoted:boolean,updated_at:string,analysis:string>"
#: Extensions of images (fixed values).
IMAGES = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]
DETECTION = "image string, cls_idx int, syllable string, english string, confidence double, x_center double, y_center double, width double, height double"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in spark.checkpoint.dir. Where none is set, a session on one machine (as in tests) gets a temporary one; a cluster must name one."""
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a fresh folder: worked out once, whatever reads it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_entries(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(file, pos, entry fields) of JSON arrays of entries, one in a file or, not whole, one in a line; broken ones give no rows."""
    raw = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), "value")
    items = raw.select("file", F.posexplode(F.from_json("value", f"array<{ENTRY}>")).alias("pos", "e"))
    return items.select("file", "pos", "e.*")


def write_entries(df: DataFrame, path: str) -> None:
    """Entries as one JSON array for each page, one in a line: arrays stay as small as a page. Fields that df lacks are left out."""
    item = F.to_json(F.struct(*(c for c in FIELDS if c in df.columns and c != "analysis")))
    if "analysis" in df.columns:  # is JSON already
        item = F.when(F.col("analysis").isNull(), item).otherwise(F.concat(F.regexp_replace(item, r"\}$", ""), F.lit(',"analysis":'), "analysis", F.lit("}")))
    listed = df.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("e")))).alias("l"))
    listed.select(F.concat(F.lit("["), F.array_join(F.col("l.e"), ","), F.lit("]")).alias("value")).write.text(path)


def image_inventory(listing: DataFrame) -> DataFrame:
    """(split, stem, ext) of the images in a listing of files (path), as `.../split/images/name.ext`; other files are left out."""
    parts = F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = listing.select(*(c.alias(name) for c, name in zip(parts, ("split", "stem", "ext"), strict=True)))
    return rows.where(F.col("ext").isin(IMAGES))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, class_idx, cx, cy, w, h) of label lines `stem class cx cy w h` below folders split=...; blank ones are skipped."""
    p = F.split(F.btrim("value"), r"\s+")
    raw = spark.read.text(path).where(F.btrim("value") != "")
    number = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind)
    return raw.select("split", F.get(p, F.lit(0)).alias("stem"), number(1, "int").alias("class_idx"), *(number(i + 2, "double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))))


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines of (split, stem, class_idx, cx, cy, w, h), partitioned by split: no file for each image."""
    line = F.concat_ws(" ", F.col("stem").cast("string"), F.col("class_idx").cast("string"), *(F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")))
    df.select("split", line.alias("value")).write.partitionBy("split").text(path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(file, class_idx, name) of dataset files with a line `- name` for each class, in order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    names = F.regexp_extract_all("value", F.lit(r"(?m)^\s*-\s*(\S+)\s*$"), 1)
    return raw.select("file", F.posexplode(names).alias("class_idx", "name"))


def write_class_list(df: DataFrame, path: str) -> None:
    """Labels of (class_id, label), one in a line, in order of number over the files' names."""
    df.repartitionByRange("class_id").sortWithinPartitions("class_id").select(F.col("label").alias("value")).write.text(path)


def write_kv_result(rows: DataFrame, path: str) -> None:
    """Lines (file, section, line_no, text) as text, a folder for each file, in order over the files' names in it."""
    ordered = rows.repartitionByRange("file", "section", "line_no").sortWithinPartitions("file", "section", "line_no")
    ordered.select("file", F.col("text").alias("value")).write.partitionBy("file").text(path)


def read_key_values(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, value) of lines (file, line_no, raw) `key = value`; comments and lines without the sign are skipped."""
    parts = F.split("raw", "=", 2)
    rows = lines.where(F.contains("raw", F.lit("=")) & ~F.ltrim("raw").startswith("#"))
    return rows.select("file", "line_no", F.btrim(parts[0]).alias("key"), F.btrim(parts[1]).alias("value"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTION).option("header", True).csv(path)


def write_detections(df: DataFrame, path: str) -> None:
    """Detections as CSV, measures with four decimals."""
    four = {c: F.format_string("%.4f", c).alias(c) for c in ("confidence", "x_center", "y_center", "width", "height")}
    df.select(*(four.get(c, F.col(c)) for c in df.columns)).write.option("header", True).csv(path)


def read_curve(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A training curve; `inf` is read as such, not as null."""
    return spark.read.schema(schema).option("header", True).option("positiveInf", "inf").option("negativeInf", "-inf").csv(path)


def read_class_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summary rows and a row for each class of validation reports in JSON."""
    raw = spark.read.schema("model string, map50 double, per_class array<struct<class_idx:int,map50:double>>").json(path)
    return raw.select("model", "map50"), raw.select("model", F.explode("per_class").alias("c")).select("model", "c.*")


def seed_plan(plans: DataFrame) -> DataFrame:
    """(plan, band, example, target, share): nested bands (name, target_count, examples) as rows, and how much of the target the examples are."""
    bands = plans.select("plan", F.explode("bands").alias("b"))
    return bands.select("plan", F.col("b.name").alias("band"), F.explode("b.examples").alias("example"), F.col("b.target_count").alias("target"), F.round(F.size("b.examples") / F.col("b.target_count"), 4).alias("share"))


def resolved(address: Column, base: Column) -> Column:
    """An address made absolute by that of its page: the scheme, the host or the folder is taken from there, `.` and `..` are followed."""
    host, path = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(base, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/")))
    whole = F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), address).when(address.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), address)).when(address.startswith("/"), F.concat(host, address)).otherwise(F.concat(folder, address))
    top, rest, tail = F.regexp_extract(whole, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(whole, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(whole, r"([?#].*)$", 1)
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    ends = F.when(rest.rlike(r"/\.\.?$"), "/").otherwise("")
    followed = F.concat(top, F.array_join(F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step), "/"), ends, tail)
    return F.when(rest.rlike(r"(^|/)\.\.?(/|$)") & (top != ""), followed).otherwise(whole)


def page_sample(pages: DataFrame, chars: int = 2000, images: int = 20) -> DataFrame:
    """(page_id, text, images): the first characters of a page's visible text, a line for each piece, and its first image addresses, made absolute."""
    bare = F.col("html")
    for hidden in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>"):
        bare = F.regexp_replace(bare, hidden, "")
    pieces = F.filter(F.transform(F.split(bare, "<[^>]*>"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    found = F.filter(F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']"""), 1), lambda u: u != "")
    full = F.transform(F.slice(found, 1, images), lambda u: resolved(u, F.col("url")))
    return pages.select("page_id", F.substring(F.array_join(pieces, "\n"), 1, chars).alias("text"), full.alias("images"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """df as the latest version under a folder, which read_snapshot finds: a pointer is put in place of the last one, in one step, once the version is whole."""
    spark = df.sparkSession
    hadoop, name = spark.sparkContext._jvm.org.apache.hadoop.fs, uuid.uuid4().hex
    df.write.parquet(f"{path}/{name}")
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fresh, pointer = hadoop.Path(f"{path}/pointer-{name}"), hadoop.Path(f"{path}/latest")
    out = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(fresh, pointer, how)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names; older ones stay until they are deleted."""
    name = spark.read.text(f"{path}/latest").first()[0]
    return spark.read.parquet(f"{path}/{name}")


def append_log(df: DataFrame, path: str) -> None:
    """Records added to a log; earlier files stay as they are."""
    df.write.mode("append").parquet(path)


def write_groups(df: DataFrame, path: str, group: str) -> None:
    """The rows as CSV and as JSON, a folder for each group."""
    df.write.partitionBy(group).option("header", True).csv(f"{path}/csv")
    df.write.partitionBy(group).json(f"{path}/json")


def ingest_new(spark: SparkSession, folder: str, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, value) lines of the files of a folder that the ledger (file) doesn't have, and the ledger with those files.

    Only those files are read; their names are listed on the driver, as for any table. Empty files are never listed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"))
    fresh = listed.join(ledger, "file", "left_anti")
    names = [r.file for r in fresh.toLocalIterator()]
    rows = spark.read.text(names) if names else spark.createDataFrame([], "value string").select("value", F.struct(F.lit("").alias("file_path")).alias("_metadata"))
    return rows.select(F.col("_metadata.file_path").alias("file"), "value"), ledger.select("file").unionByName(spark.createDataFrame([(n,) for n in names], "file string"))
