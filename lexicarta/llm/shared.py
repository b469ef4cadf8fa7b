"""What several training-data operators share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a session on one machine (as in tests) gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that reads them is written itself."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sent(table: DataFrame, row_bytes, most: int) -> DataFrame:
    """A written table, to be broadcast if the sum of row_bytes over its rows (what they take in memory) is most or less."""
    return F.broadcast(table) if (table.agg(F.sum(row_bytes)).first()[0] or 0) <= most else table


def ascii_lower(text):
    """A-Z lower-cased and nothing else; the JVM's own lower() does for texts of one byte a character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Bytes of an Arrow batch of texts; only a single longer row exceeds it.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; one that is lower already stays.

    Spark's own 64 MB stand several times in an executor, and in each Python worker, at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jsparkSession.sessionState().conf().getConfString(key).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_rows(df: DataFrame, fn, fields: str, text: str = "text", rows: int = 256) -> DataFrame:
    """fn over the texts of df, some rows at a time, in Python: (row, *fields).

    row is df's row as a struct, so nothing clashes; fn gets a list of texts (None where null) and returns a
    list of values for each field, in order.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    extra = _parse_datatype_string(fields)
    kinds = [f.type for f in to_arrow_schema(extra)]
    packed = df.select(F.struct("*").alias("row"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(pc.struct_field(part.column(0), text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], ["row", *extra.names])

    return packed.mapInArrow(run, StructType([*packed.schema.fields, *extra.fields]))


class Table(dict):
    """make(key) of each key that is asked for, kept up to so many bytes (keys and about 120 for an entry); beyond them it starts anew."""

    def __init__(self, make, most: int = 16 << 20):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        found = self.make(key)
        size = len(key) + 120
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        if size <= self.most:
            self.held += size
            self[key] = found
        return found


_slot: dict = {}


def worker_object(key, build):
    """What a worker process keeps for the operator at work: one object, dropped when another operator asks for its own."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = build()
    return _slot[key]


def word_hashes(text: str | None):
    """The hashes of the words of a text: lower-cased A-Z, cut at ASCII white space."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingled(words, size: int):
    """The 63-bit hash of the shingle that starts at each word; of fewer words than size, of all of them."""
    import numpy as np

    if not len(words):
        return np.empty(0, np.int64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n] ^ np.uint64(size)
    for j in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((out ^ (out >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternates large and small stars; each round sends every neighbour to the smallest one of its centre, so
    rounds grow with the logarithm of a component's size. Rounds are tables in the shared folder, and only
    their counts and sums reach the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        pairs, old = written(stars.where("u <> v").distinct(), "stars"), pairs
        if before is not None:
            forget(old)
        n, total = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
