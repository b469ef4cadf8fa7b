"""Lexicon work on lines and texts: roles, lookups, segmentation, composition, key/value batches."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.functions.runs import ENTRY_BYTES, Entries, hashed
from lexicarta.functions.trie import AT_ONCE, Syllables, pieces
from lexicarta.sources import files

#: A small lexicon of our own: roles of words, particles that words ask for, and known terms. All are parameters.
ROLES = {
    "action": ["add", "cancel", "change", "close", "copy", "create", "delete", "edit", "find", "help", "load", "open", "play", "save", "search", "send"],
    "property": ["big", "blue", "free", "full", "good", "green", "large", "new", "old", "red", "short", "small"],
    "music": ["album", "artist", "band", "music", "song", "voice"],
    "interface": ["button", "field", "form", "link", "list", "menu", "page", "tab", "title"],
}
CONNECTORS = {"and": "ဒီး", "of": "အ", "for": "လၢ", "in": "လၢ", "the": "တၢ်", "to": "ဆူ", "with": "ဒီး", "is": "မ့ၢ်"}
PARTICLE_OF_ROLE = {"property": "အ", "action": "တၢ်", "interface": "လၢ"}


def token_roles(token: Column, known: Column, roles: dict = ROLES, connectors: dict = CONNECTORS) -> Column:
    """All roles of a word in order; without any, content or function word."""
    suffix = F.endswith(token, F.lit("ing")) | F.endswith(token, F.lit("ed"))
    found = F.array_compact(
        F.array(
            F.when(token.isin(list(connectors)), "connector"),
            F.when(token.isin(roles["action"]) | suffix, "action"),
            *(F.when(token.isin(roles[r]), r) for r in ("property", "music", "interface")),
            F.when(known, "known-term"),
        )
    )
    return F.when(F.size(found) > 0, found).when(token.isin(text.STOPWORDS), F.array(F.lit("function-word"))).otherwise(F.array(F.lit("content-word")))


def suggest_particle(token: Column, roles: Column, connectors: dict = CONNECTORS) -> Column:
    """(particle, reason): a word's own particle, else that of its first role that has one."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for p in connectors.items() for x in p]), token)
    particle, reason = F.when(own.isNotNull(), own), F.when(own.isNotNull(), "trigger")
    for role, p in PARTICLE_OF_ROLE.items():
        has = F.array_contains(roles, role)
        particle, reason = particle.when(has, p), reason.when(has, role)
    return F.struct(particle.otherwise("").alias("particle"), reason.otherwise("none").alias("reason"))


def lookup_cascade(queries: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, query, result, source): of sources (query, result) in order the first with a result; each distinct query is looked up once."""
    found = queries.select("query").distinct()
    for k, (_, s) in enumerate(sources):
        found = found.join(s.groupBy("query").agg(F.min("result").alias(f"_r{k}")), "query", "left")
    got = F.coalesce(*(F.when(F.col(f"_r{k}") != "", F.struct(F.col(f"_r{k}").alias("result"), F.lit(name).alias("source"))) for k, (name, _) in enumerate(sources)))
    return queries.join(found.select("query", got.alias("g")), "query", "left").select("id", "query", "g.result", F.coalesce("g.source", F.lit("none")).alias("source"))


def lookup_sources(queries: DataFrame, seeds: DataFrame, connectors: DataFrame, cache: DataFrame, web: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, direction, query, result, source, asked) of queries (id, direction, query): where each is found first.

    Seeds (query, result) serve English queries, connectors (query, result) native ones, the cache (cache_key, result) both: its
    keys are `direction::query`, and for native queries the bare query too. Without those, the first two of web (name, table of
    direction, query, result) are both asked, the third only if the second has nothing, and the first with a result counts.
    asked lists whom a query was put to. Each distinct query is looked up once; of several results the smallest counts.
    """
    some = lambda df, *keys: df.where("result <> ''").groupBy(*keys).agg(F.min("result").alias("result"))
    to_native, found = F.col("direction") == "en-to-ksw", queries.select("direction", "query").distinct()
    keyed = found.withColumns({"_key": F.concat_ws("::", "direction", F.btrim("query")), "_seed": F.when(to_native, F.col("query")), "_conn": F.when(~to_native, F.col("query"))})
    named = {"seed": ("_seed", some(seeds, "query")), "connector": ("_conn", some(connectors, "query")), "cache": ("_key", some(cache.withColumnRenamed("cache_key", "query"), "query")), "legacy": ("_conn", some(cache.withColumnRenamed("cache_key", "query"), "query"))}
    for name, (key, df) in named.items():
        keyed = keyed.join(df.select(F.col("query").alias(key), F.col("result").alias(f"r_{name}")), key, "left")
    for k, (_, df) in enumerate(web):
        keyed = keyed.join(some(df, "direction", "query").withColumnRenamed("result", f"r_{k}"), ["direction", "query"], "left")
    hit = lambda column, source: F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("result"), F.lit(source).alias("source")))
    local = F.coalesce(*(hit(f"r_{n}", "cache" if n == "legacy" else n) for n in named))
    third = F.when(F.col("r_1").isNull(), hit("r_2", web[2][0]))
    got = F.coalesce(local, hit("r_0", web[0][0]), hit("r_1", web[1][0]), third)
    names = [n for n, _ in web]
    asked = F.when(local.isNotNull(), F.array().cast("array<string>")).when(F.col("r_1").isNull(), F.array(*map(F.lit, names))).otherwise(F.array(*map(F.lit, names[:2])))
    answers = keyed.select("direction", "query", got.alias("g"), asked.alias("asked"))
    return queries.join(answers, ["direction", "query"]).select("id", "direction", "query", "g.result", F.coalesce("g.source", F.lit("none")).alias("source"), "asked")


def connector_spans(texts: DataFrame, connectors: DataFrame, most_sent: int | None = None) -> DataFrame:
    """(doc_id, start, end, connector) of texts (doc_id, syllables; or doc_id, native): everywhere that a connector's syllables (connector, size) stand.

    The connectors go to the tasks as a table of hashes, and only what stands in a text is a row. More of them than most_sent bytes
    meet all runs in a join.
    """
    import pyarrow as pa

    known = connectors.where("size > 0 and connector <> ''").select(F.col("connector").alias("chunk"), F.col("size").cast("int").alias("n"))
    entries = files.written(known.select("chunk", F.col("chunk").alias("meaning")).distinct(), "connectors")
    sizes = sorted(r.n for r in known.select("n").distinct().collect())
    if table_bytes(entries) > (MOST_SENT if most_sent is None else most_sent):
        found = chunk_candidates(texts, max(sizes)).withColumn("n", F.col("end") - F.col("start"))
    else:
        sent = texts.sparkSession.sparkContext.broadcast(table_of(entries))

        def run(batches):
            for b, syllables in syllables_in(batches):
                by_size = sent.value.matches(syllables, max(sizes, default=0))
                for n in sizes:
                    at = np.flatnonzero(by_size[n - 1] >= 0)
                    row = np.searchsorted(syllables.rows, at, "right") - 1
                    start = (at - syllables.rows[row]).astype(np.int32)
                    chunks = sent.value.meanings.take(pa.array(by_size[n - 1][at]))
                    columns = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(start + np.int32(n)), pa.array(np.full(len(at), n, np.int32)), chunks]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "n", "chunk"])

        found = texts.mapInArrow(run, "doc_id long, start int, end int, n int, chunk string")
    return found.join(known, ["chunk", "n"]).select("doc_id", "start", "end", F.col("chunk").alias("connector"))


def chunk_candidates(texts: DataFrame, longest: int) -> DataFrame:
    """(doc_id, start, end, chunk): all runs of up to longest syllables of texts (doc_id, syllables; or doc_id, native)."""
    starts = with_syllables(texts).where(F.size("syllables") > 0).select("doc_id", "syllables", F.explode(F.sequence(F.lit(0), F.size("syllables") - 1)).alias("start"))
    ends = starts.select("*", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.size("syllables")))).alias("end"))
    return ends.select("doc_id", "start", "end", F.array_join(F.slice("syllables", F.col("start") + 1, F.col("end") - F.col("start")), "").alias("chunk"))


def chunk_counts(texts: DataFrame, longest: int) -> DataFrame:
    """(chunk, n, docs): how often each run of up to longest syllables stands in texts (doc_id, syllables; or doc_id, native), and in how many documents.

    Tasks count the runs of many texts at once, so what is grouped are a batch's distinct runs. Rows that share an id are one
    document: their runs are counted one by one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b, syllables in syllables_in(batches):
            places, row = np.arange(syllables.n), np.repeat(np.arange(b.num_rows), np.diff(syllables.rows))
            counts = pc.is_valid(b.column("doc_id")).to_numpy(zero_copy_only=False)
            by_size = [places[places + size <= syllables.row_end] for size in range(1, longest + 1)]
            starts, ends = np.concatenate(by_size), np.concatenate([at + size for size, at in enumerate(by_size, 1)])
            said = syllables.chunks(starts, ends).dictionary_encode()  # runs of different sizes may say the same
            code, distinct = said.indices.to_numpy().astype(np.int64), len(said.dictionary)
            pairs = np.unique(code * b.num_rows + row[starts])
            docs = np.bincount(pairs // b.num_rows, weights=counts[pairs % b.num_rows], minlength=distinct).astype(np.int64)
            yield pa.RecordBatch.from_arrays([said.dictionary, pa.array(np.bincount(code, minlength=distinct)), pa.array(docs)], ["chunk", "n", "docs"])

    shared = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")
    shared = files.written(shared, "shared-ids")
    out = texts.join(shared, "doc_id", "left_anti").mapInArrow(run, "chunk string, n long, docs long").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    if shared.isEmpty():
        return out
    several = chunk_candidates(texts.join(shared, "doc_id", "left_semi"), longest).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
    return out.unionByName(several).groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


PARTS = "array<struct<chunk:string,meaning:string,reason:string>>"
#: Bytes of a lexicon's table that is sent to the tasks; a larger lexicon meets the distinct runs of the texts in a join.
MOST_SENT = 256 << 20
#: Bytes of an Arrow batch of texts for the table function.
BATCH_BYTES = 4 << 20


def distinct_chunks(syllables: Column, longest: int) -> Column:
    """The distinct runs of up to longest syllables of one text."""
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size(syllables) - n), lambda i: F.array_join(F.slice(syllables, i + 1, n), ""))
    every = [F.when(F.size(syllables) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    return F.array_distinct(F.concat(*every))


def with_hits(texts: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """texts (doc_id, syllables) with the runs of each that the lexicon (chunk, meaning) has, by a join: a lexicon of any size serves.

    Rows meet their hits by what they say, each distinct text once, so ids may be null or repeat.
    """
    marks = [F.xxhash64("syllables").alias("h1"), F.xxhash64(F.lit(17), "syllables").alias("h2")]
    keyed = texts.select("doc_id", "syllables", *marks)
    once = keyed.groupBy("h1", "h2").agg(F.any_value("syllables").alias("syllables"))
    chunks = once.select("h1", "h2", F.explode(distinct_chunks(F.col("syllables"), longest)).alias("chunk"))
    hits = chunks.join(lexicon.select("chunk", "meaning"), "chunk").groupBy("h1", "h2").agg(F.collect_list(F.struct("chunk", "meaning")).alias("hits"))
    return keyed.join(hits, ["h1", "h2"], "left").select("doc_id", "syllables", "hits")


def entries_of(lexicon: DataFrame) -> DataFrame:
    """(chunk, meaning) of a lexicon as a written table, worked out once: an entry that comes twice has its first meaning by order."""
    known = lexicon.where("chunk <> '' and meaning is not null").groupBy("chunk").agg(F.min("meaning").alias("meaning"))
    return files.written(known, "lexicon")


def table_bytes(entries: DataFrame) -> int:
    """What the table of a lexicon's entries takes."""
    return entries.agg(F.sum(F.octet_length("meaning") + ENTRY_BYTES)).first()[0] or 0


def table_of(entries: DataFrame) -> Entries:
    """The table of a lexicon's entries; tasks make the hashes, so only these and the meanings come to the driver."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            first, second = hashed(b.column("chunk"))
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.astype(np.int64)), b.column("meaning")], ["first", "second", "meaning"])

    known = entries.select("chunk", "meaning").mapInArrow(run, "first long, second long, meaning string").toArrow().combine_chunks()
    first, second, meanings = (c.combine_chunks() for c in known.columns)
    return Entries(first.to_numpy().view(np.uint64), second.to_numpy().astype(np.uint32), meanings)


def syllables_in(batches, most: int = AT_ONCE):
    """Batches of texts in pieces of up to most syllables, each with its syllables: those of the column syllables, or what the column native says."""
    import pyarrow.compute as pc

    for batch in batches:
        native = "native" in batch.schema.names
        sizes = pc.divide(pc.utf8_length(batch.column("native")), 2) if native else pc.list_value_length(batch.column("syllables"))  # few native syllables have one letter
        for b in pieces(batch, pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), most):
            yield b, Syllables.of_texts(b.column("native")) if native else Syllables(b.column("syllables"))


def with_syllables(texts: DataFrame) -> DataFrame:
    """(doc_id, syllables) of texts that have either syllables or native text."""
    return texts.select("doc_id", text.split_syllables(F.col("native")).alias("syllables")) if "native" in texts.columns else texts.select("doc_id", "syllables")


def parts_of(syllables: Syllables, known: Entries, pick):
    """The parts of each text of a batch, as a list array: pick(syllables, known) says where they start and end, the entries that they are and their reasons."""
    import pyarrow as pa
    import pyarrow.compute as pc

    starts, ends, entry, reasons = pick(syllables, known)
    said = pc.fill_null(known.meanings.take(pa.array(entry, mask=entry < 0)), "??")
    flat = pa.StructArray.from_arrays([syllables.chunks(starts, ends), said, reasons], ["chunk", "meaning", "reason"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, syllables.rows), pa.int32()), flat)


def segmented(texts: DataFrame, lexicon: DataFrame, longest: int, pick, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, parts) of texts (doc_id, syllables; or doc_id, native), a row for each, whatever its id; null or empty texts have no parts.

    pick(syllables, known) gives the parts of a batch: where they start and end, the entries that they are (-1 where none is)
    and their reasons. The table known holds the whole lexicon if it takes most_sent bytes or less, else what the batch's texts have runs of.
    """
    import pyarrow as pa

    entries = entries_of(lexicon)
    small = table_bytes(entries) <= most_sent
    sent = texts.sparkSession.sparkContext.broadcast(table_of(entries) if small else None)
    rows = texts.select("doc_id", "native" if "native" in texts.columns else "syllables") if small else with_hits(with_syllables(texts), entries, longest)

    def run(batches):
        for b, syllables in syllables_in(batches):
            if small:
                known = sent.value
            else:
                found = {h["chunk"]: h["meaning"] for hits in b.column("hits").to_pylist() for h in hits or ()}
                known = Entries.of(list(found), list(found.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), parts_of(syllables, known, pick)], ["doc_id", "parts"])

    return rows.mapInArrow(run, f"doc_id long, parts {PARTS}")


def walked(ends: np.ndarray) -> np.ndarray:
    """The places that are reached from the first one, each going on to its end."""
    to, at, out = ends.tolist(), 0, []
    while at < len(to):
        out.append(at)
        at = to[at]
    return np.array(out, np.int64)


def greedy_parts(syllables: Syllables, known: Entries, longest: int):
    """From the left, the longest run in the lexicon, of longest syllables at most, else one syllable."""
    import pyarrow as pa

    step, entry = np.ones(syllables.n, np.int64), np.full(syllables.n, -1, np.int64)
    for k, found in enumerate(known.matches(syllables, longest), 1):
        hit = np.flatnonzero(found >= 0)
        step[hit], entry[hit] = k, found[hit]
    starts = walked(np.arange(syllables.n) + step)
    reasons = pa.array(["stuck", "longest"]).take(pa.array((entry[starts] >= 0).astype(np.int8)))
    return starts, starts + step[starts], entry[starts], reasons


def segment_greedy(texts: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(doc_id, parts): from the left, the longest run in the lexicon, of longest syllables at most, else one syllable with `??`."""
    return segmented(texts, lexicon, longest, lambda syllables, known: greedy_parts(syllables, known, longest))


#: What the parts of segment() are, in the order in which they are tried.
REASONS = ["rest", "before connector", "through connector", "connector and after", "between connectors", "longest", "stuck"]


#: Syllables from one place to the next from which parts are followed, and rounds after which all places that are left are decided at once.
STRIDE, ROUNDS = 32, 256


def followed(rows: np.ndarray, decide) -> np.ndarray:
    """The places that are reached from the starts of the rows; decide(at) says where the parts of places end.

    What a place's part is doesn't depend on how it was reached. So parts are followed from many places at once, until they come to a
    place that is decided: ways from near places soon meet, and most places are on none.
    """
    n = int(rows[-1])
    last, done = np.arange(n) + 1, np.zeros(n + 1, bool)
    done[n] = True
    at = np.unique(np.concatenate([rows[:-1][rows[:-1] < n], np.arange(0, n, STRIDE)]))
    for left in range(ROUNDS, -1, -1):
        done[at] = True
        last[at] = decide(at)
        at = np.unique(last[at]) if left > 1 else np.arange(n)
        at = at[~done[at]]
        if not len(at):
            break
    return walked(last)


def connected_parts(syllables: Syllables, known: Entries, connectors: dict[str, int], longest: int, surely: bool = False):
    """The parts that segment() describes, of each text of a batch: parts of many places at once, of those that are reached.

    The first hashes of runs decide; should the second one of a part say otherwise, all is done again with both, surely.
    """
    import pyarrow as pa

    n, rows, end = syllables.n, syllables.rows, syllables.row_end
    widest = max(connectors.values(), default=1)
    held = known.held(syllables, longest, surely).ravel()
    width, stuck = longest + 1, len(REASONS) - 1

    def run(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return held[a * width + np.minimum((z - a - 1).view(np.uint64), np.uint64(longest)).view(np.int64)]

    names = Entries.of(list(connectors), list(connectors))
    sizes = np.array([connectors[c] for c in names.meanings.to_pylist()], np.int64)
    standing = []
    for k in range(1, widest + 1):
        places, name = names.standing(syllables, k)
        standing.append(places[sizes[name] == k])
    starts, stops = np.concatenate(standing), np.concatenate([places + k for k, places in enumerate(standing, 1)])
    order = np.lexsort((-stops, starts))
    starts, stops = starts[order], stops[order]
    last_span = np.searchsorted(starts, rows[1:])  # of each text, behind its last span
    first_span = np.concatenate([[0], last_span[:-1]]).astype(np.int64)
    of_row = np.searchsorted(rows, starts, "right") - 1
    later = np.searchsorted(starts, stops, "right")
    after = np.where(later < last_span[of_row], np.append(starts, 0)[later], end[starts]) if len(starts) else starts
    numbers = np.arange(len(starts))
    next_between = np.minimum.accumulate(np.where(run(stops, after), numbers, len(starts))[::-1])[::-1] if len(starts) else numbers

    first, last, why = np.arange(n), np.arange(n) + 1, np.full(n, stuck, np.int8)

    def take(at: np.ndarray, a: np.ndarray, z: np.ndarray, reason: str) -> np.ndarray:
        """Places at whose run from a to z is in the lexicon have their part; which of them still have none."""
        has = run(a, z)
        hit = at[has]
        first[hit], last[hit], why[hit] = a[has], z[has], REASONS.index(reason)
        return np.flatnonzero(~has)

    def decide(places: np.ndarray) -> np.ndarray:
        at = places[take(places, places, end[places], "rest")]
        row = np.searchsorted(rows, at, "right") - 1
        k, most = np.maximum(np.searchsorted(starts, at - widest), first_span[row]), last_span[row]
        rest = []
        while len(at):
            near = k < most
            rest.append(at[~near])
            at, k, most = at[near], k[near], most[near]
            far = starts[k] > at + longest
            nb = next_between[k[far]]
            some = nb < most[far]
            rest.append(at[far][~some])
            take(at[far][some], stops[nb[some]], after[nb[some]], "between connectors")
            at, k, most = at[~far], k[~far], most[~far]
            a, z, stop, ahead = starts[k], stops[k], after[k], stops[k] > at
            for reason, x, y, may in (("before connector", at, a, ahead & (a > at)), ("through connector", at, z, ahead), ("connector and after", at, stop, ahead & (a == at)), ("between connectors", z, stop, ahead)):
                left = np.flatnonzero((why[at] == stuck) & may)
                take(at[left], x[left], y[left], reason)
            left = why[at] == stuck
            at, k, most = at[left], k[left] + 1, most[left]
        at = np.concatenate(rest) if rest else at
        for size in range(longest, 0, -1):
            at = at[take(at, at, at + size, "longest")]
        return last[places]

    reached = followed(rows, decide)
    first, last, why = first[reached], last[reached], why[reached]
    part, entry = np.flatnonzero(why != stuck), np.full(len(reached), -1, np.int64)
    entry[part] = known.at(syllables, first[part], last[part])
    if not surely and (entry[part] < 0).any():
        return connected_parts(syllables, known, connectors, longest, surely=True)
    return first, last, entry, pa.array(REASONS).take(pa.array(why))


def segment(texts: DataFrame, lexicon: DataFrame, connectors: dict[str, int], longest: int) -> DataFrame:
    """(doc_id, parts) with connectors (and their numbers of syllables) first.

    From each place, of runs in the lexicon come first the rest of the text, then runs around each later connector in turn, then
    the longest. Runs around a connector end where it starts, where it ends, or where the next one starts after it. A run
    between connectors starts behind its connector, and what stands before it is taken along. Runs are of longest
    syllables at most, so beyond that only the next run between connectors matters: the work grows with the text.
    """
    return segmented(texts, lexicon, longest, lambda syllables, known: connected_parts(syllables, known, connectors, longest))


def at_most(spark: SparkSession, key: str, size: int) -> None:
    """Lowers a bound of the session on bytes to size; one that is lower already stays."""
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def register_segment_text(spark: SparkSession, lexicon: DataFrame, connectors: dict[str, int], longest: int, name: str = "segment_text", most_sent: int = MOST_SENT) -> None:
    """segment() as a table function for SQL: name(text) gives the parts (place, chunk, meaning, reason) of a native text, none of a null one.

    `SELECT d.id, s.* FROM docs d, LATERAL segment_text(d.text) s`. name_parts(text) gives them as an array, for all texts of an Arrow batch
    at once; the batches of the session are held to BATCH_BYTES, as a batch's parts are several times its texts. The lexicon goes to
    each worker once; one whose table takes more than most_sent bytes is refused: such texts go through segment(), which joins.
    """
    import pyarrow as pa

    entries = entries_of(lexicon)
    if table_bytes(entries) > most_sent:
        raise ValueError("the lexicon is too large to be sent; use segment()")
    sent = spark.sparkContext.broadcast(table_of(entries))

    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            pick = lambda syllables, known: connected_parts(syllables, known, connectors, longest)
            texts = pa.record_batch([column.cast(pa.string())], ["native"])
            done = [parts_of(syllables, sent.value, pick) for _, syllables in syllables_in([texts])]
            yield pa.concat_arrays(done or [parts_of(Syllables.of_texts(pa.array([], pa.string())), sent.value, pick)])

    at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.udf.register(f"{name}_parts", F.arrow_udf(parts, PARTS))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(native STRING) RETURNS TABLE (place INT, chunk STRING, meaning STRING, reason STRING)
        RETURN SELECT place, part.chunk, part.meaning, part.reason FROM posexplode({name}_parts(native)) AS t(place, part)""")


def unresolved(parts: DataFrame) -> DataFrame:
    """(chunk, n): syllables that nothing matched, counted."""
    return parts.select(F.explode("parts").alias("p")).where("p.meaning = '??'").groupBy("p.chunk").agg(F.count(F.lit(1)).alias("n"))


def compose(queries: DataFrame, phrases: DataFrame, terms: DataFrame, special: list[tuple[list[str], list[str], str]] = ()) -> DataFrame:
    """(id, result, missing, how) of queries (id, normal, tokens): the phrase's own entry, else a special phrase, else the known terms in order and what is missing.

    special holds (words that must all be there, words of which one must be, native phrase); the first that fits counts.
    """
    words = queries.select("id", F.posexplode("tokens").alias("pos", "token")).join(terms.select("token", "native"), "token", "left")
    joined = words.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("native").isNotNull(), F.struct("pos", "native")))), lambda x: x["native"]), "").alias("terms"),
        F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("native").isNull(), F.struct("pos", "token")))), lambda x: x["token"])), " ").alias("missing"),
    )
    rows = queries.join(phrases.select("normal", F.col("native").alias("phrase")), "normal", "left").join(joined, "id", "left")
    inferred = F.lit(None).cast("string")
    for every, some, native in reversed(special):
        fits = F.size(F.array_intersect("tokens", F.array(*map(F.lit, every)))) == len(set(every))
        inferred = F.when(fits & F.arrays_overlap("tokens", F.array(*map(F.lit, some))) if some else fits, native).otherwise(inferred)
    whole = F.coalesce(F.col("phrase"), inferred)
    got = F.coalesce(whole, F.nullif("terms", F.lit("")), F.lit("unresolved"))
    how = F.when(F.col("phrase").isNotNull(), "phrase").when(inferred.isNotNull(), "special").when(F.coalesce("terms", F.lit("")) != "", "terms").otherwise("none")
    return rows.select("id", got.alias("result"), F.when(whole.isNull(), F.coalesce("missing", F.lit(""))).otherwise("").alias("missing"), how.alias("how"))


def compose_from_tokens(rows: DataFrame, fallback: str) -> DataFrame:
    """(id, result, used) of rows (id, place, word, known, found): what is known or found of each word, if native, in order; else the fallback."""
    native = F.coalesce(F.nullif("known", F.lit("")), F.col("found"))
    good = F.when(native.rlike(text.NATIVE_LETTER), F.struct("place", "word", native.alias("native")))
    parts = rows.groupBy("id").agg(F.sort_array(F.collect_list(good)).alias("p"))
    return parts.select("id", F.when(F.size("p") > 0, F.array_join("p.native", "")).otherwise(fallback).alias("result"), F.array_join("p.word", " ").alias("used"))


def token_analysis(queries: DataFrame, known: DataFrame, most: int = 12, pair: tuple[str, str] = ("new", "song")) -> DataFrame:
    """(id, place, word, source, roles, particle, known, goal) of queries (id, tokens, keywords): a row for each token, then for most keywords that are no tokens.

    goal is the tokens as one line; if both words of the pair are among the words, the second comes with the first behind it.
    """
    more = F.slice(F.array_except(F.coalesce("keywords", F.array().cast("array<string>")), F.col("tokens")), 1, most)
    rows = queries.withColumn("words", F.concat("tokens", more))
    first, second = pair
    both = F.array_contains("words", first) & F.array_contains("words", second)
    goal = F.array_join(F.when(both, F.transform("tokens", lambda t: F.when(t == second, f"{second} {first}").otherwise(t))).otherwise(F.col("tokens")), " ")
    out = rows.select("id", "tokens", goal.alias("goal"), F.posexplode("words").alias("place", "word")).join(known.select(F.col("token").alias("word"), F.col("native").alias("known")), "word", "left")
    out = out.withColumn("roles", token_roles(F.col("word"), F.col("known").isNotNull()))
    source = F.when(F.col("place") < F.size("tokens"), "input").otherwise("context")
    return out.select("id", "place", "word", source.alias("source"), "roles", suggest_particle(F.col("word"), F.col("roles"))["particle"].alias("particle"), F.coalesce("known", F.lit("")).alias("known"), "goal")


def token_lookup(queries: DataFrame, known: DataFrame, most: int = 18) -> DataFrame:
    """(id, token, place, decision): the distinct words of each of queries (id, tokens), with what is to be done about each."""
    kept = F.slice(F.filter(F.array_distinct("tokens"), lambda t: (F.length(t) >= 2) & ~t.isin(text.STOPWORDS)), 1, most)
    rows = queries.select("id", F.posexplode(kept).alias("place", "token")).join(known.select("token", "native"), "token", "left")
    return rows.select("id", "token", "place", F.when(F.col("native").isNotNull(), "known").when(F.length("token") > 12, "context only").otherwise("look up").alias("decision"))


def kv_classify(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, raw) with their kind: keep, fill (a key without a value), parse (native on either side or alone)."""
    parts = F.split("raw", "=", 2)
    left, right = F.btrim(parts[0]), F.btrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    bare = F.btrim("raw")
    has = lambda c: c.rlike(text.NATIVE_LETTER)
    kind = (
        F.when((bare == "") | bare.startswith("#"), "keep")
        .when(F.contains("raw", F.lit("=")), F.when(left.rlike(text.LATIN_LETTER) & (right == ""), "fill").when(has(left) | has(right), "parse").otherwise("keep"))
        .when(has(bare), "parse")
        .otherwise("keep")
    )
    return lines.select("*", left.alias("left"), right.alias("right"), kind.alias("kind"))


def kv_translate(lines: DataFrame, known: DataFrame, glosses: DataFrame, longest: int = 6) -> DataFrame:
    """(file, line_no, kind, output, analysis): keys without a value filled in, native texts parsed, other lines as they are.

    known (query, result) fills keys; glosses (chunk, meaning) parse. All lines of a kind go through one join.
    """
    rows = kv_classify(lines)
    keep = rows.where("kind = 'keep'").select("file", "line_no", "kind", F.col("raw").alias("output"), F.lit(None).cast("string").alias("analysis"))
    fill = rows.where("kind = 'fill'").join(known.groupBy("query").agg(F.min("result").alias("result")), F.lower("left") == F.col("query"), "left")
    fill = fill.select("file", "line_no", "kind", F.concat("left", F.lit(" = "), F.coalesce("result", F.lit("unresolved"))).alias("output"), F.concat(F.lit("# "), "left", F.lit(" -> "), F.coalesce("result", F.lit("unresolved"))).alias("analysis"))
    native = F.when(F.col("right").rlike(text.NATIVE_LETTER), F.col("right")).when(F.col("left").rlike(text.NATIVE_LETTER), F.col("left")).otherwise(F.col("raw"))
    parse = rows.where("kind = 'parse'").withColumn("doc_id", F.xxhash64("file", "line_no")).withColumn("native", native)
    parts = segment_greedy(parse.select("doc_id", "native"), glosses, longest)
    joined = parse.join(parts, "doc_id")
    gloss = text.short_gloss(F.col("parts.meaning"))
    shown = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("("), p["chunk"], F.lit(": "), p["meaning"], F.lit(")"))), " + ")
    joined = joined.select("file", "line_no", "kind", F.col("raw").alias("output"), F.concat(F.lit("# "), "native", F.lit(" -> "), gloss, F.lit(" "), shown).alias("analysis"))
    return keep.unionByName(fill).unionByName(joined)


def kv_output(rows: DataFrame) -> DataFrame:
    """(file, section, line_no, text): output lines in order (section 0), then the analysis lines (section 1), to be sorted by the three."""
    out = rows.select("file", F.lit(0).alias("section"), "line_no", F.col("output").alias("text"))
    notes = rows.where("analysis is not null").select("file", F.lit(1).alias("section"), "line_no", F.col("analysis").alias("text"))
    return out.unionByName(notes)


def kv_batch_stats(rows: DataFrame) -> DataFrame:
    """Of each file: lines, lines that hold something, changed and parsed ones."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.btrim("raw") != "").alias("processed"), F.count_if(F.col("kind") == "fill").alias("changed"), F.count_if(F.col("kind") == "parse").alias("parsed")
    )


def line_status(events: DataFrame) -> DataFrame:
    """(line, status, n, sources): of each line the last status that counts, and its first 80 events' sources."""
    counts = events.where(F.col("status").isin("match", "fallback", "stuck"))
    last = counts.groupBy("line").agg(F.max_by("status", "seq").alias("status"))
    rank = F.row_number().over(Window.partitionBy("line").orderBy("seq"))
    some = events.withColumn("n", rank).where("n <= 80").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return some.join(last, "line", "left").select("line", F.coalesce("status", F.lit("pending")).alias("status"), "n", "sources")


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """(stage, attempts, sources, last_seen) of attempts (stage, source, ts)."""
    return attempts.groupBy("stage").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("source").alias("sources"), F.max("ts").alias("last_seen"))


def tail_n(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cache_latest(updates: DataFrame) -> DataFrame:
    """The latest value of each key of updates (cache_key, result, updated_at)."""
    return updates.groupBy("cache_key").agg(F.max_by("result", F.struct("updated_at", "result")).alias("result"), F.max("updated_at").alias("updated_at"))


#: Where candidates stand in a page, in order: tag, class and attribute that an element must have (fixed values).
SELECTORS = [
    ("span", "translation__snippet", None), (None, None, ("data-element", "phraseTranslation")), (None, "translation", None),
    ("li", None, None), ("p", None, None), ("h2", None, None), ("h3", None, None),
]
#: Pages that a task holds as Python objects at a time.
PAGES = 64
#: The element whose strong texts come first, and elements that never hold anything (fixed values).
SUMMARY = "content-summary"
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def html_candidates(pages: DataFrame, direction: str = "ksw-to-en", most: int = 8) -> DataFrame:
    """(page_id, candidates) of pages (page_id, html, and query if there): the first texts that may be translations of the query.

    First the strong texts of the page's summary but the query itself, then what each selector finds, one after the other and each in document
    order; of pages with fewer than three such texts, then all their lines. Texts come once, stripped of bullets, and
    in one script where both are mixed. A null page has none.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    asked = pages.select("page_id", "html", (F.col("query") if "query" in pages.columns else F.lit("")).alias("query"))

    def run(batches):
        for b in (batch.slice(k, PAGES) for batch in batches for k in range(0, batch.num_rows, PAGES)):
            said = [None if h is None else candidate_texts(h, q or "") for h, q in zip(b.column("html").to_pylist(), b.column("query").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(said, pa.list_(pa.string()))], ["page_id", "texts"])

    found = asked.mapInArrow(run, StructType([asked.schema["page_id"], StructField("texts", ArrayType(StringType()))]))
    rows = found.select("page_id", F.posexplode("texts").alias("pos", "t"))
    plain = F.btrim("t", F.lit(" -*•|"))
    mixed = plain.rlike(text.NATIVE_LETTER) & plain.rlike(text.LATIN_LETTER)
    alone = text.clean_visible_text(F.btrim(F.regexp_replace(plain, text.NATIVE_LETTER, " "), F.lit(" -*•|·,;:")))
    kept = rows.withColumn("t", F.when(mixed, alone).otherwise(plain) if direction == "ksw-to-en" else plain).where(text.is_useful_result(F.col("t"), F.lit(direction)))
    first = kept.groupBy("page_id", "t").agg(F.min("pos").alias("pos"))
    return first.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "t"))), 1, most)["t"].alias("candidates"))


class Element:
    """An element of a page: its strings are those from one number on to another, in document order."""

    def __init__(self, tag: str, marks: dict, start: int):
        self.tag, self.marks, self.start, self.end = tag, marks, start, None

    def fits(self, tag, of_class, mark) -> bool:
        if tag and self.tag != tag or of_class and of_class not in (self.marks.get("class") or "").split():
            return False
        return not mark or self.marks.get(mark[0]) == mark[1]


def page_tree(html: str) -> tuple[list[Element], list[str]]:
    """The elements of a page and its visible strings, stripped, both in document order. An end tag closes all that is open inside of its element."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.elements, self.strings, self.open, self.held = [], [], [], []

        def flush(self):
            piece = "".join(self.held).strip()
            if piece and not any(e.tag in ("script", "style", "template") for e in self.open):
                self.strings.append(piece)
            self.held.clear()

        def handle_starttag(self, tag, attrs):
            self.flush()
            made = Element(tag, dict(reversed(attrs)), len(self.strings))
            self.elements.append(made)
            if tag in VOID:
                made.end = made.start
            else:
                self.open.append(made)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

        def handle_endtag(self, tag):
            self.flush()
            if any(e.tag == tag for e in self.open):
                while (last := self.open.pop()).tag != tag:
                    last.end = len(self.strings)
                last.end = len(self.strings)

        def handle_data(self, data):
            self.held.append(data)

        def handle_comment(self, data):
            self.flush()

        handle_decl = handle_pi = unknown_decl = handle_comment

    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    for e in tree.open:
        e.end = len(tree.strings)
    return tree.elements, tree.strings


def candidate_texts(html: str, query: str) -> list[str]:
    """The texts of the summary and of the selectors' elements, squeezed, in order; of pages with fewer than three, all lines after them."""
    elements, strings = page_tree(html)
    squeezed = lambda parts: " ".join(" ".join(parts).split())
    of = lambda e: squeezed(strings[e.start : e.end])
    found: list[str] = []
    at = next((k for k, e in enumerate(elements) if e.marks.get("id") == SUMMARY), None)
    if at is not None:
        inside = [e for e in elements[at + 1 :] if e.end <= elements[at].end and e.start >= elements[at].start and e.tag == "strong"]
        found = [t for t in map(of, inside) if t and t.lower() != query.lower()]
    for rule in SELECTORS:
        found += [t for e in elements if e.fits(*rule) and (t := of(e))]
    return found if len(found) >= 3 else found + [t for s in strings for line in s.splitlines() if (t := squeezed([line]))]
