"""Queries of lexicon work."""

from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.operators import lexicon as ops
from lexicarta.plans import bindings as b
from lexicarta.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def listed(xs):
    return ", ".join(f"'{x}'" for x in xs)


KNOWN = "known AS (SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"


def known(spark, d):
    """(token, native): the words of part names."""
    w = b.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    return w.withColumn("native", F.translate("token", b.LATIN, b.NATIVE))


def word_counts(spark, d):
    """(query, n): words and how often they occur, worked out once for all sources."""
    return files.written(b.words(spark, d).groupBy(F.col("word").alias("query")).agg(F.count(F.lit(1)).alias("n")), "counts")


R = ops.ROLES
ROLE_SQL = f"""list_filter([CASE WHEN token IN ({listed(ops.CONNECTORS)}) THEN 'connector' END, CASE WHEN token IN ({listed(R['action'])}) OR token LIKE '%ing' OR token LIKE '%ed' THEN 'action' END,
  CASE WHEN token IN ({listed(R['property'])}) THEN 'property' END, CASE WHEN token IN ({listed(R['music'])}) THEN 'music' END, CASE WHEN token IN ({listed(R['interface'])}) THEN 'interface' END,
  CASE WHEN k THEN 'known-term' END], lambda x: x IS NOT NULL)"""


@query("token_roles", "WITH " + b.WORDS + ", " + KNOWN + f""", v AS (SELECT word AS token, count(*) AS n FROM words GROUP BY word), j AS (SELECT v.*, known.token IS NOT NULL AS k FROM v LEFT JOIN known USING (token)), r AS (SELECT token, n, {ROLE_SQL} AS rs FROM j)
SELECT token, n, CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') WHEN token IN ({listed(text.STOPWORDS)}) THEN 'function-word' ELSE 'content-word' END AS roles,
  CASE {' '.join(f"WHEN token = '{k}' THEN '{v}'" for k, v in ops.CONNECTORS.items())} {' '.join(f"WHEN list_contains(rs, '{k}') THEN '{v}'" for k, v in ops.PARTICLE_OF_ROLE.items())} ELSE '' END AS particle FROM r""")
def token_roles(spark, d):
    v = b.words(spark, d).groupBy(F.col("word").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    rows = v.join(known(spark, d), "token", "left").withColumn("roles", ops.token_roles(F.col("token"), F.col("native").isNotNull()))
    return rows.select("token", "n", F.array_join("roles", ",").alias("roles"), ops.suggest_particle(F.col("token"), F.col("roles"))["particle"].alias("particle"))


@query("lookup_cascade", "WITH " + b.WORDS + ", " + KNOWN + f""", q AS (SELECT DISTINCT doc_id, word FROM words), seed AS (SELECT token, 'seed-' || token AS r FROM known),
cache AS (SELECT word, 'cache-' || word AS r FROM words GROUP BY word HAVING count(*) % 2 = 0), web AS (SELECT word, CASE WHEN length(word) > 6 THEN '' ELSE 'web-' || word END AS r FROM words GROUP BY word)
SELECT doc_id AS id, q.word AS query, coalesce(seed.r, cache.r, nullif(web.r, '')) AS result, CASE WHEN seed.r IS NOT NULL THEN 'seed' WHEN cache.r IS NOT NULL THEN 'cache' WHEN web.r <> '' THEN 'web' ELSE 'none' END AS source
FROM q LEFT JOIN seed ON q.word = seed.token LEFT JOIN cache ON q.word = cache.word LEFT JOIN web ON q.word = web.word""")
def lookup_cascade(spark, d):
    queries = b.distinct_words(spark, d).select(F.col("doc_id").alias("id"), F.col("word").alias("query"))
    counts = word_counts(spark, d)
    seed = known(spark, d).select(F.col("token").alias("query"), F.concat(F.lit("seed-"), "token").alias("result"))
    cache = counts.where("n % 2 = 0").select("query", F.concat(F.lit("cache-"), "query").alias("result"))
    web = counts.select("query", F.when(F.length("query") > 6, "").otherwise(F.concat(F.lit("web-"), "query")).alias("result"))
    return ops.lookup_cascade(queries, [("seed", seed), ("cache", cache), ("web", web)])


@query("lookup_sources", "WITH " + b.WORDS + ", " + KNOWN + """, q AS (SELECT DISTINCT doc_id, CASE WHEN pos % 2 = 0 THEN 'en-to-ksw' ELSE 'ksw-to-en' END AS direction, word FROM words), c AS (SELECT word, count(*) AS n, length(word) AS size FROM words GROUP BY word),
l AS (SELECT q.*, CASE WHEN direction = 'en-to-ksw' AND k.token IS NOT NULL THEN 'seed' WHEN direction = 'ksw-to-en' AND n % 7 = 0 THEN 'connector' WHEN n % 3 = 0 OR direction = 'ksw-to-en' AND n % 3 = 1 AND n % 2 = 0 THEN 'cache' ELSE '' END AS local, n, size FROM q JOIN c USING (word) LEFT JOIN known k ON k.token = q.word),
w AS (SELECT *, CASE WHEN local <> '' THEN local WHEN size < 4 THEN 'one' WHEN size < 7 THEN 'two' WHEN size < 9 THEN 'three' ELSE 'none' END AS source FROM l)
SELECT doc_id AS id, direction, word AS query, CASE source WHEN 'none' THEN NULL ELSE source || '-' || word END AS result, source, CASE WHEN local <> '' THEN '' WHEN size < 7 THEN 'one,two' ELSE 'one,two,three' END AS asked FROM w""")
def lookup_sources(spark, d):
    queries = b.distinct_words(spark, d, sides=True).select(F.col("doc_id").alias("id"), F.when(F.col("even"), "en-to-ksw").otherwise("ksw-to-en").alias("direction"), F.col("word").alias("query"))
    counts = word_counts(spark, d)
    says = lambda name: F.concat(F.lit(f"{name}-"), "query").alias("result")
    seeds = known(spark, d).select(F.col("token").alias("query")).select("query", says("seed"))
    keyed = counts.where("n % 3 = 0").crossJoin(F.broadcast(spark.createDataFrame([("en-to-ksw",), ("ksw-to-en",)], "direction string")))  # two rows
    cache = keyed.select(F.concat_ws("::", "direction", "query").alias("cache_key"), says("cache")).unionByName(counts.where("n % 3 = 1 and n % 2 = 0").select(F.col("query").alias("cache_key"), says("cache")))
    both = F.explode(F.array(F.lit("en-to-ksw"), F.lit("ksw-to-en"))).alias("direction")
    size = F.length("query")
    web = [("one", size < 4), ("two", (size < 7)), ("three", size < 9)]
    return ops.lookup_sources(queries, seeds, counts.where("n % 7 = 0").select("query", says("connector")), cache, [(n, counts.where(c).select(both, "query", says(n))) for n, c in web]).withColumn("asked", F.array_join("asked", ","))


def native_texts(spark, d):
    """(doc_id, native): each document in native letters."""
    return b.documents(spark, d).select("doc_id", F.translate(F.lower("text"), b.LATIN, b.NATIVE).alias("native"))


SYL_SQL = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace({t}, '[^က-႟]+', ' ', 'g'), '([" + text.CONSONANTS + "])', ' \\1', 'g')), ' '), lambda x: x <> ''), ' ')"
SYLLABLES = f""", t0 AS (SELECT doc_id, translate(lower(text), '{b.LATIN}', '{b.NATIVE}') AS t FROM documents),
sl AS (SELECT doc_id, list_filter(string_split({SYL_SQL.format(t='t')}, ' '), lambda x: x <> '') AS s FROM t0),
sy AS (SELECT doc_id, unnest(s) AS s1, unnest(range(len(s))) AS st FROM sl),
g0 AS (SELECT doc_id, st, s1, lead(s1) OVER w AS s2, lead(s1, 2) OVER w AS s3 FROM sy WINDOW w AS (PARTITION BY doc_id ORDER BY st)),
g AS (SELECT doc_id, st, 1 AS n, s1 AS chunk FROM g0 UNION ALL SELECT doc_id, st, 2, s1 || s2 FROM g0 WHERE s2 IS NOT NULL UNION ALL SELECT doc_id, st, 3, s1 || s2 || s3 FROM g0 WHERE s3 IS NOT NULL)"""


def connectors(spark):
    """Connectors as rows: one, two and three syllables of the bindings' alphabet."""
    return spark.createDataFrame(list(CONNECTORS.items()), "connector string, size int")


CONNECTORS = {"တံ": 1, "တ": 1, "ဒ": 1, "ကါ": 1, "ဒါတ": 2, "ပါတံ": 2}


CONN = "conn(connector, size) AS (VALUES ('တံ', 1), ('တ', 1), ('ဒ', 1), ('ကါ', 1), ('ဒါတ', 2), ('ပါတံ', 2))"


@query("connector_spans", "WITH " + CONN + SYLLABLES + """
SELECT doc_id, CAST(st AS INTEGER) AS start, CAST(st + n AS INTEGER) AS "end", connector FROM g JOIN conn ON chunk = connector AND n = size""")
def connector_spans(spark, d):
    return ops.connector_spans(native_texts(spark, d), connectors(spark))


@query("chunk_candidates", "WITH x AS (SELECT 1)" + SYLLABLES + " SELECT chunk, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY chunk")
def chunk_candidates(spark, d):
    return ops.chunk_counts(native_texts(spark, d), 3)


def lexicon(spark, d):
    """(chunk, meaning): native words that occur often enough, glossed with the words that they stand for."""
    return b.vocabulary(spark, d).where("n >= 3 and length(word) >= 2").groupBy(F.col("native").alias("chunk")).agg(F.min("word").alias("meaning"))


@query("segment")
def segment(spark, d):
    parts = ops.segment(native_texts(spark, d), lexicon(spark, d), CONNECTORS, 6)
    return parts.select("doc_id", F.to_json("parts").alias("parts"), text.short_gloss(F.col("parts.meaning")).alias("gloss"))


@query("segment_text")
def segment_text(spark, d):
    """Each document's parts by the table function, in SQL."""
    ops.register_segment_text(spark, lexicon(spark, d), CONNECTORS, 6)
    return spark.sql("SELECT doc_id, place, chunk, meaning, reason FROM {native} d, LATERAL segment_text(d.native)", native=native_texts(spark, d))


@query("segment_greedy")
def segment_greedy(spark, d):
    return ops.segment_greedy(native_texts(spark, d), lexicon(spark, d), 6).select("doc_id", F.to_json("parts").alias("parts"))


@query("unresolved")
def unresolved(spark, d):
    return ops.unresolved(ops.segment_greedy(native_texts(spark, d), lexicon(spark, d), 6))


@query("translate_text")
def translate_text(spark, d):
    """Lines by direction: native ones segmented, others composed from known terms."""
    lines = b.lines(spark, d).withColumn("t", F.when(F.col("line_no") % 2 == 1, F.translate(F.lower("raw"), b.LATIN, b.NATIVE)).otherwise(F.col("raw")))
    lines = lines.withColumn("direction", text.detect_direction(F.col("t"))).withColumn("id", F.xxhash64("file", "line_no"))
    native = lines.where("direction = 'ksw-to-en'").select(F.col("id").alias("doc_id"), F.col("t").alias("native"))
    parsed = ops.segment_greedy(native, lexicon(spark, d), 6).select(F.col("doc_id").alias("id"), text.short_gloss(F.col("parts.meaning")).alias("result"))
    asked = lines.where("direction = 'en-to-ksw'").select("id", text.normalise_english(F.col("t")).alias("normal"), text.split_tokens(F.col("t")).alias("tokens"))
    composed = ops.compose(asked, phrases(spark, d), known(spark, d)).select("id", "result")
    return lines.select("file", "line_no", "id").join(parsed.unionByName(composed), "id").select("file", "line_no", "result")


def phrases(spark, d):
    n = text.normalise_english(F.col("p_name"))
    return b.table(spark, d, "part").select(n.alias("normal")).distinct().select("normal", F.concat(F.lit("!"), F.translate("normal", b.LATIN + " ", b.NATIVE)).alias("native"))


SPECIAL = [(["more", "and"], ["red", "small"], "special"), (["never"], [], "other")]


@query("compose", "WITH " + KNOWN + f""", ph AS (SELECT DISTINCT lower(p_name) AS normal FROM part), q AS (SELECT p_partkey AS id, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || lower(p_type) || ' and more' END AS normal FROM part),
w AS (SELECT id, unnest(string_split(normal, ' ')) AS token, unnest(range(len(string_split(normal, ' ')))) AS pos FROM q),
sp AS (SELECT id FROM w GROUP BY id HAVING count(*) FILTER (WHERE token = 'more') > 0 AND count(*) FILTER (WHERE token = 'and') > 0 AND count(*) FILTER (WHERE token IN ('red', 'small')) > 0),
j AS (SELECT id, string_agg(translate(known.token, '{b.LATIN}', '{b.NATIVE}'), '' ORDER BY pos) AS terms, string_agg(w.token, ' ' ORDER BY pos) FILTER (WHERE known.token IS NULL) AS missing FROM w LEFT JOIN known ON w.token = known.token GROUP BY id)
SELECT q.id, coalesce('!' || translate(ph.normal, '{b.LATIN} ', '{b.NATIVE}'), CASE WHEN sp.id IS NOT NULL THEN 'special' END, terms, 'unresolved') AS result, CASE WHEN ph.normal IS NULL AND sp.id IS NULL THEN coalesce(missing, '') ELSE '' END AS missing,
  CASE WHEN ph.normal IS NOT NULL THEN 'phrase' WHEN sp.id IS NOT NULL THEN 'special' WHEN terms IS NOT NULL THEN 'terms' ELSE 'none' END AS how FROM q LEFT JOIN ph USING (normal) LEFT JOIN j ON q.id = j.id LEFT JOIN sp ON q.id = sp.id""")
def compose(spark, d):
    p = b.table(spark, d, "part")
    asked = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" and more"))))
    q = p.select(F.col("p_partkey").alias("id"), text.normalise_english(asked).alias("normal"), text.split_tokens(asked).alias("tokens"))
    return ops.compose(q, phrases(spark, d), known(spark, d), SPECIAL)


TOKENS = f"""q AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS tokens, list_concat(list_concat(string_split(lower(p_type), ' '), CASE WHEN p_partkey % 4 = 0 THEN ['song', 'new'] ELSE [] END), list_transform(range(1, 13), lambda i: 'w' || CAST(i AS VARCHAR))) AS keywords FROM part),
m AS (SELECT id, tokens, list_slice(list_filter(list_transform(range(1, len(keywords) + 1), lambda i: CASE WHEN list_position(keywords, keywords[i]) = i AND NOT list_contains(tokens, keywords[i]) THEN keywords[i] END), lambda x: x IS NOT NULL), 1, 12) AS more FROM q),
t AS (SELECT id, unnest(list_concat(tokens, more)) AS token, unnest(range(len(tokens) + len(more))) AS place, len(tokens) AS n, array_to_string(tokens, ' ') AS goal FROM m)"""


def asked_tokens(spark, d):
    """Part names as queries, with types and more as keywords of their context."""
    p = b.table(spark, d, "part")
    more = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("song"), F.lit("new"))).otherwise(F.array().cast("array<string>"))
    keywords = F.concat(F.split(F.lower("p_type"), " "), more, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    return p.select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("tokens"), keywords.alias("keywords"))


@query("token_analysis", "WITH " + KNOWN + ", " + TOKENS + f""", j AS (SELECT t.*, known.token IS NOT NULL AS k FROM t LEFT JOIN known USING (token)), r AS (SELECT *, {ROLE_SQL} AS rs FROM j)
SELECT id, CAST(place AS INTEGER) AS place, token AS word, CASE WHEN place < n THEN 'input' ELSE 'context' END AS source, CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') WHEN token IN ({listed(text.STOPWORDS)}) THEN 'function-word' ELSE 'content-word' END AS roles,
  CASE {' '.join(f"WHEN token = '{k}' THEN '{v}'" for k, v in ops.CONNECTORS.items())} {' '.join(f"WHEN list_contains(rs, '{k}') THEN '{v}'" for k, v in ops.PARTICLE_OF_ROLE.items())} ELSE '' END AS particle, CASE WHEN k THEN translate(token, '{b.LATIN}', '{b.NATIVE}') ELSE '' END AS known, goal FROM r""")
def token_analysis(spark, d):
    rows = ops.token_analysis(asked_tokens(spark, d), known(spark, d))
    return rows.withColumn("roles", F.array_join("roles", ","))


@query("compose_from_tokens", "WITH " + KNOWN + ", " + TOKENS + f""", j AS (SELECT t.*, CASE WHEN known.token IS NOT NULL AND id % 3 = 0 THEN translate(t.token, '{b.LATIN}', '{b.NATIVE}') WHEN length(t.token) = 2 THEN translate(t.token, '{b.LATIN}', '{b.NATIVE}') END AS x FROM t LEFT JOIN known USING (token))
SELECT id, coalesce(string_agg(x, '' ORDER BY place) FILTER (WHERE regexp_matches(x, '[က-႟]')), 'generic') AS result, coalesce(string_agg(token, ' ' ORDER BY place) FILTER (WHERE regexp_matches(x, '[က-႟]')), '') AS used FROM j GROUP BY id""")
def compose_from_tokens(spark, d):
    """Tokens of which some are known, some found elsewhere and some found as something that isn't native."""
    rows = ops.token_analysis(asked_tokens(spark, d), known(spark, d))
    found = F.when(F.length("word") == 2, F.translate("word", b.LATIN, b.NATIVE)).when(F.length("word") == 3, F.col("word"))
    return ops.compose_from_tokens(rows.select("id", "place", "word", F.when(F.col("id") % 3 == 0, F.col("known")).otherwise("").alias("known"), found.alias("found")), "generic")


@query("token_lookup", "WITH " + b.WORDS + ", " + KNOWN + f""", f AS (SELECT doc_id, word, min(pos) AS pos FROM words WHERE length(word) >= 2 AND word NOT IN ({listed(text.STOPWORDS)}) GROUP BY doc_id, word),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS place FROM f)
SELECT doc_id AS id, word AS token, place, CASE WHEN token IS NOT NULL THEN 'known' WHEN length(word) > 12 THEN 'context only' ELSE 'look up' END AS decision FROM r LEFT JOIN known ON word = token WHERE place < 18""")
def token_lookup(spark, d):
    q = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("tokens"))
    return ops.token_lookup(q, known(spark, d))


KV = b.LINES + f""", kv AS (SELECT file, line_no, CASE line_no % 5 WHEN 0 THEN raw WHEN 1 THEN split_part(raw, ' ', 1) || ' =' WHEN 2 THEN split_part(raw, ' ', 1) || ' = ' || translate(lower(split_part(raw, ' ', 2)), '{b.LATIN}', '{b.NATIVE}')
  WHEN 3 THEN '# ' || raw ELSE translate(lower(raw), '{b.LATIN}', '{b.NATIVE}') END AS raw FROM lines),
side AS (SELECT *, trim(split_part(raw, '=', 1)) AS "left", CASE WHEN contains(raw, '=') THEN trim(substr(raw, instr(raw, '=') + 1)) ELSE '' END AS "right" FROM kv),
kind AS (SELECT *, CASE WHEN trim(raw) = '' OR trim(raw) LIKE '#%' THEN 'keep' WHEN contains(raw, '=') THEN CASE WHEN regexp_matches("left", '[A-Za-z]') AND "right" = '' THEN 'fill' WHEN regexp_matches("left", '[က-႟]') OR regexp_matches("right", '[က-႟]') THEN 'parse' ELSE 'keep' END
  WHEN regexp_matches(trim(raw), '[က-႟]') THEN 'parse' ELSE 'keep' END AS kind FROM side)"""


def kv_lines(spark, d):
    """Lines of documents as key/value lines of every kind."""
    k, raw = F.col("line_no") % 5, F.col("raw")
    first = F.split_part("raw", F.lit(" "), F.lit(1))
    native = lambda c: F.translate(F.lower(c), b.LATIN, b.NATIVE)
    new = F.when(k == 0, raw).when(k == 1, F.concat(first, F.lit(" ="))).when(k == 2, F.concat(first, F.lit(" = "), native(F.split_part("raw", F.lit(" "), F.lit(2))))).when(k == 3, F.concat(F.lit("# "), raw)).otherwise(native(raw))
    return b.lines(spark, d).withColumn("raw", new)


@query("kv_classify", "WITH " + KV + ' SELECT file, line_no, "left", "right", kind FROM kind')
def kv_classify(spark, d):
    return ops.kv_classify(kv_lines(spark, d)).select("file", "line_no", "left", "right", "kind")


@query("kv_scan", "WITH " + KV + """ SELECT file, line_no, "left" AS key, "right" AS value FROM kind WHERE contains(raw, '=') AND NOT ltrim(raw) LIKE '#%'""")
def kv_scan(spark, d):
    return files.read_key_values(kv_lines(spark, d))


@query("kv_batch_stats", "WITH " + KV + " SELECT file, count(*) AS total, count(*) FILTER (WHERE trim(raw) <> '') AS processed, count(*) FILTER (WHERE kind = 'fill') AS changed, count(*) FILTER (WHERE kind = 'parse') AS parsed FROM kind GROUP BY file")
def kv_batch_stats(spark, d):
    return ops.kv_batch_stats(ops.kv_classify(kv_lines(spark, d)))


def fills(spark, d):
    return b.vocabulary(spark, d).where("n >= 2").select(F.col("word").alias("query"), F.col("native").alias("result"))


@query("kv_translate")
def kv_translate(spark, d):
    return ops.kv_translate(kv_lines(spark, d), fills(spark, d), lexicon(spark, d))


@query("kv_output", "WITH " + KV + f""", {b.NATIVE_WORDS}, fills AS (SELECT word, min(native) AS result FROM native_words GROUP BY word HAVING count(*) >= 2),
o AS (SELECT file, line_no, kind, "left", CASE WHEN kind = 'fill' THEN "left" || ' = ' || coalesce(result, 'unresolved') ELSE raw END AS output, CASE WHEN kind = 'fill' THEN '# ' || "left" || ' -> ' || coalesce(result, 'unresolved') END AS analysis FROM kind LEFT JOIN fills ON lower("left") = word AND kind = 'fill')
SELECT file, 0 AS section, line_no, output AS text FROM o UNION ALL SELECT file, 1, line_no, analysis FROM o WHERE analysis IS NOT NULL""")
def kv_output(spark, d):
    """Output lines of fills, then their analysis lines."""
    rows = ops.kv_classify(kv_lines(spark, d))
    fill = F.when(F.col("kind") == "fill", F.lower("left"))
    joined = rows.withColumn("query", fill).join(fills(spark, d), "query", "left")
    got = F.coalesce("result", F.lit("unresolved"))
    done = joined.select("file", "line_no", F.when(F.col("kind") == "fill", F.concat("left", F.lit(" = "), got)).otherwise(F.col("raw")).alias("output"), F.when(F.col("kind") == "fill", F.concat(F.lit("# "), "left", F.lit(" -> "), got)).alias("analysis"))
    return ops.kv_output(done)


EVENTS = "ev AS (SELECT user_id AS line, event_id AS seq, CASE event_type WHEN 'view' THEN 'match' WHEN 'click' THEN 'fallback' WHEN 'error' THEN 'stuck' ELSE 'trying' END AS status, event_type AS source, ts FROM events)"


def line_events(spark, d):
    t = F.col("event_type")
    status = F.when(t == "view", "match").when(t == "click", "fallback").when(t == "error", "stuck").otherwise("trying")
    return b.table(spark, d, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("seq"), status.alias("status"), t.alias("source"), "ts")


@query("line_status", "WITH " + EVENTS + """, l AS (SELECT line, arg_max(status, seq) AS status FROM ev WHERE status IN ('match', 'fallback', 'stuck') GROUP BY line),
s AS (SELECT line, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) AS r FROM ev) WHERE r <= 80 GROUP BY line)
SELECT s.line, coalesce(l.status, 'pending') AS status, n, sources FROM s LEFT JOIN l USING (line)""")
def line_status(spark, d):
    return ops.line_status(line_events(spark, d))


@query("attempt_stats", "SELECT event_type AS stage, count(*) AS attempts, count(DISTINCT user_id) AS sources, max(ts) AS last_seen FROM events GROUP BY 1")
def attempt_stats(spark, d):
    return ops.attempt_stats(b.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("source"), "ts"))


@query("tail_attempts", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def tail_attempts(spark, d):
    return ops.tail_n(b.table(spark, d, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "ts")


@query("cache_latest", "SELECT event_type || '::' || CAST(user_id AS VARCHAR) AS cache_key, arg_max(event_id, ts) AS result, max(ts) AS updated_at FROM events GROUP BY 1")
def cache_latest(spark, d):
    e = b.table(spark, d, "events").select(F.concat_ws("::", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").alias("result"), F.col("ts").alias("updated_at"))
    return ops.cache_latest(e)


@query("attempts_append", "SELECT event_id AS id, event_type AS stage, CAST(trunc(value) AS INTEGER) AS elapsed_ms, len(json_keys(props)) AS n_metadata FROM events")
def attempts_append(spark, d):
    """Attempts added to a log in two goes, and the log read again."""
    path = files.scratch(spark, "attempts")
    e = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("value").cast("int").alias("elapsed_ms"), F.from_json("props", "map<string,string>").alias("metadata"))
    files.append_log(e.where("id % 2 = 0"), path)
    files.append_log(e.where("id % 2 = 1"), path)
    return spark.read.parquet(path).select("id", "stage", "elapsed_ms", F.size("metadata").cast("long").alias("n_metadata"))


@query("html_candidates")
def html_candidates(spark, d):
    return ops.html_candidates(b.table(spark, d, "pages")).select("page_id", F.array_join("candidates", "|").alias("candidates"))


@query("html_headings", "SELECT page_id, array_to_string(regexp_extract_all(html, '<h[1-3]>([^<]*)</h[1-3]>', 1), '|') AS headings FROM pages")
def html_headings(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("<h[1-3]>([^<]*)</h[1-3]>"), 1), "|").alias("headings"))
