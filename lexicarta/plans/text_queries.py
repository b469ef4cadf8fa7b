"""Queries of text functions, collation and runs."""

from pyspark.sql import functions as F

from lexicarta.functions import collation, legacy, text
from lexicarta.operators import series
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


NORM = "trim(regexp_replace(lower(regexp_replace(replace(translate(coalesce(text, ''), '_-', '  '), '&', ' and '), '[^A-Za-z0-9'' ]+', ' ', 'g')), ' +', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query("normalise_text", f"""
SELECT doc_id, {NORM} AS normal, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS visible FROM documents""")
def normalise_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.normalise_english(F.col("text")).alias("normal"), text.clean_visible_text(F.col("text")).alias("visible"))


@query("tokens", f"""
WITH t AS (SELECT doc_id, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS ts FROM documents)
SELECT doc_id, CAST(unnest(range(len(ts))) AS INTEGER) AS pos, unnest(ts) AS token FROM t""")
def tokens(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.posexplode(text.split_tokens(F.col("text"))).alias("pos", "token"))


@query("keyword_scores", f"""
WITH q AS (SELECT *, {NORM} AS normal FROM documents),
t AS (SELECT doc_id, n_chars, unnest(string_split(normal, ' ')) AS token,
        list_slice(list_filter(string_split(normal, ' '), lambda x: x <> ''), 1, 3) AS asked FROM q),
s AS (SELECT doc_id, token, sum(1 + CASE WHEN list_contains(asked, token) THEN 4 ELSE 0 END
        + CASE WHEN k.n_name IS NOT NULL THEN 6 ELSE 0 END) AS score
  FROM t LEFT JOIN (SELECT DISTINCT lower(p_name) AS n_name FROM (SELECT unnest(string_split(p_name, ' ')) AS p_name FROM part)) k ON t.token = k.n_name
  WHERE length(token) >= 3 AND token NOT IN ({STOP}) AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY doc_id, token),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS INTEGER) AS rank FROM s)
SELECT doc_id, token, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 14""")
def keyword_scores(spark, d):
    docs = b.documents(spark, d).select("doc_id", text.split_tokens(F.col("text")).alias("tokens"))
    known = b.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).select(F.lower("token").alias("token")).distinct()
    return series.keyword_scores(docs.withColumn("asked", F.slice("tokens", 1, 3)), known)


@query("detect_direction", """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '%s') ELSE text END AS t, doc_id %% 5 AS m FROM documents)
SELECT doc_id, CASE WHEN m = 1 THEN 'ksw-to-en' WHEN m = 2 THEN 'en-to-ksw' WHEN regexp_matches(t, '[က-႟]') THEN 'ksw-to-en' ELSE 'en-to-ksw' END AS direction FROM t""".replace("% 3", "%% 3") % b.NATIVE)
def detect_direction(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower("text"), b.LATIN, b.NATIVE)).otherwise(F.col("text")).alias("t"))
    mode = F.when(F.col("doc_id") % 5 == 1, "ksw-to-en").when(F.col("doc_id") % 5 == 2, "en-to-ksw")
    return t.select("doc_id", text.detect_direction(F.col("t"), mode).alias("direction"))


@query("script_flags", "WITH " + b.LINES + f""",
t AS (SELECT file, line_no, CASE WHEN line_no % 2 = 1 THEN translate(raw, '{b.LATIN}', '{b.NATIVE}') ELSE raw END AS t FROM lines)
SELECT file, line_no, regexp_matches(t, '[က-႟]') AS native, regexp_matches(t, '[A-Za-z]') AS latin, regexp_matches(t, '(?m)^\\s*[က-႟]') AS leads FROM t""")
def script_flags(spark, d):
    t = b.lines(spark, d).withColumn("t", F.when(F.col("line_no") % 2 == 1, F.translate("raw", b.LATIN, b.NATIVE)).otherwise(F.col("raw")))
    return t.select("file", "line_no", text.script_flags(F.col("t")).alias("f")).select("file", "line_no", "f.*")


@query("useful_results", "WITH " + b.LINES + """, t AS (SELECT file, line_no, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM lines)
SELECT file, line_no, t AS text FROM t WHERE t <> '' AND length(t) <= 180 AND lower(t) NOT IN (%s)
AND NOT regexp_matches(lower(t), '%s') AND regexp_matches(t, '[A-Za-z]')""" % (", ".join(f"'{x}'" for x in text.BAD_EXACT), "|".join(text.BAD_MARKERS)))
def useful_results(spark, d):
    rows = b.lines(spark, d).where(text.is_useful_result(F.col("raw"), F.lit("ksw-to-en")))
    return rows.select("file", "line_no", text.clean_visible_text(F.col("raw")).alias("text"))


@query("clean_text", "WITH " + b.VOCABULARY + """
SELECT word, w AS text FROM (SELECT word, CASE WHEN n % 2 = 0 THEN native ELSE word || '=' END AS w FROM vocabulary)
WHERE NOT regexp_matches(w, '[\\x00-\\x09\\x0b-\\x1f!-&(-+/-9<-\\x7f]')""")
def clean_text(spark, d):
    v = b.vocabulary(spark, d).select("word", F.when(F.col("n") % 2 == 0, F.col("native")).otherwise(F.concat("word", F.lit("="))).alias("text"))
    return v.where(text.is_clean(F.col("text")))


REPEAT = """CASE WHEN length(t) > 0 AND length(t) % 8 = 0 AND repeat(substr(t, 1, length(t) // 8), 8) = t THEN substr(t, 1, length(t) // 8)
  WHEN length(t) > 0 AND length(t) % 4 = 0 AND repeat(substr(t, 1, length(t) // 4), 4) = t THEN substr(t, 1, length(t) // 4)
  WHEN length(t) > 0 AND length(t) % 2 = 0 AND repeat(substr(t, 1, length(t) // 2), 2) = t THEN substr(t, 1, length(t) // 2) ELSE t END"""
REPEATED = ", r AS (SELECT word, repeat(native, CASE WHEN n % 4 = 0 THEN 4 WHEN n % 4 = 1 THEN 2 WHEN n % 4 = 2 THEN 8 ELSE 1 END) AS t FROM vocabulary)"


def repeated(spark, d):
    """Words as 1, 2, 4 or 8 copies."""
    times = F.when(F.col("n") % 4 == 0, 4).when(F.col("n") % 4 == 1, 2).when(F.col("n") % 4 == 2, 8).otherwise(1)
    return b.vocabulary(spark, d).select("word", F.repeat("native", times).alias("t"))


@query("dedupe_block", "WITH " + b.VOCABULARY + REPEATED + f" SELECT word, {REPEAT} AS once FROM r")
def dedupe_block(spark, d):
    return repeated(spark, d).select("word", text.dedupe_block(F.col("t")).alias("once"))


@query("dedupe_walk")
def dedupe_walk(spark, d):
    return repeated(spark, d).select("word", text.dedupe_walk(F.concat("t", F.lit("းးးး"))).alias("once"))


@query("convert_legacy", "WITH " + b.VOCABULARY + f""", r AS (SELECT word, repeat(word, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END) || CASE WHEN n % 3 = 0 THEN ' -' ELSE '' END AS t FROM vocabulary)
SELECT word, translate({REPEAT}, '{text.LEGACY_FROM.replace("'", "''")}' || ' ' || chr(9) || chr(10) || '-{{}}*', '{text.LEGACY_TO}') AS native FROM r""")
def convert_legacy(spark, d):
    v = b.vocabulary(spark, d)
    t = F.concat(F.repeat("word", F.when(F.col("n") % 2 == 0, 2).otherwise(1)), F.when(F.col("n") % 3 == 0, " -").otherwise(""))
    return v.select("word", text.convert_legacy(t).alias("native"))


@query("repair_stats", "WITH " + b.VOCABULARY + REPEATED + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {REPEAT} <> t) AS changed FROM r""")
def repair_stats(spark, d):
    t = repeated(spark, d)
    return t.agg(F.count(F.lit(1)).alias("total"), F.count_if(text.dedupe_block(F.col("t")) != F.col("t")).alias("changed"))


@query("unmapped_chars", """
SELECT DISTINCT c AS char FROM (SELECT unnest(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz ', '%s'), '')) AS c FROM documents)
WHERE c <> '' AND unicode(c) < 128 AND c NOT IN ('.', ',', chr(10))""" % b.NATIVE)
def unmapped_chars(spark, d):
    left = b.table(spark, d, "documents").select(F.translate("text", b.LATIN + " ", b.NATIVE).alias("t"))
    return series.unmapped_chars(left, "t", [".", ",", "\n"])


CONS = text.CONSONANTS
OTHER = "[က-႟]"


@query("split_syllables", "WITH " + b.VOCABULARY + f"""
SELECT word, array_to_string(list_filter(string_split(trim(regexp_replace(native, '([{CONS}])', ' \\1', 'g')), ' '), lambda x: x <> ''), '|') AS syllables FROM vocabulary""")
def split_syllables(spark, d):
    return b.vocabulary(spark, d).select("word", F.array_join(text.split_syllables(F.col("native")), "|").alias("syllables"))


def sql_last(chars, of="bare"):
    return f"coalesce(regexp_extract({of}, '(?s).*([{chars}])', 1), '')"


BARE = ", v AS (SELECT *, regexp_replace(native, 'မ်|ဒ်', '', 'g') AS bare FROM (SELECT word, n, native || CASE WHEN n % 5 = 0 THEN 'မ်' ELSE '' END AS native FROM vocabulary))"


def marked(spark, d):
    """Words, each fifth with a contraction at its end."""
    return b.vocabulary(spark, d).select("word", "n", F.concat("native", F.when(F.col("n") % 5 == 0, "မ်").otherwise("")).alias("native"))


PARTS = f""", p AS (SELECT word, n, native, {sql_last(collation.CONSONANT)} AS consonant, array_to_string(regexp_extract_all(bare, '[{collation.MEDIAL}]'), '') AS medials,
  {sql_last(collation.VOWEL)} AS vowel, coalesce(regexp_extract(native, '(?s).*(မ်|ဒ်|[{collation.TONE}])', 1), '') AS tone FROM v)"""


@query("decompose", "WITH " + b.VOCABULARY + BARE + PARTS + " SELECT word, consonant, medials, vowel, tone FROM p")
def decompose(spark, d):
    parts = marked(spark, d).select("word", collation.decompose(F.col("native")).alias("p"))
    return parts.select("word", "p.consonant", F.array_join("p.medials", "").alias("medials"), "p.vowel", "p.tone")


def sql_rank(col, chars, first=0):
    return f"CASE WHEN length({col}) = 1 AND instr('{chars}', {col}) > 0 THEN instr('{chars}', {col}) - 1 + {first} ELSE 99 END"


@query("collation_sort", "WITH " + b.VOCABULARY + BARE + PARTS + f""", k AS (SELECT word, {sql_rank('consonant', collation.CONSONANT)} AS c,
  CASE WHEN tone = '' THEN 0 ELSE {sql_rank('tone', collation.TONE, 1)} END AS t, {sql_rank('vowel', collation.VOWEL)} AS v,
  coalesce(list_min(list_transform(string_split(medials, ''), lambda m: CASE WHEN m = '' THEN 99 ELSE instr('{collation.MEDIAL}', m) - 1 END)), 99) AS m FROM p)
SELECT word, CAST(c AS INTEGER) AS consonant, CAST(t AS INTEGER) AS tone, CAST(v AS INTEGER) AS vowel, CAST(m AS INTEGER) AS medial, row_number() OVER (ORDER BY c, t, v, m, word) - 1 AS place FROM k""")
def collation_sort(spark, d):
    return series.collation_sort(marked(spark, d), "native", "word").select("word", "consonant", "tone", "vowel", "medial", "place")


LEVELS = {"consonant": ("ကခဂဃငစဆၡညတထဒနပဖဘမယရလဝသဟအဧ", 0), "tone": ("ါၒၓးၔၕ", 1), "vowel": ("ံၢုူ့ဲိီ", 0)}


@query("collation_levels", "WITH " + b.VOCABULARY + BARE + PARTS + " " + " UNION ALL ".join(f"""SELECT word, '{k}' AS level, {k} AS symbol, CAST(CASE WHEN {k} = '' THEN {0 if k == 'tone' else 'NULL'} WHEN length({k}) > 1 THEN NULL ELSE instr('{cs}', {k}) - 1 + {first} END AS INTEGER) AS rank FROM p""" for k, (cs, first) in LEVELS.items()))
def collation_levels(spark, d):
    """Each word's symbols with their places in the alphabet's table."""
    return series.collation_levels(marked(spark, d), "native").where("level <> 'medial'").select("word", "level", "symbol", "rank")


@query("part_of_speech", "WITH " + b.LINES + """
SELECT file, line_no, regexp_extract(t, '\\b(v\\.i\\.|v\\.t\\.|v\\.|n\\.|adj\\.|adv\\.|prep\\.|conj\\.|pron\\.|interj\\.|part\\.)\\b', 1) AS pos
FROM (SELECT file, line_no, CASE line_no % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'v.t.' WHEN 2 THEN 'adj. ' ELSE '' END || regexp_replace(raw, '[^\\x00-\\x7f]', '', 'g') AS t FROM lines)
WHERE regexp_matches(t, '\\b(v\\.i\\.|v\\.t\\.|v\\.|n\\.|adj\\.|adv\\.|prep\\.|conj\\.|pron\\.|interj\\.|part\\.)\\b')""")
def part_of_speech(spark, d):
    tag = F.when(F.col("line_no") % 4 == 0, "n.").when(F.col("line_no") % 4 == 1, "v.t.").when(F.col("line_no") % 4 == 2, "adj. ").otherwise("")
    t = b.lines(spark, d).select("file", "line_no", text.part_of_speech(F.concat(tag, F.regexp_replace("raw", r"[^\x00-\x7f]", ""))).alias("pos"))
    return t.where("pos is not null")


@query("split_columns", "WITH " + b.LINES + """, t AS (SELECT file, line_no, regexp_extract(raw2, '^(.*?)\\s{2,}((?s:.*))$', ['a', 'b']) AS p, regexp_matches(raw2, '\\s{2,}') AS two
  FROM (SELECT *, regexp_replace(raw, ' ([^ ]+)$', '   \\1') AS raw2 FROM lines))
SELECT file, line_no, p.a AS "left", p.b AS "right" FROM t WHERE two AND p.a <> '' AND p.b <> ''""")
def split_columns(spark, d):
    raw = F.regexp_replace("raw", " ([^ ]+)$", "   $1")
    return b.lines(spark, d).select("file", "line_no", text.split_columns(raw).alias("p")).where("p is not null").select("file", "line_no", "p.left", "p.right")


@query("parse_stats", "WITH " + b.LINES + """, t AS (SELECT regexp_extract(raw2, '^(.*?)\\s{2,}((?s:.*))$', ['a', 'b']) AS p, regexp_matches(raw2, '\\s{2,}') AS two FROM (SELECT *, regexp_replace(raw, ' ([^ ]+)$', '   \\1') AS raw2 FROM lines))
SELECT count(*) AS lines, count(*) FILTER (WHERE two AND p.a <> '' AND p.b <> '') AS parsed, count(*) FILTER (WHERE NOT (two AND p.a <> '' AND p.b <> '')) AS skipped FROM t""")
def parse_stats(spark, d):
    return series.parse_stats(b.lines(spark, d).select(text.split_columns(F.regexp_replace("raw", " ([^ ]+)$", "   $1")).alias("parsed")), "parsed")


@query("page_lines", "WITH " + b.LINES + """
SELECT file, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM lines WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> ''""")
def page_lines(spark, d):
    return b.lines(spark, d).select("file", "line_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where("line <> ''")


INDEX = b.LINES + """, w AS (
  SELECT file, line_no, unnest(list_slice(list_filter(string_split(regexp_replace(raw, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x <> ''), 1, 3)) AS word FROM lines)"""


def indexed(spark, d):
    """(word, file, line_no) of the lines' first words."""
    keyed = b.lines(spark, d).select(F.struct("file", "line_no").alias("key"), "raw")
    return series.inverted_index(keyed, "key", "raw").select("word", "key.*")


@query("inverted_index", "WITH " + INDEX + """
SELECT lower(word) AS word, count(*) AS n, arg_min(file || ':' || line_no, [file, line_no]) AS first_key, arg_max(file || ':' || line_no, [file, line_no]) AS last_key FROM w WHERE length(word) > 2 GROUP BY lower(word)""")
def inverted_index(spark, d):
    key = F.struct("file", "line_no")
    shown = lambda k: F.concat_ws(":", k["file"].cast("string"), k["line_no"].cast("string"))
    return indexed(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"), shown(F.min(key)).alias("first_key"), shown(F.max(key)).alias("last_key"))


@query("posting_lists", "WITH " + INDEX + """, r AS (SELECT lower(word) AS word, file, line_no, row_number() OVER (PARTITION BY lower(word) ORDER BY file, line_no) - 1 AS place FROM w WHERE length(word) > 2)
SELECT word, place // 256 AS chunk, count(*) AS n, string_agg(file || ':' || line_no, ' ' ORDER BY file, line_no) AS keys FROM r GROUP BY word, place // 256""")
def posting_lists(spark, d):
    """The index as delta-coded lists of 256 keys a chunk, decoded again."""
    lists = series.posting_keys(series.posting_lists(indexed(spark, d), 256))
    shown = F.transform("keys", lambda k: F.concat_ws(":", k["file"].cast("string"), k["line_no"].cast("string")))
    return lists.select("word", "chunk", F.size("keys").cast("long").alias("n"), F.array_join(shown, " ").alias("keys"))


@query("font_runs", "WITH " + b.NATIVE_WORDS + """, g AS (SELECT doc_id, pos, word, length(word) % 2 = 0 AS own FROM words),
f AS (SELECT *, own AND NOT coalesce(lag(own) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM g),
r AS (SELECT *, greatest(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS run FROM f)
SELECT doc_id AS page, CAST(run AS BIGINT) AS run, string_agg(word, '' ORDER BY pos) FILTER (WHERE own) AS own_text,
  coalesce(string_agg(word, '' ORDER BY pos) FILTER (WHERE NOT own), '') AS other_text FROM r GROUP BY doc_id, run HAVING count(*) FILTER (WHERE own) > 0""")
def font_runs(spark, d):
    chars = b.words(spark, d).select(F.col("doc_id").alias("page"), "pos", (F.length("word") % 2 == 0).alias("own"), F.col("word").alias("text"))
    return series.font_runs(chars)


@query("paragraphs")
def paragraphs(spark, d):
    return series.paragraphs(b.native_words(spark, d).select("doc_id", "pos", F.col("native").alias("text")), 300, 50)


@query("activity_islands", """
WITH h AS (SELECT user_id AS key, epoch(date_trunc('day', ts)) // 86400 AS pos, sum(value) AS v FROM events GROUP BY 1, 2),
a AS (SELECT key, pos FROM (SELECT *, max(v) OVER (PARTITION BY key) AS top FROM h) WHERE v >= 0.3 * top),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS g FROM a),
s AS (SELECT key, min(pos) AS a, max(pos) AS b FROM i GROUP BY key, g HAVING max(pos) - min(pos) + 1 >= 2),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY key ORDER BY a) - 1 < 3 THEN 0 ELSE 1 END AS cut FROM s),
r AS (SELECT *, sum(cut) OVER (PARTITION BY key ORDER BY a) AS run FROM m)
SELECT key, CAST(min(a) AS BIGINT) AS first_pos, CAST(max(b) AS BIGINT) AS last_pos FROM r GROUP BY key, run""")
def activity_islands(spark, d):
    return series.islands(daily(spark, d), frac=0.3, min_len=2, merge_gap=3)


def daily(spark, d):
    """Value of events of each user and day."""
    e = b.table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("key"), F.floor(F.unix_timestamp(F.date_trunc("day", "ts")) / 86400).cast("long").alias("pos")).agg(F.sum("value").alias("value"))


@query("content_bounds", """
WITH h AS (SELECT user_id AS key, epoch(date_trunc('day', ts)) // 86400 AS pos, sum(value) AS v FROM events GROUP BY 1, 2),
a AS (SELECT *, max(v) OVER (PARTITION BY key) AS top FROM h)
SELECT key, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM a WHERE v > 0.1 * top GROUP BY key""")
def content_bounds(spark, d):
    return series.content_bounds(daily(spark, d), 0.1)


SHORT = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query("short_gloss", "WITH " + b.WORDS + """, m AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '??' WHEN 1 THEN word || '/alt' WHEN 2 THEN word || ', more' ELSE word END AS m FROM words)
SELECT doc_id, coalesce(string_agg(trim(split_part(split_part(m, '/', 1), ',', 1)), ' ' ORDER BY pos) FILTER (WHERE m <> '??'), 'unresolved') AS gloss FROM m GROUP BY doc_id""")
def short_gloss(spark, d):
    """A document's words stay in its row; only rows that share an id are brought together."""
    meaning = lambda w, pos: F.when(pos % 4 == 0, "??").when(pos % 4 == 1, F.concat(w, F.lit("/alt"))).when(pos % 4 == 2, F.concat(w, F.lit(", more"))).otherwise(w)
    docs = b.documents(spark, d).select("doc_id", "text")
    shared = files.written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("shared")), "shared-ids")
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    words = docs.join(shared, same, "left_anti").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words")).where(F.size("words") > 0)
    out = words.select("doc_id", text.short_gloss(F.transform("words", meaning)).alias("gloss"))
    if shared.isEmpty():
        return out
    several = b.words(spark, d).join(shared, same, "left_semi")
    rows = several.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", meaning(F.col("word"), F.col("pos")).alias("m")))).alias("ms"))
    return out.unionByName(rows.select("doc_id", text.short_gloss(F.col("ms.m")).alias("gloss")))


ALL2 = legacy.CONSONANTS + legacy.VOWELS + legacy.TONES + legacy.MEDIALS + legacy.PAIRS
CASES = " ".join(f"WHEN '{t.replace(chr(39), chr(39) * 2)}' THEN '{r}'" for t, _, r in ALL2)


@query("romanise", "WITH " + b.VOCABULARY + f""", r AS (SELECT word, array_to_string(list_transform(regexp_extract_all(word || CASE WHEN n % 2 = 0 THEN 'r~%SFg' ELSE '' END, '%S|r~|''~|.'), lambda t: CASE t {CASES} ELSE '' END), '') AS r FROM vocabulary)
SELECT word, CASE WHEN r = '' THEN word ELSE r END AS roman FROM r""")
def romanise(spark, d):
    v = b.vocabulary(spark, d).select("word", F.concat("word", F.when(F.col("n") % 2 == 0, "r~%SFg").otherwise("")).alias("t"))
    return v.select("word", legacy.romanise(F.col("t")).alias("roman"))


#: Golden values, written out: a letter of the second legacy encoding and its native character.
GOLDEN2 = dict(zip("ucCipqnwxeyzbrv&otgRXmLHJlk", "ကခဂငစဆညတထနပဖဘမလရသအါံၢ့ီိဲူု", strict=True))


@query("decode_legacy2", "WITH " + b.VOCABULARY + f""", t AS (SELECT word, translate(word, '{''.join(GOLDEN2)}', '{''.join(GOLDEN2.values())}') AS t, n % 2 = 0 AS even FROM vocabulary)
SELECT word, t || 'အFမ်ၡျါ' AS native FROM t WHERE even AND NOT contains(word, 's')""")
def decode_legacy2(spark, d):
    """Words without an s, which stands for a medial, each with marks behind it."""
    v = b.vocabulary(spark, d).where("n % 2 = 0 and not contains(word, 's')")
    return v.select("word", legacy.decode_legacy2(F.concat("word", F.lit("tFr~%SFg"))).alias("native"))
