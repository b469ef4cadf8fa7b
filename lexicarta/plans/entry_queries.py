"""Queries of dictionary entries."""

from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.operators import entries as ops
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


WITH = "WITH " + b.ENTRIES + " "
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("normalise_entries", WITH + f"""
SELECT pos, {STRIP.format('karen')} AS karen, array_to_string(list_transform(list_filter(definitions, lambda x: regexp_replace(x, '\\s', '', 'g') <> ''), lambda x: {STRIP.format('x')}), '|') AS definitions,
  page, flag, source, CASE WHEN pos % 5 = 0 THEN 'headword' WHEN pos % 5 = 1 THEN 'compound' ELSE 'headword' END AS entry_type FROM entries""")
def normalise_entries(spark, d):
    e = b.entries(spark, d).withColumn("entry_type", F.when(F.col("pos") % 5 == 0, "odd").when(F.col("pos") % 5 == 1, "compound").otherwise("headword"))
    out = ops.normalise_entries(e, now="2024-01-01 00:00:00")
    return out.select("pos", "karen", F.array_join("definitions", "|").alias("definitions"), "page", "flag", "source", "entry_type")


ANALYSED = WITH + """, an AS (SELECT *, list_transform(definitions, lambda x: regexp_extract(x, '[A-Za-z]+', 0)) AS ws FROM entries),
items AS (SELECT *, list_transform(ws, lambda x: '{"text":"' || x || '"}') AS terms, list_transform(ws, lambda x: '{"text":"' || x || '","kind":"xref"}') AS segs, ['{"number":"1","label":"noun"}'] AS labels FROM an)"""


def analysed(spark, d):
    """Entries with their analysis as JSON text: the first word of each definition as example, term, segment; related items that are no list."""
    ws = F.transform("definitions", lambda x: F.regexp_extract(x, "[A-Za-z]+", 0))
    text, kind = (lambda x: x.alias("text")), F.lit("xref").alias("kind")
    analysis = F.to_json(
        F.struct(
            F.col("ws").alias("examples"),
            F.transform("ws", lambda x: F.struct(text(x))).alias("headword_terms"),
            F.lit("none").alias("related_items"),
            F.transform("ws", lambda x: F.struct(text(x), kind)).alias("segments"),
            F.array(F.struct(F.lit("1").alias("number"), F.lit("noun").alias("label"))).alias("sense_labels"),
        )
    )
    return b.entries(spark, d).withColumn("ws", ws).withColumn("analysis", F.when(F.col("pos") % 10 == 9, "[]").otherwise(analysis))


@query("normalise_analysis", ANALYSED + """
SELECT pos, CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(ws, '|') END AS examples, CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(terms, '|') END AS headword_terms,
  CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(segs, '|') END AS segments, CASE WHEN pos % 10 = 9 THEN '' ELSE labels[1] END AS sense_labels, 0 AS n_related FROM items""")
def normalise_analysis(spark, d):
    a = analysed(spark, d).select("pos", ops.normalise_analysis(F.col("analysis")).alias("a"))
    lists = (F.array_join(f"a.{k}", "|").alias(k) for k in ("examples", "headword_terms", "segments", "sense_labels"))
    return a.select("pos", *lists, F.size("a.related_items").alias("n_related"))


@query("merge_analysis", ANALYSED + """, t AS (SELECT pos, list_concat(list_reverse(ws), ws) AS x, terms FROM items WHERE pos % 10 <> 9),
u AS (SELECT pos, unnest(x) AS v, unnest(range(len(x))) AS i FROM t), f AS (SELECT pos, v, min(i) AS i FROM u GROUP BY pos, v), e AS (SELECT pos, string_agg(v, '|' ORDER BY i) AS examples FROM f GROUP BY pos),
u2 AS (SELECT pos, unnest(terms) AS v, unnest(range(len(terms))) AS i FROM t), f2 AS (SELECT pos, v, min(i) AS i FROM u2 GROUP BY pos, v), e2 AS (SELECT pos, string_agg(v, '|' ORDER BY i) AS headword_terms FROM f2 GROUP BY pos)
SELECT e.pos, examples, headword_terms, 0 AS n_related, 1 AS n_labels FROM e JOIN e2 USING (pos)""")
def merge_analysis(spark, d):
    a = analysed(spark, d).where("pos % 10 <> 9").select("pos", "ws", ops.normalise_analysis(F.col("analysis")).alias("a"))
    first = a.select("pos", "a", ops.normalise_analysis(F.to_json(F.struct(F.reverse("ws").alias("examples")))).alias("b"))
    m = first.select("pos", ops.merge_analysis(F.col("b"), F.col("a")).alias("m"))
    return m.select("pos", F.array_join("m.examples", "|").alias("examples"), F.array_join("m.headword_terms", "|").alias("headword_terms"), F.size("m.related_items").alias("n_related"), F.size("m.sense_labels").alias("n_labels"))


@query("dedupe_items", ANALYSED + """, u AS (SELECT pos, unnest(ws) AS v, unnest(range(len(ws))) AS i FROM items), f AS (SELECT pos, v, min(i) AS i FROM u GROUP BY pos, v)
SELECT pos, string_agg('{"text":"' || v || '"}', '|' ORDER BY i) AS items FROM f GROUP BY pos""")
def dedupe_items(spark, d):
    return analysed(spark, d).select("pos", F.array_join(ops.dedupe_items(F.col("ws")), "|").alias("items"))


@query("search_blob", ANALYSED + """
SELECT pos, md5(lower(concat_ws(' ', karen, array_to_string(definitions, ' '), source, '{"examples": [' || CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(list_transform(ws, lambda x: '"' || x || '"'), ', ') END
  || '], "headword_terms": [' || CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(terms, ', ') END || '], "related_items": [], "segments": [' || CASE WHEN pos % 10 = 9 THEN '' ELSE array_to_string(segs, ', ') END
  || '], "sense_labels": [' || CASE WHEN pos % 10 = 9 THEN '' ELSE labels[1] END || ']}'))) AS blob FROM items""")
def search_blob(spark, d):
    e = analysed(spark, d).withColumn("analysis", ops.normalise_analysis(F.col("analysis")))
    return e.select("pos", F.md5(ops.search_blob(F.col("analysis"))).alias("blob"))


@query("segment_kind", """
SELECT event_id, CASE k WHEN 'xref' THEN 'cross_reference' WHEN 'cf' THEN 'cross_reference' WHEN 'examples' THEN 'example' WHEN '' THEN 'other' ELSE k END AS kind FROM (
  SELECT event_id, trim(lower(CASE event_type WHEN 'view' THEN ' XREF ' WHEN 'click' THEN 'cf' WHEN 'error' THEN '  ' WHEN 'signup' THEN 'Examples' ELSE event_type END)) AS k FROM events)""")
def segment_kind(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "view", " XREF ").when(t == "click", "cf").when(t == "error", "  ").when(t == "signup", "Examples").otherwise(t)
    return b.table(spark, d, "events").select("event_id", ops.segment_kind(kind).alias("kind"))


@query("inject_labels", WITH + """
SELECT pos, regexp_replace(regexp_replace(t, '(^|[\\s(;])1\\.(\\s*)', '\\11. (noun)\\2', 'g'), '(^|[\\s(;])2\\.(\\s*)', '\\12. (verb)\\2', 'g') AS labelled
FROM (SELECT pos, '1. ' || karen || '; 2. ' || source || ' 3. rest (1.x) 2.' AS t FROM entries)""")
def inject_labels(spark, d):
    labels = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(x).alias("label")) for n, x in (("1", "noun"), ("2", "verb"), ("3", ""))])
    t = F.concat(F.lit("1. "), "karen", F.lit("; 2. "), "source", F.lit(" 3. rest (1.x) 2."))
    return b.entries(spark, d).select("pos", ops.inject_labels(t, labels).alias("labelled"))


def terms_of(e):
    """(pos, term): the words of all definitions, each once an entry."""
    return e.select("pos", F.explode(F.array_distinct(F.split(F.array_join("definitions", " "), " "))).alias("term"))


def segments(definition):
    """The first words of a definition as its segments, of one kind and another."""
    ws = F.slice(F.array_distinct(F.split(definition, " ")), 1, 3)
    return F.transform(ws, lambda w, i: F.struct(w.alias("text"), F.when(i % 2 == 0, "xref").otherwise("example").alias("kind")))


def sql_escape(t):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        t = f"replace({t}, '{char}', '{name}')"
    return t


def sql_first(t, word, new):
    return f"CASE WHEN {word} <> '' AND instr({t}, {word}) > 0 THEN substr({t}, 1, instr({t}, {word}) - 1) || {new} || substr({t}, instr({t}, {word}) + length({word})) ELSE {t} END"


SPAN = """'<span class="seg seg-' || k || '">' || w || '</span>'"""
LINKS = """'<a href="#entry-' || g || '" class="hw-link karen" data-idx="' || g || '">' || w || '</a>'"""


@query("highlight_segments", WITH + f""", l AS (SELECT pos, CAST(unnest(range(len(definitions))) AS INTEGER) AS line, unnest(definitions) AS t FROM entries),
p AS (SELECT pos, line, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS i FROM l), f AS (SELECT pos, line, w, min(i) AS i FROM p GROUP BY pos, line, w),
r AS (SELECT *, row_number() OVER (PARTITION BY pos, line ORDER BY i) AS n FROM f), k AS (SELECT pos, line, {sql_escape('w')} AS w, length(w) AS size, n, CASE WHEN n % 2 = 1 THEN 'cross_reference' ELSE 'example' END AS k FROM r WHERE n <= 3 AND w <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY pos, line ORDER BY size DESC, n) AS place FROM k),
j AS (SELECT l.pos, l.line, {sql_escape('t')} AS t, a.w AS w1, a.k AS k1, b.w AS w2, b.k AS k2, c.w AS w3, c.k AS k3 FROM l LEFT JOIN o a ON a.pos = l.pos AND a.line = l.line AND a.place = 1
  LEFT JOIN o b ON b.pos = l.pos AND b.line = l.line AND b.place = 2 LEFT JOIN o c ON c.pos = l.pos AND c.line = l.line AND c.place = 3),
s1 AS (SELECT *, {sql_first('t', 'w1', SPAN.replace(' k ', ' k1 ').replace(' w ', ' w1 '))} AS t1 FROM j), s2 AS (SELECT *, {sql_first('t1', 'w2', SPAN.replace(' k ', ' k2 ').replace(' w ', ' w2 '))} AS t2 FROM s1)
SELECT pos, line, {sql_first('t2', 'w3', SPAN.replace(' k ', ' k3 ').replace(' w ', ' w3 '))} AS html FROM s2""")
def highlight_segments(spark, d):
    rows = b.entries(spark, d).select("pos", F.posexplode("definitions").alias("line", "t"))
    return rows.select("pos", "line", ops.highlight_segments(F.col("t"), segments(F.col("t"))).alias("html"))


@query("view_entries", WITH + f""", best AS (SELECT karen, min(pos) AS target FROM entries GROUP BY karen), e AS (SELECT pos, karen, regexp_extract(karen, '[a-z]+', 0) AS w, regexp_extract(coalesce(source, ''), '[a-z]+', 0) AS w2, definitions FROM entries),
j AS (SELECT e.*, CAST(best.target AS VARCHAR) AS g FROM e LEFT JOIN best ON best.karen = e.w AND e.w <> ''), l AS (SELECT pos, karen, w, w2, g, unnest(range(len(definitions))) AS line, '1. ' || unnest(definitions) AS t0 FROM j),
lb AS (SELECT *, regexp_replace(t0, '(^|[\\s(;])1\\.(\\s*)', '\\11. (noun)\\2', 'g') AS t FROM l), m AS (SELECT *, {sql_first(sql_escape('t'), 'w', SPAN.replace("' || k || '", 'cross_reference'))} AS m FROM lb),
k AS (SELECT *, CASE WHEN g IS NULL THEN m ELSE {sql_first('m', 'w', LINKS)} END AS h FROM m)
SELECT pos, karen, string_agg(t, '|' ORDER BY line) AS shown, string_agg(h, '|' ORDER BY line) AS html, '{{"text":"' || w || '"}}' || CASE WHEN w2 <> w THEN '|{{"text":"' || w2 || '"}}' ELSE '' END AS tab_examples, 1 AS n_headwords, 0 AS n_related FROM k GROUP BY pos, karen, w, w2""")
def view_entries(spark, d):
    """Entries with an analysis of their key: the label of a sense, one segment, one term that may link, examples that repeat."""
    w, w2 = F.regexp_extract("karen", "[a-z]+", 0), F.regexp_extract(F.coalesce("source", F.lit("")), "[a-z]+", 0)
    item = F.struct(w.alias("text"), F.lit("xref").alias("kind"))
    analysis = F.to_json(F.struct(F.array(w, w2, w).alias("examples"), F.array(F.struct(w.alias("text"))).alias("headword_terms"), F.array(item).alias("segments"), F.array(F.struct(F.lit("1").alias("number"), F.lit("noun").alias("label"))).alias("sense_labels")))
    e = b.entries(spark, d).withColumn("definitions", F.transform("definitions", lambda t: F.concat(F.lit("1. "), t))).withColumn("analysis", ops.normalise_analysis(analysis))
    v = ops.view_entries(e)
    return v.select("pos", "karen", F.array_join("display_definitions", "|").alias("shown"), F.array_join("linked_definitions", "|").alias("html"), F.array_join("tab_examples", "|").alias("tab_examples"), F.size("tab_headwords").alias("n_headwords"), F.size("tab_related").alias("n_related"))


@query("page_from_file", """
SELECT page_id, CASE WHEN m = '' THEN NULL ELSE TRY_CAST(m AS INTEGER) + 2 END AS page FROM (SELECT page_id, coalesce(regexp_extract(url, '[0-9]+', 0), '') AS m FROM pages)""")
def page_from_file(spark, d):
    return b.table(spark, d, "pages").select("page_id", ops.page_from_file(F.col("url"), 2).alias("page"))


@query("safe_name", """
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name, CASE lower(regexp_extract(url, '\\.([a-z]+)/', 1)) WHEN 'com' THEN 'image/jpeg' WHEN 'net' THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM pages""")
def safe_name(spark, d):
    mime = ops.mime_type(F.regexp_extract("url", r"\.([a-z]+)/", 1), {"com": "image/jpeg", "net": "image/png"})
    return b.table(spark, d, "pages").select("page_id", ops.safe_name(F.col("url")).alias("name"), mime.alias("mime"))


@query("parse_model_output", WITH + """
SELECT pos AS request_id, CASE WHEN pos % 5 < 4 THEN 0 END AS item, CASE WHEN pos % 5 < 4 THEN karen END AS karen, CASE WHEN pos % 5 < 4 THEN array_to_string(definitions, chr(10)) END AS definitions,
  CASE WHEN pos % 5 = 4 THEN 'no entries in the reply' END AS error FROM entries""")
def parse_model_output(spark, d):
    e = b.entries(spark, d)
    item = F.to_json(F.array(F.struct("karen", "definitions")))
    k = F.col("pos") % 5
    raw = F.when(k == 0, item).when(k == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"entries": '), item, F.lit("}"))).when(k == 3, F.concat(F.lit("Here they are: "), item, F.lit(" as asked"))).otherwise("nothing found")
    return ops.parse_model_output(e.select(F.col("pos").alias("request_id"), raw.alias("raw"))).withColumn("definitions", F.array_join("definitions", "\n"))


@query("edit_entries", WITH + """
SELECT pos, CASE WHEN pos % 10 = 3 THEN upper(karen) ELSE karen END AS karen, len(CASE WHEN pos % 10 = 3 THEN list_filter(definitions, lambda x: regexp_replace(x, '\\s', '', 'g') <> '') ELSE definitions END) AS n_definitions, flag OR pos % 10 = 3 AS flag,
  entry_type, pos % 20 = 13 AS promoted, CASE WHEN pos % 10 = 3 THEN '2024-01-01' END AS updated_at FROM entries WHERE pos % 10 <> 9""")
def edit_entries(spark, d):
    e = b.entries(spark, d)
    edits = e.where("pos % 10 = 3").select("pos", text.simple_upper(F.col("karen")).alias("karen"), F.lit(None).cast("array<string>").alias("definitions"), F.lit(True).alias("flag"), (F.col("pos") % 20 == 13).alias("promote"))
    out = ops.edit_entries(e, edits, e.where("pos % 10 = 9"), "2024-01-01")
    return out.select("pos", "karen", F.size("definitions").cast("long").alias("n_definitions"), "flag", "entry_type", "promoted", "updated_at")


@query("reanalyse_entries", WITH + """
SELECT pos, CASE WHEN pos % 6 = 0 THEN 'example' ELSE entry_type END AS entry_type, CASE WHEN pos % 3 = 0 THEN karen ELSE 'old' END AS examples, len(definitions) AS n_definitions, CASE WHEN pos % 3 = 0 THEN '2024-01-02' END AS updated_at FROM entries""")
def reanalyse_entries(spark, d):
    e = b.entries(spark, d).withColumn("analysis", ops.normalise_analysis(F.lit('{"examples": ["old"]}')))
    results = e.where("pos % 3 = 0").select("pos", F.when(F.col("pos") % 6 == 0, "example").otherwise("odd").alias("entry_type"), F.to_json(F.struct(F.array("karen").alias("examples"))).alias("analysis"))
    out = ops.reanalyse_entries(e, results, "2024-01-02")
    return out.select("pos", "entry_type", F.array_join("analysis.examples", "|").alias("examples"), F.size("definitions").cast("long").alias("n_definitions"), "updated_at")


@query("ledger_quality", "SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 4 <> 1) AS wrong_type FROM pages")
def ledger_quality(spark, d):
    p = b.table(spark, d, "pages")
    k = F.col("page_id") % 4
    value = F.when(k == 0, "[1]").when(k == 1, F.to_json(F.struct("url"))).when(k == 2, '"text"')
    return ops.ledger_quality(p.select(F.col("url").alias("file"), value.alias("value")))


@query("append_entries", WITH + "SELECT karen, count(*) + count(*) FILTER (WHERE pos % 3 = 0) AS n, count(*) FILTER (WHERE pos % 3 = 0) AS without_page FROM entries WHERE page IS NOT NULL GROUP BY karen")
def append_entries(spark, d):
    e = b.entries(spark, d)
    both = ops.append_entries(e, e.where("pos % 3 = 0").drop("page"))
    return both.groupBy("karen").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page").isNull()).alias("without_page"))


@query("classify_error", WITH + """
SELECT pos, CASE WHEN pos % 3 = 0 THEN 'wrong_headword' WHEN pos % 3 = 1 THEN 'wrong_definition' ELSE 'formatting_error' END AS kind FROM entries""")
def classify_error(spark, d):
    key = F.when(F.col("pos") % 3 == 0, F.concat("karen", F.lit("x"))).otherwise(F.col("karen"))
    defs = F.when(F.col("pos") % 3 == 1, F.concat("definitions", F.array(F.lit("more")))).otherwise(F.col("definitions"))
    return b.entries(spark, d).select("pos", ops.classify_error(key, F.col("karen"), defs, F.col("definitions")).alias("kind"))


@query("parse_ts", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_ts(spark, d):
    t = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return b.table(spark, d, "events").select("event_id", ops.parse_ts(t, "1970-01-01 00:00:00").alias("parsed"))


@query("search_entries", WITH + """, f AS (SELECT * FROM entries WHERE contains(lower(concat_ws(' ', karen, array_to_string(definitions, ' '), source)), 'tion the') AND flag)
SELECT pos, karen, page, (SELECT count(*) FROM f) AS total FROM f ORDER BY pos LIMIT 200""")
def search_entries(spark, d):
    return ops.search_entries(b.entries(spark, d), "tion THE", flagged=True).select("pos", "karen", "page", "total")


@query("page_retention", WITH + "SELECT pos, page, coalesce(page, 0) <= 518 AS kept FROM entries")
def page_retention(spark, d):
    kept, diverted = ops.page_retention(b.entries(spark, d))
    return kept.select("pos", "page", F.lit(True).alias("kept")).unionByName(diverted.select("pos", "page", F.lit(False).alias("kept")))


@query("illegal_chars", WITH + "SELECT pos, karen, page FROM entries WHERE contains(karen, '%') OR contains(karen, '|')")
def illegal_chars(spark, d):
    return ops.find_illegal_chars(b.entries(spark, d), ["%", "|"])


@query("entry_quality", WITH + """
SELECT count(*) AS total, count(*) FILTER (WHERE len(list_filter(definitions, lambda x: x <> '')) = 0) AS no_definitions, count(*) FILTER (WHERE karen = '') AS no_key FROM entries""")
def entry_quality(spark, d):
    return ops.data_quality(b.entries(spark, d))


@query("needs_review", WITH + ", f AS (SELECT * FROM entries WHERE flag) SELECT pos, karen, 'flagged' AS reason, (SELECT count(*) FROM f) AS total FROM f ORDER BY pos LIMIT 20")
def needs_review(spark, d):
    return ops.needs_review(b.entries(spark, d))


@query("truncated_defs", WITH + "SELECT pos, karen FROM entries WHERE len(list_filter(definitions, lambda x: length(x) > 5 AND NOT x LIKE '%.')) > 0")
def truncated_defs(spark, d):
    return ops.truncated_definition(b.entries(spark, d))


@query("skip_processed", WITH + """
SELECT source || '::p::' || CAST(page AS VARCHAR) AS key, count(*) AS n FROM entries GROUP BY 1
HAVING key NOT IN (SELECT DISTINCT source || '::p::' || CAST(page AS VARCHAR) FROM entries WHERE pos % 2 = 0)""")
def skip_processed(spark, d):
    e = b.entries(spark, d).withColumn("key", F.concat("source", F.lit("::p::"), F.col("page").cast("string")))
    return ops.skip_processed(e, e.where("pos % 2 = 0")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("link_headwords", WITH + """, t AS (SELECT DISTINCT pos, unnest(string_split(array_to_string(definitions, ' '), ' ')) AS term FROM entries),
best AS (SELECT karen, min(pos) AS target FROM entries GROUP BY karen)
SELECT t.pos, t.term, best.target FROM t JOIN best ON t.term = best.karen""")
def link_headwords(spark, d):
    e = b.entries(spark, d)
    return ops.link_headwords(e, terms_of(e)).distinct()  # positions may repeat


@query("first_headword", WITH + ", r AS (SELECT *, row_number() OVER (PARTITION BY karen ORDER BY flag DESC, pos) AS n FROM entries) SELECT karen, pos, flag FROM r WHERE n = 1")
def first_headword(spark, d):
    return ops.first_per_key(b.entries(spark, d), ["karen"], F.col("flag").desc(), "pos").select("karen", "pos", "flag")


@query("last_per_key", WITH + "SELECT karen, max(pos) AS pos, arg_max(source, pos) AS source FROM entries GROUP BY karen")
def last_per_key(spark, d):
    return b.entries(spark, d).groupBy("karen").agg(F.max("pos").alias("pos"), F.max_by("source", "pos").alias("source"))


@query("dedupe_rows", WITH + "SELECT min(pos) AS pos, karen, count(*) AS n FROM entries GROUP BY karen, definitions")
def dedupe_rows(spark, d):
    return ops.dedupe_rows(b.entries(spark, d), "karen", "definitions").select("pos", "karen", "n")


def sql_extract(marker):
    rest = f"substr(t, instr(lower(t), '{marker}') + {len(marker)})"
    return f"CASE WHEN instr(lower(t), '{marker}') > 0 THEN nullif(trim(regexp_extract({rest}, '^[A-Za-z][A-Za-z\\s\\-]{{1,40}}', 0)), '') END"


RULES = [(f, m) for f, ms in ops.MARKERS.items() for m in ms]
HITS = WITH + f""", l AS (SELECT pos, karen, CAST(unnest(range(len(definitions))) AS INTEGER) AS line, unnest(definitions) AS t0 FROM entries WHERE karen <> ''),
m AS (SELECT pos, karen, line, CASE line % 3 WHEN 0 THEN 'see ' WHEN 1 THEN 'x from ' ELSE 'n.x co. ' END || regexp_replace(t0, '[^\\x00-\\x7f]', '', 'g') AS t FROM l),
h AS ({' UNION ALL '.join(f"SELECT pos, karen, line, {k} AS rule, '{f}' AS field, {sql_extract(x)} AS found FROM m" for k, (f, x) in enumerate(RULES))}),
hits AS (SELECT * FROM h WHERE found IS NOT NULL)"""
TAGS = """, tags AS (SELECT pos, karen, 1000000 AS line, 0 AS rule, 'compound_entry' AS field, source AS found FROM entries WHERE karen <> '' AND pos % 2 = 0
UNION ALL SELECT pos, karen, 1000000, 1, 'etymology', 'tag' || source FROM entries WHERE karen <> '' AND pos % 2 = 0 UNION ALL SELECT pos, karen, 1000000, 2, 'cross_reference', 'other' FROM entries WHERE karen <> '' AND pos % 2 = 0),
grammar AS (SELECT pos, karen, line, 99 AS rule, 'part_of_speech' AS field, nullif(regexp_extract(t, '\\b(v\\.i\\.|v\\.t\\.|v\\.|n\\.|adj\\.|adv\\.|prep\\.|conj\\.|pron\\.|interj\\.|part\\.)\\b', 1), '') AS found FROM m),
every AS (SELECT * FROM hits UNION ALL SELECT * FROM tags UNION ALL SELECT * FROM grammar WHERE found IS NOT NULL)"""


def marked(spark, d):
    """Entries whose lines start with a marker."""
    lead = lambda x, i: F.concat(F.when(i % 3 == 0, "see ").when(i % 3 == 1, "x from ").otherwise("n.x co. "), F.regexp_replace(x, r"[^\x00-\x7f]", ""))
    return b.entries(spark, d).withColumn("definitions", F.transform("definitions", lead))


@query("relations", HITS + TAGS + """, f AS (SELECT karen, field, found, min(CAST(pos AS HUGEINT) * 1000000000 + line * 100 + rule) AS seq FROM every GROUP BY karen, field, found)
SELECT karen, field, CASE WHEN field IN ('etymology', 'ditto_of', 'part_of_speech') THEN arg_min(found, seq) ELSE string_agg(found, '|' ORDER BY seq) END AS found FROM f GROUP BY karen, field""")
def relations(spark, d):
    even = F.col("pos") % 2 == 0
    tags = F.create_map(F.lit("compound_entry"), F.array("source"), F.lit("etymology"), F.array(F.concat(F.lit("tag"), "source")), F.lit("interchangeable_with"), F.array(F.lit("other")), F.lit("unknown"), F.array(F.lit("x")))
    return ops.relations(marked(spark, d).withColumn("tagged", F.when(even, tags))).select("karen", "field", F.array_join("found", "|").alias("found"))


@query("relation_stats", HITS + "SELECT field, count(*) AS hits FROM hits GROUP BY field")
def relation_stats(spark, d):
    return ops.relation_hits(marked(spark, d))


def sql_parts(col):
    from lexicarta.functions import collation as c

    bare = f"regexp_replace({col}, 'မ်|ဒ်', '', 'g')"
    pick = lambda chars, of: f"coalesce(regexp_extract({of}, '(?s).*([{chars}])', 1), '')"
    return f"{pick(c.CONSONANT, bare)} AS consonant, {pick(c.VOWEL, bare)} AS vowel, coalesce(regexp_extract({col}, '(?s).*(မ်|ဒ်|[{c.TONE}])', 1), '') AS tone, array_to_string(regexp_extract_all({bare}, '[{c.MEDIAL}]'), '') AS medials"


@query("propagate_correction", "WITH " + b.VOCABULARY + f""", k AS (SELECT native, {sql_parts('native')} FROM vocabulary),
f AS (SELECT native AS original, native || 'း' AS corrected, CASE n % 4 WHEN 0 THEN 'tone_error' WHEN 1 THEN 'medial_error' WHEN 2 THEN 'consonant_error' ELSE 'other' END AS error_type FROM vocabulary),
o AS (SELECT f.*, {sql_parts('original')} FROM f),
m AS (SELECT k.native AS before, o.original, o.corrected, o.error_type, CASE error_type
  WHEN 'tone_error' THEN k.consonant = o.consonant AND k.vowel = o.vowel
  WHEN 'medial_error' THEN k.consonant = o.consonant AND k.vowel = o.vowel AND k.tone = o.tone
  WHEN 'consonant_error' THEN k.vowel = o.vowel AND k.tone = o.tone AND k.medials = o.medials ELSE false END AS applied
  FROM k JOIN o ON contains(k.native, o.original))
SELECT before, original, error_type, applied, CASE WHEN applied THEN replace(before, original, corrected) ELSE before END AS after FROM m""")
def propagate_correction(spark, d):
    v = files.written(b.vocabulary(spark, d), "vocabulary")  # read as texts and as fixes
    k = F.col("n") % 4
    kind = F.when(k == 0, "tone_error").when(k == 1, "medial_error").when(k == 2, "consonant_error").otherwise("other")
    fixes = v.select(F.col("native").alias("original"), F.concat("native", F.lit("း")).alias("corrected"), kind.alias("error_type"))
    return ops.propagate_correction(v.select(F.lit(0).alias("pos"), "native"), fixes).drop("pos")


CORRECTIONS = """, c AS (SELECT karen, pos AS seq, CASE pos % 3 WHEN 0 THEN 'wrong_headword' WHEN 1 THEN 'wrong_definition' ELSE 'formatting_error' END AS kind, source FROM entries WHERE pos % 4 = 1),
latest AS (SELECT karen, arg_max(kind, seq) AS kind, arg_max(source, seq) AS fixed FROM c GROUP BY karen)"""


@query("apply_ground_truth", WITH + CORRECTIONS + """, j AS (SELECT e.*, kind, fixed, len(list_filter(definitions, lambda x: length(x) > 5 AND NOT x LIKE '%.')) > 0 AS cut FROM entries e LEFT JOIN latest USING (karen))
SELECT pos, karen, CASE WHEN kind = 'wrong_definition' THEN fixed ELSE array_to_string(definitions, '|') END AS definitions,
  coalesce(kind = 'wrong_headword' OR (kind = 'formatting_error' AND cut), false) AS needs_review,
  CASE WHEN kind = 'wrong_headword' THEN 'wrong headword' WHEN kind = 'formatting_error' AND cut THEN 'cut definition' END AS review_reason FROM j""")
def apply_ground_truth(spark, d):
    e = b.entries(spark, d)
    k = F.col("pos") % 3
    kind = F.when(k == 0, "wrong_headword").when(k == 1, "wrong_definition").otherwise("formatting_error")
    fixes = e.where("pos % 4 = 1").select("karen", F.col("pos").alias("at"), kind.alias("kind"), F.array("source").alias("definitions"))
    return ops.apply_ground_truth(e, fixes).withColumn("definitions", F.array_join("definitions", "|"))


@query("few_shot", WITH + """, c AS (SELECT source AS grp, pos AS seq, karen, CASE WHEN pos % 3 = 0 THEN 'wrong_headword' ELSE 'wrong_definition' END AS kind, page, row_number() OVER (PARTITION BY source ORDER BY pos DESC) AS n FROM entries)
SELECT grp, string_agg('- ' || karen || ' -> ' || CAST(page AS VARCHAR), chr(10) ORDER BY seq) AS prompt FROM c WHERE n <= 10 AND kind = 'wrong_definition' GROUP BY grp""")
def few_shot(spark, d):
    kind = F.when(F.col("pos") % 3 == 0, "wrong_headword").otherwise("wrong_definition")
    c = b.entries(spark, d).select(F.col("source").alias("grp"), F.col("pos").alias("at"), F.col("pos").alias("id"), kind.alias("kind"), F.col("karen").alias("predicted"), F.col("page").cast("string").alias("verified"))
    return ops.few_shot(c)


@query("match_dict_lines", "WITH " + b.ENTRIES + ", " + b.LINES + """, m AS (SELECT split_part(raw, ' ', 1) AS term, split_part(raw, ' ', 2) AS meaning, [file, line_no] AS seq FROM lines WHERE contains(raw, ' ')),
l AS (SELECT term, arg_max(meaning, seq) AS meaning FROM m GROUP BY term)
SELECT e.pos, e.karen, l.meaning FROM entries e JOIN l ON e.karen = l.term""")
def match_dict_lines(spark, d):
    """Lines as `term meaning`; of a term's lines the last counts."""
    rows = b.lines(spark, d).where(F.contains("raw", F.lit(" "))).select(F.split_part("raw", F.lit(" "), F.lit(1)).alias("karen"), F.split_part("raw", F.lit(" "), F.lit(2)).alias("meaning"), "file", "line_no")
    return ops.match_dictionary_lines(b.entries(spark, d), rows)
