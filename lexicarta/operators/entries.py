"""Dictionary entries: normalising, viewing, searching, linking, correcting."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.functions import collation, text
from lexicarta.operators.containment import holding
from lexicarta.sources import files

ENTRY_TYPES = ["headword", "compound", "example"]
#: Other names of segment kinds (fixed values).
KIND_ALIASES = {
    "example sentence": "example", "examples": "example", "xref": "cross_reference", "cross reference": "cross_reference", "cross-reference": "cross_reference",
    "cf": "cross_reference", "cognate term": "cognate", "analogous term": "analogous", "grammar principle": "grammar", "grammar note": "grammar",
    "headword term": "headword",
}
#: What announces a relation in a definition (fixed values); of those in SINGLE a key has one.
MARKERS = {
    "etymology": ["from "], "compound_entry": ["co. ", "comp. "], "cross_reference": ["see ", "cf. "], "ditto_of": ["do. "],
    "analogous_terms": ["analogous", "analogously", "anal. "],
}
SINGLE = ["etymology", "ditto_of"]


def trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def without_blank(definitions: Column) -> Column:
    """The definitions that hold more than blanks, trimmed; null is none."""
    kept = F.filter(F.coalesce(definitions, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"\s", "") != "")
    return F.transform(kept, trimmed)


def normalise_entries(df: DataFrame, source: str = "", page: int | None = None, now: str | None = None) -> DataFrame:
    """Keys trimmed, blank definitions dropped, unknown types made headwords, defaults filled in; null keys and lists become empty."""
    kind = F.when(F.col("entry_type").isin(ENTRY_TYPES), F.col("entry_type")).otherwise("headword")
    return df.select(
        "pos",
        trimmed(F.coalesce("karen", F.lit(""))).alias("karen"),
        without_blank(F.col("definitions")).alias("definitions"),
        F.coalesce("page", F.lit(page)).cast("int").alias("page"),
        F.coalesce("flag", F.lit(False)).alias("flag"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit(source)).alias("source"),
        kind.alias("entry_type"),
        F.lit(now).cast("timestamp").alias("updated_at"),
    )


#: The lists of an entry's analysis (fixed values).
ANALYSIS = ["examples", "headword_terms", "related_items", "segments", "sense_labels"]


def normalise_analysis(analysis: Column) -> Column:
    """Analysis as JSON text becomes its five lists, each an array of items: objects as JSON text, strings as they are.

    What is no list is an empty one, and so are all five of what is no object, or null.
    """
    known, empty = F.from_json(analysis, "map<string,string>"), F.array().cast("array<string>")
    one = lambda v: F.coalesce(F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")), empty)
    return F.struct(*(one(F.try_element_at(known, F.lit(k))).alias(k) for k in ANALYSIS))


def merge_lists(a: Column, b: Column) -> Column:
    """Both lists' items in order, each once."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def merge_analysis(a: Column, b: Column) -> Column:
    """Two normalised analyses, list by list."""
    return F.struct(*(merge_lists(a[k], b[k]).alias(k) for k in ANALYSIS))


def dedupe_items(items: Column) -> Column:
    """A list's items in order, each once, as JSON objects; a bare string x becomes {"text": x}."""
    return F.transform(F.array_distinct(items), lambda x: F.when(x.startswith("{"), x).otherwise(F.to_json(F.struct(x.alias("text")))))


def item_field(item: Column, name: str) -> Column:
    """A field of an item as text; of a bare string its text is the string."""
    bare = item if name == "text" else F.lit(None).cast("string")
    return F.btrim(F.coalesce(F.when(item.startswith("{"), F.get_json_object(item, f"$.{name}")).otherwise(bare), F.lit("")))


def analysis_text(analysis: Column) -> Column:
    """A normalised analysis as JSON text, with a blank after each comma and colon."""
    item = lambda x: F.when(x.startswith("{"), x).otherwise(F.regexp_extract(F.to_json(F.struct(x.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))
    lists = [F.concat(F.lit(f'"{k}": ['), F.array_join(F.transform(analysis[k], item), ", "), F.lit("]")) for k in ANALYSIS]
    return F.concat(F.lit("{"), F.concat_ws(", ", *lists), F.lit("}"))


def segment_kind(kind: Column) -> Column:
    """A segment's kind under its own name; blank is other."""
    k = F.btrim(F.lower(F.coalesce(kind, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in KIND_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, k), F.nullif(k, F.lit("")), F.lit("other"))


def inject_labels(definition: Column, labels: Column) -> Column:
    """Numbered senses get their label: `1.` becomes `1. (noun)`. labels: array of (number, label), numbers each once."""
    good = F.filter(labels, lambda x: (x["label"] != "") & x["number"].rlike("^[0-9]+$"))
    step = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(^|[\s(;])"), x["number"], F.lit(r"\.(\s*)")), F.concat(F.lit("$1"), x["number"], F.lit(". ("), x["label"], F.lit(")$2")))
    return F.aggregate(good, F.coalesce(definition, F.lit("")), step)


def escape_html(t: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(char), F.lit(name))
    return t


def first_replaced(t: Column, word: Column, new: Column) -> Column:
    """t with the first occurrence of a word replaced."""
    at = F.instr(t, word)
    return F.when((word != "") & (at > 0), F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + F.length(word), F.length(t)))).otherwise(t)


def highlight_segments(definition: Column, segments: Column) -> Column:
    """Escaped text with the first occurrence of each segment (text, kind) marked, longest first, and its lines broken."""
    order = F.array_sort(F.filter(segments, lambda s: s["text"] != ""), lambda a, b: F.length(b["text"]) - F.length(a["text"]))

    def mark(t, s):
        word = escape_html(s["text"])
        return first_replaced(t, word, F.concat(F.lit('<span class="seg seg-'), segment_kind(s["kind"]), F.lit('">'), word, F.lit("</span>")))

    return F.replace(F.aggregate(order, escape_html(F.coalesce(definition, F.lit(""))), mark), F.lit("\n"), F.lit("<br>"))


def link_terms(html: Column, terms: Column) -> Column:
    """The first occurrence of each term (text, target) in rendered text becomes a link to its entry."""

    def link(t, x):
        word, target = escape_html(x["text"]), x["target"].cast("string")
        new = F.concat(F.lit('<a href="#entry-'), target, F.lit('" class="hw-link karen" data-idx="'), target, F.lit('">'), word, F.lit("</a>"))
        return first_replaced(t, word, new)

    return F.aggregate(terms, html, link)


def view_entries(df: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Entries (pos, karen, definitions, analysis: normalised) as they are shown.

    (pos, karen, display_definitions, linked_definitions, tab_examples, tab_headwords, tab_related): labels of senses
    put in, segments marked, terms of headwords linked to their entries (those of entries, else of df), three tabs of items.
    """
    terms = df.select("pos", F.posexplode(dedupe_items(F.col("analysis.headword_terms"))).alias("at", "item")).select("pos", "at", item_field(F.col("item"), "text").alias("term"))
    linked = link_headwords(df if entries is None else entries, terms.where("term <> ''"), "at")
    listed = linked.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("term").alias("text"), "target"))), lambda x: F.struct(x["text"].alias("text"), x["target"].alias("target"))).alias("links"))
    labels = F.transform("analysis.sense_labels", lambda x: F.struct(item_field(x, "number").alias("number"), item_field(x, "label").alias("label")))
    segments = F.transform(F.filter("analysis.segments", lambda x: x.startswith("{")), lambda x: F.struct(item_field(x, "text").alias("text"), item_field(x, "kind").alias("kind")))
    empty = F.array().cast("array<struct<text:string,target:bigint>>")
    rows = df.withColumns({"labels": labels, "segs": segments}).join(listed, "pos", "left").withColumn("links", F.coalesce("links", empty))
    shown = rows.withColumn("display_definitions", F.transform("definitions", lambda t: inject_labels(t, F.col("labels"))))
    return shown.select(
        "pos",
        "karen",
        "display_definitions",
        F.transform("display_definitions", lambda t: link_terms(highlight_segments(t, F.col("segs")), F.col("links"))).alias("linked_definitions"),
        dedupe_items(F.col("analysis.examples")).alias("tab_examples"),
        dedupe_items(F.col("analysis.headword_terms")).alias("tab_headwords"),
        dedupe_items(F.col("analysis.related_items")).alias("tab_related"),
    )


def search_blob(analysis: Column | None = None) -> Column:
    """What a search looks in: key, definitions, source and analysis (normalised), lower-cased."""
    parts = ["karen", "definitions", "source"]
    return F.lower(F.concat_ws(" ", *parts) if analysis is None else F.concat_ws(" ", *parts, analysis_text(analysis)))


def search_entries(df: DataFrame, q: str = "", page: str | None = None, flagged: bool = False, limit: int = 200) -> DataFrame:
    """Entries that hold q in any case (`#n`: the one at place n), of a page, flagged; the first by place, with the total."""
    if q.startswith("#") and q[1:].isdigit():
        found = df.where(F.col("pos") == int(q[1:]))
    else:
        blob = search_blob(F.col("analysis") if "analysis" in df.columns else None)
        found = df.where(F.contains(blob, F.lit(q.lower()))) if q else df
    found = found.where(F.col("page").cast("string") == page) if page else found
    found = found.where("flag") if flagged else found
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("pos").limit(limit).crossJoin(F.broadcast(total))  # one row


def edit_entries(df: DataFrame, edits: DataFrame, deleted: DataFrame, now: str) -> DataFrame:
    """Edits (pos, karen, definitions, flag, promote) laid over entries, deletions taken out; places stay as they are.

    What is edited is normalised again (see normalise_entries); promoted entries are headwords.
    """
    e = edits.select("pos", *(F.col(c).alias(f"new_{c}") for c in ("karen", "definitions", "flag", "promote")), F.lit(True).alias("edited"))
    joined = df.join(deleted.select("pos"), "pos", "left_anti").join(e, "pos", "left")
    promote, changed = F.coalesce("new_promote", F.lit(False)), F.col("edited").isNotNull()
    return joined.select(
        "pos",
        F.when(changed, trimmed(F.coalesce("new_karen", "karen", F.lit("")))).otherwise(F.col("karen")).alias("karen"),
        F.when(changed, without_blank(F.coalesce("new_definitions", "definitions"))).otherwise(F.col("definitions")).alias("definitions"),
        F.coalesce("new_flag", "flag").alias("flag"),
        F.when(promote, "headword").otherwise(F.col("entry_type")).alias("entry_type"),
        promote.alias("promoted"),
        F.when(changed, F.lit(now)).alias("updated_at"),
    )


def reanalyse_entries(df: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Entries (with entry_type and analysis, normalised) whose analysis a result (pos, entry_type, analysis: JSON text) replaces.

    A type that isn't one keeps the old; definitions never change. An entry without a result stays as it is.
    """
    new = results.select("pos", F.col("entry_type").alias("new_type"), normalise_analysis(F.col("analysis")).alias("new_analysis"), F.lit(True).alias("done"))
    columns = {
        "entry_type": F.when(F.col("new_type").isin(ENTRY_TYPES), F.col("new_type")).otherwise(F.col("entry_type")),
        "analysis": F.when(F.col("done"), F.col("new_analysis")).otherwise(F.col("analysis")),
        "updated_at": F.when(F.col("done"), F.lit(now)),
    }
    return df.join(new, "pos", "left").select(*(columns.get(c, F.col(c)).alias(c) for c in dict.fromkeys([*df.columns, "updated_at"])))


def classify_error(pred_key: Column, true_key: Column, pred_defs: Column, true_defs: Column) -> Column:
    """Which part of a prediction was wrong."""
    return F.when(~pred_key.eqNullSafe(true_key), "wrong_headword").when(~pred_defs.eqNullSafe(true_defs), "wrong_definition").otherwise("formatting_error")


def parse_ts(col: Column, earliest: str = "0001-01-01 00:00:00") -> Column:
    """The first 19 characters as a time; blank or bad text is the earliest time."""
    return F.coalesce(F.try_to_timestamp(F.substring(col, 1, 19)), F.lit(earliest).cast("timestamp"))


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Bytes of headwords that are sent to the terms, as measured, and what one takes there besides its letters.
MOST_SENT, HEADWORD_BYTES = 64 << 20, 100


def link_headwords(df: DataFrame, terms: DataFrame, *more: str, most_sent: int = MOST_SENT) -> DataFrame:
    """(pos, term, target, *more): terms (pos, term, *more) and the place of the entry with that key, promoted or headword ones first, then the lowest.

    Keys of up to most_sent bytes are sent to the terms, which then aren't shuffled; more of them meet the terms in a join.
    """
    best = df.groupBy("karen").agg(F.min(F.struct(F.when(F.col("entry_type") == "headword", 0).otherwise(1).alias("prio"), "pos")).alias("best"))
    known = files.written(best.where("karen is not null").select(F.col("karen").alias("term"), F.col("best.pos").alias("target")), "headwords")
    held = known.agg(F.sum(F.octet_length("term") + HEADWORD_BYTES)).first()[0] or 0
    return terms.join(F.broadcast(known) if held <= most_sent else known.hint("merge"), "term").select("pos", "term", "target", *more)


#: Fields that an entry may have tagged itself; those that no relation is named after are cross references (fixed values).
TAGGED = ["etymology", "compound_entry", "cross_reference", "ditto_of", "analogous_terms", "part_of_speech", "interchangeable_with"]


def relations(df: DataFrame) -> DataFrame:
    """(karen, field, found) of entries (pos, karen, definitions, tagged): what the definitions' markers announce and entries are tagged with.

    tagged, if there, maps fields to lists of values, which come after the entry's definitions. Found values are distinct in
    order, of single fields the first. The first grammar label of a key is its part of speech.
    """
    lines = df.where("karen <> ''").select("pos", "karen", F.posexplode("definitions").alias("line", "definition"))
    rules = [(f, m) for f, ms in MARKERS.items() for m in ms]
    hits = F.array(
        *[F.struct(F.lit(k).alias("rule"), F.lit(f).alias("field"), text.extract_after(F.col("definition"), m).alias("found")) for k, (f, m) in enumerate(rules)],
        F.struct(F.lit(len(rules)).alias("rule"), F.lit("part_of_speech").alias("field"), text.part_of_speech(F.col("definition")).alias("found")),
    )
    rows = lines.select("pos", "karen", "line", F.explode(F.filter(hits, lambda h: h["found"].isNotNull())).alias("h")).select("pos", "karen", "line", "h.*")
    if "tagged" in df.columns:
        tags = df.where("karen <> ''").select("pos", "karen", F.explode("tagged").alias("field", "values")).where(F.col("field").isin(TAGGED))
        field = F.when(F.col("field").isin([*MARKERS, "part_of_speech"]), F.col("field")).otherwise("cross_reference")
        place = F.array_position(F.array(*map(F.lit, TAGGED)), F.col("field")).cast("int") * 1_000_000
        rows = rows.unionByName(tags.select("pos", "karen", F.lit(2**31 - 1).alias("line"), place.alias("place"), field.alias("field"), F.posexplode("values").alias("rule", "found")).select("pos", "karen", "line", (F.col("place") + F.col("rule")).alias("rule"), "field", "found"))
    first = rows.groupBy("karen", "field", "found").agg(F.min(F.struct("pos", "line", "rule")).alias("at"))
    listed = first.groupBy("karen", "field").agg(F.sort_array(F.collect_list(F.struct("at", "found"))).alias("all"))
    return listed.select("karen", "field", F.when(F.col("field").isin([*SINGLE, "part_of_speech"]), F.slice("all", 1, 1)).otherwise(F.col("all"))["found"].alias("found"))


def relation_hits(df: DataFrame) -> DataFrame:
    """(field, hits): how often markers of each field announce something."""
    lines = df.where("karen <> ''").select(F.explode("definitions").alias("definition"))
    hits = F.array(*[F.struct(F.lit(f).alias("field"), text.extract_after(F.col("definition"), m).alias("found")) for f, ms in MARKERS.items() for m in ms])
    return lines.select(F.explode(hits).alias("h")).where("h.found is not null").groupBy("h.field").agg(F.count(F.lit(1)).alias("hits"))


def propagate_correction(df: DataFrame, fixes: DataFrame, key: str = "native") -> DataFrame:
    """df with each fix (original, corrected, error_type) applied where the same context makes it safe: (pos, before, after, applied).

    A tone error spreads within consonant and vowel, a medial error within those and the tone, a consonant error within vowel,
    tone and medials. Keys meet fixes in a trie of what fixes look for, so each row is an answer.
    """
    rows = df.where(F.length(key) > 0).select("pos", F.col(key).alias("before"), collation.decompose(F.col(key)).alias("p"))
    f = fixes.select("original", "corrected", "error_type", collation.decompose(F.col("original")).alias("o"))
    same = lambda *names: F.expr(" AND ".join(f"p.{n} = o.{n}" for n in names))
    safe = F.when(F.col("error_type") == "tone_error", same("consonant", "vowel")).when(F.col("error_type") == "medial_error", same("consonant", "vowel", "tone")).when(F.col("error_type") == "consonant_error", same("vowel", "tone", "medials")).otherwise(False)
    met = holding(rows, "before", f, "original")
    return met.select("pos", "before", "original", "error_type", safe.alias("applied"), F.when(safe, F.replace("before", F.col("original"), F.col("corrected"))).otherwise(F.col("before")).alias("after"))


def apply_ground_truth(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Entries with the latest correction of their key: wrong headwords flagged, definitions overwritten, cut ones flagged."""
    latest = corrections.groupBy("karen").agg(F.max_by(F.struct("kind", "definitions"), "at").alias("c"))
    cut = F.exists("definitions", lambda x: (F.length(x) > 5) & ~F.endswith(x, F.lit(".")))
    return df.join(latest, "karen", "left").select(
        "pos",
        "karen",
        F.when(F.col("c.kind") == "wrong_definition", F.col("c.definitions")).otherwise(F.col("definitions")).alias("definitions"),
        F.coalesce((F.col("c.kind") == "wrong_headword") | ((F.col("c.kind") == "formatting_error") & cut), F.lit(False)).alias("needs_review"),
        F.when(F.col("c.kind") == "wrong_headword", "wrong headword").when((F.col("c.kind") == "formatting_error") & cut, "cut definition").alias("review_reason"),
    )


def few_shot(corrections: DataFrame, n: int = 10) -> DataFrame:
    """(grp, prompt): of each group's last n corrections those of definitions, in order, as one text."""
    w = Window.partitionBy("grp").orderBy(F.col("at").desc(), F.col("id").desc())
    last = corrections.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= n) & (F.col("kind") == "wrong_definition"))
    line = F.concat(F.lit("- "), "predicted", F.lit(" -> "), "verified")
    return last.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", line.alias("t")))), lambda x: x["t"]), "\n").alias("prompt"))


def parse_model_output(df: DataFrame) -> DataFrame:
    """(request_id, item, karen, definitions, error) of replies (request_id, raw): an array, fenced, in an object, or in prose; else an error."""
    schema = "array<struct<karen:string,definitions:array<string>>>"
    bare = F.btrim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    tried = F.coalesce(
        F.when(bare.startswith("["), F.from_json(bare, schema)),
        F.when(bare.startswith("{"), F.from_json(bare, f"entries {schema}")["entries"]),
        F.when(inner != "", F.from_json(inner, schema)),
    )
    rows = df.select("request_id", tried.alias("items"))
    return rows.select("request_id", F.posexplode_outer("items").alias("item", "e"), F.when(F.col("items").isNull(), "no entries in the reply").alias("error")).select(
        "request_id", "item", "e.karen", "e.definitions", "error"
    )


def data_quality(df: DataFrame) -> DataFrame:
    """Counts of entries, those without definitions and those without a key."""
    blank = F.size(F.filter("definitions", lambda x: x != "")) == 0
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(blank).alias("no_definitions"), F.count_if(F.col("karen") == "").alias("no_key"))


def ledger_quality(ledger: DataFrame) -> DataFrame:
    """Counts of a ledger's rows (file, value as JSON text) and of those whose value is no object."""
    return ledger.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(F.ltrim("value").startswith("{") & F.from_json("value", "map<string,string>").isNotNull(), F.lit(False))).alias("wrong_type"))


def append_entries(df: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones behind them, repeats and all; columns that one side lacks are null there."""
    return df.unionByName(new, allowMissingColumns=True)


def page_from_file(name: Column, offset: int = 0) -> Column:
    """The first number in a file's name, moved by an offset; null without one, or if it is too large for a page."""
    return F.nullif(F.regexp_extract(name, "[0-9]+", 0), F.lit("")).try_cast("int") + offset


def safe_name(name: Column) -> Column:
    """A file's name with one underscore for whatever isn't a letter, a digit, a dot or a joining mark."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def mime_type(extension: Column, kinds: dict[str, str], default: str = "application/octet-stream") -> Column:
    """The type that an extension stands for, in any case, or the default."""
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit(default))


def page_retention(df: DataFrame, last: int = 518) -> tuple[DataFrame, DataFrame]:
    """Entries up to a page, with those of no page, and the others."""
    keep = F.coalesce("page", F.lit(0)) <= last
    return df.where(keep), df.where(~keep)


def find_illegal_chars(df: DataFrame, banned: list[str]) -> DataFrame:
    """(pos, karen, page) of entries whose key holds a banned string."""
    found = F.lit(False)
    for b in banned:
        found = found | F.contains("karen", F.lit(b))
    return df.where(found).select("pos", "karen", "page")


def needs_review(df: DataFrame, n: int = 20) -> DataFrame:
    """(pos, karen, reason, total): the first n flagged entries, and how many there are."""
    flagged = df.where("flag")
    total = F.broadcast(flagged.agg(F.count(F.lit(1)).alias("total")))  # one row
    return flagged.orderBy("pos").limit(n).crossJoin(total).select("pos", "karen", F.lit("flagged").alias("reason"), "total")


def truncated_definition(df: DataFrame) -> DataFrame:
    """(pos, karen) of entries with a definition of more than five characters that doesn't end in a dot."""
    return df.where(F.exists("definitions", lambda x: (F.length(x) > 5) & ~F.endswith(x, F.lit(".")))).select("pos", "karen")


def skip_processed(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items (key, ...) whose key isn't in a ledger (key)."""
    return items.join(ledger.select("key").distinct(), "key", "left_anti")


def dedupe_rows(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, pos, n): rows that are equal in columns, nested ones too, as one, with the first place and their number."""
    return df.groupBy(*columns).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))


def match_dictionary_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """(pos, karen, meaning): entries with what lines (file, line_no, karen, meaning) say of their key; the last line of a key counts."""
    last = lines.groupBy("karen").agg(F.max_by("meaning", F.struct("file", "line_no")).alias("meaning"))
    return df.join(last, "karen").select("pos", "karen", "meaning")
