"""Queries of detections, labels, classes and the files around them."""

from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.functions.numbers import rounded
from lexicarta.operators import detections as ops
from lexicarta.operators import generate
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


DET = "WITH " + b.DETECTIONS


@query("box_convert", DET + """
SELECT event_id, (x1 + least(x2, 640)) / 2 AS cx, (y1 + least(y2, 480)) / 2 AS cy, round((x1 + least(x2, 640)) / 2 / 640, 4) AS nx, round((y1 + least(y2, 480)) / 2 / 480, 4) AS ny,
  round((least(x2, 640) - x1) / 640, 4) AS nw, round((least(y2, 480) - y1) / 480, 4) AS nh FROM detections""")
def box_convert(spark, d):
    return ops.box_convert(b.detections(spark, d)).select("event_id", "cx", "cy", "nx", "ny", "nw", "nh")


@query("valid_boxes", DET + " SELECT event_id, image, class_idx FROM detections WHERE x2 <= 600 AND y2 <= 450")
def valid_boxes(spark, d):
    return ops.valid_boxes(b.detections(spark, d), 600, 450).select("event_id", "image", "class_idx")


@query("class_from_filename", "WITH " + b.IMAGES + """, s AS (SELECT file, regexp_replace(file, '\\.[^.]*$', '') AS stem FROM images)
SELECT file, regexp_extract(stem, '^(.*)_[A-Za-z0-9]{8}$', 1) AS name FROM s""")
def class_from_filename(spark, d):
    return b.images(spark, d).select("file", ops.class_from_filename(F.col("file")).alias("name"))


COMPONENTS = ", parts AS (SELECT class_idx, name, unnest(string_split(name, '_')) AS part, unnest(range(len(string_split(name, '_')))) AS i FROM classes), kinds AS (SELECT *, CASE WHEN i = 0 THEN 'base' WHEN part LIKE 'med%' THEN 'medial' WHEN regexp_matches(part, '^t[0-9]') THEN 'tone' ELSE 'vowel' END AS kind FROM parts)"


@query("label_components", DET + ", " + b.CLASSES + COMPONENTS + " SELECT event_id, kind, part FROM detections JOIN kinds USING (class_idx)")
def label_components(spark, d):
    parts = ops.label_components(b.classes(spark, d)).select("class_idx", "kind", "part")
    return b.detections(spark, d).join(parts, "class_idx").select("event_id", "kind", "part")


def syllable_tables(spark, d):
    """(class_idx, robo), (class_id, native), (native, gloss, pos), each from classes."""
    c = b.classes(spark, d)
    i = F.col("class_idx")
    robo = F.when(i % 7 == 0, F.lit("x")).otherwise((i + 1000).cast("string"))
    index = c.select("class_idx", robo.alias("robo"))
    syllables = c.where(i % 5 != 0).select((i + 1000).alias("class_id"), F.translate("name", b.LATIN, b.NATIVE).alias("native"))
    words = c.where(i % 3 != 0).select(F.translate("name", b.LATIN, b.NATIVE).alias("native"), "name", i.alias("pos"))
    return index, syllables, words.select("native", F.col("name").alias("gloss"), "pos")


@query("translate_detections", DET + ", " + b.CLASSES + f""", im AS (SELECT class_idx, CASE WHEN class_idx % 7 = 0 THEN 'x' ELSE CAST(class_idx + 1000 AS VARCHAR) END AS robo FROM classes),
sy AS (SELECT class_idx + 1000 AS class_id, translate(name, '{b.LATIN}', '{b.NATIVE}') AS native FROM classes WHERE class_idx % 5 <> 0),
di AS (SELECT translate(name, '{b.LATIN}', '{b.NATIVE}') AS native, arg_max(name, class_idx) AS gloss FROM classes WHERE class_idx % 3 <> 0 GROUP BY 1)
SELECT event_id, coalesce(sy.native, '?') AS native, coalesce(gloss, 'unknown') AS gloss, CASE WHEN robo IS NULL THEN 'not in map' WHEN TRY_CAST(robo AS INTEGER) IS NULL THEN 'not a number'
  WHEN sy.native IS NULL THEN 'no syllable' WHEN gloss IS NULL THEN 'no translation' ELSE 'ok' END AS status
FROM detections LEFT JOIN im USING (class_idx) LEFT JOIN sy ON TRY_CAST(robo AS INTEGER) = class_id LEFT JOIN di ON sy.native = di.native WHERE conf >= 0.25""")
def translate_detections(spark, d):
    return ops.translate_detections(b.detections(spark, d), *syllable_tables(spark, d)).select("event_id", "native", "gloss", "status")


@query("detections_export", DET + ", " + b.CLASSES + """, e AS (SELECT name, any_value(upper(name)) AS english FROM classes WHERE class_idx % 2 = 0 GROUP BY name)
SELECT event_id, coalesce(c.name, 'unknown_' || CAST(class_idx AS VARCHAR)) AS syllable, coalesce(e.english, 'no translation yet') AS english, printf('%.4f', conf) AS confidence
FROM detections LEFT JOIN classes c USING (class_idx) LEFT JOIN e ON e.name = coalesce(c.name, 'unknown_' || CAST(class_idx AS VARCHAR))""")
def detections_export(spark, d):
    c = b.classes(spark, d)
    words = c.where("class_idx % 2 = 0").select("name", text.simple_upper(F.col("name")).alias("english")).distinct()
    out = ops.label_detections(b.detections(spark, d), c, words)
    return out.select("event_id", "syllable", "english", F.format_string("%.4f", "conf").alias("confidence"))


@query("label_integrity", "WITH " + b.IMAGES + ", " + b.LABELS_TXT + """, f AS (SELECT coalesce(i.split, l.split) AS split, coalesce(i.stem, l.stem) AS stem,
  CASE WHEN l.stem IS NULL THEN 'no label' WHEN i.stem IS NULL THEN 'no image' ELSE 'ok' END AS state
  FROM images i FULL JOIN (SELECT DISTINCT split, stem FROM labels_txt) l ON i.split = l.split AND i.stem = l.stem),
r AS (SELECT *, row_number() OVER (PARTITION BY split, state ORDER BY stem) AS n FROM f)
SELECT split, state, count(*) AS rows, coalesce(string_agg(CAST(stem AS VARCHAR), ',' ORDER BY stem) FILTER (WHERE n <= 5 AND state <> 'ok'), '') AS first FROM r GROUP BY split, state""")
def label_integrity(spark, d):
    return ops.label_integrity(b.images(spark, d), b.labels_txt(spark, d))


@query("true_gaps", "WITH " + b.CLASS_METRICS + ", " + b.CLASSES + ", " + b.LABELS_TXT + """, n AS (SELECT class_idx, count(*) AS n FROM labels_txt WHERE split = 'valid' AND class_idx % 13 <> 0 GROUP BY 1)
SELECT m.class_idx, coalesce(c.name, '?') AS name, map50, coalesce(n.n, 0) AS instances,
  CASE WHEN n.n IS NULL THEN 'no_val' WHEN map50 < 0.5 THEN 'missed' WHEN map50 < 0.8 THEN 'weak' ELSE 'ok' END AS status
FROM class_metrics m LEFT JOIN n USING (class_idx) LEFT JOIN classes c USING (class_idx)""")
def true_gaps(spark, d):
    return ops.true_gaps(b.class_metrics(spark, d), b.labels_txt(spark, d).where("class_idx % 13 <> 0"), b.classes(spark, d))


@query("stuck_classes", "WITH " + b.CLASS_METRICS + ", " + b.LABELS_TXT + """, n AS (SELECT class_idx, count(*) AS instances FROM labels_txt WHERE split = 'valid' GROUP BY 1)
SELECT class_idx, map50, instances FROM class_metrics JOIN n USING (class_idx) WHERE map50 < 0.5 AND instances >= 10 ORDER BY instances DESC, class_idx LIMIT 20""")
def stuck_classes(spark, d):
    gaps = ops.true_gaps(b.class_metrics(spark, d), b.labels_txt(spark, d), b.classes(spark, d))
    return gaps.where("status = 'missed' and instances >= 10").orderBy(F.col("instances").desc(), "class_idx").limit(20).select("class_idx", "map50", "instances")


@query("gap_report", "WITH " + b.CLASS_METRICS + ", " + b.CLASSES + """, s AS (SELECT m.*, coalesce(c.name, '?') AS name, CASE WHEN map50 < 0.5 THEN 'missed' WHEN map50 < 0.8 THEN 'weak' ELSE 'ok' END AS status FROM class_metrics m LEFT JOIN classes c USING (class_idx))
SELECT status, count(*) AS n, round(avg(map50), 6) AS mean, string_agg(name, ',' ORDER BY map50, class_idx) AS names FROM s GROUP BY status""")
def gap_report(spark, d):
    return ops.gap_report(b.class_metrics(spark, d), b.classes(spark, d))


@query("detection_counts", DET + " SELECT class_idx, count(*) AS n, count(DISTINCT image) AS n_images FROM detections WHERE conf >= 0.25 GROUP BY class_idx")
def detection_counts(spark, d):
    return ops.detection_counts(b.detections(spark, d))


@query("image_hits", DET + """, i AS (SELECT DISTINCT user_id AS image FROM events), h AS (SELECT DISTINCT image FROM detections WHERE conf >= 0.25 AND image % 9 <> 0)
SELECT count(*) AS images, count(h.image) AS with_hits, count(*) - count(h.image) AS without_hits FROM i LEFT JOIN h USING (image)""")
def image_hits(spark, d):
    det = b.detections(spark, d)
    return ops.image_hits(det.where("image % 9 <> 0"), det)


SEEN = DET + ", " + b.LABELS_TXT + ", seen AS (SELECT DISTINCT class_idx FROM detections WHERE conf >= 0.25 AND class_idx % 3 <> 1), want AS (SELECT DISTINCT class_idx FROM labels_txt)"


def seen(spark, d):
    return b.detections(spark, d).where("conf >= 0.25 and class_idx % 3 <> 1")


@query("coverage_report", SEEN + """
SELECT count(*) AS expected, count(s.class_idx) AS detected, count(*) - count(s.class_idx) AS missed, round(100.0 * count(s.class_idx) / count(*), 1)::DOUBLE AS coverage FROM want LEFT JOIN seen s USING (class_idx)""")
def coverage_report(spark, d):
    return ops.coverage_report(b.labels_txt(spark, d), seen(spark, d))


@query("missed_classes", SEEN + " SELECT class_idx, count(*) AS n FROM labels_txt WHERE class_idx NOT IN (SELECT class_idx FROM seen) GROUP BY class_idx")
def missed_classes(spark, d):
    return ops.missed_classes(b.labels_txt(spark, d), seen(spark, d)).groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"))


@query("missed_components", SEEN + ", " + b.CLASSES + COMPONENTS + """, t AS (SELECT kind, part, count(*) AS n FROM want JOIN kinds USING (class_idx) WHERE class_idx NOT IN (SELECT class_idx FROM seen) GROUP BY kind, part)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, part) AS INTEGER) AS rank FROM t) WHERE rank <= 15""")
def missed_components(spark, d):
    from pyspark.sql import Window

    missed = ops.missed_classes(b.labels_txt(spark, d).select("class_idx").distinct(), seen(spark, d)).join(b.classes(spark, d), "class_idx")
    counts = ops.label_components(missed).groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "part"))).where("rank <= 15")


@query("class_cleanup", "WITH " + b.CLASSES + ", " + b.LABELS_TXT + """, k AS (SELECT class_idx, row_number() OVER (ORDER BY class_idx) - 1 AS new_idx FROM classes WHERE NOT (contains(lower(name), 'red') OR contains(lower(name), 'widget') OR contains(lower(name), 'l.e')))
SELECT split, CAST(new_idx AS INTEGER) AS new_idx, count(*) AS lines FROM labels_txt JOIN k USING (class_idx) GROUP BY split, new_idx""")
def class_cleanup(spark, d):
    _, moved = ops.clean_classes(b.classes(spark, d), b.labels_txt(spark, d), ["red", "widget", "l.e"])
    return moved.groupBy("split", "new_idx").agg(F.count(F.lit(1)).alias("lines"))


@query("cleanup_report", "WITH " + b.CLASSES + ", " + b.LABELS_TXT + """, k AS (SELECT class_idx FROM classes WHERE NOT contains(lower(name), 'red') AND NOT contains(lower(name), 'widget')), g AS (SELECT * FROM labels_txt WHERE class_idx NOT IN (SELECT class_idx FROM k))
SELECT (SELECT count(*) FROM classes) AS original, (SELECT count(*) FROM classes) - (SELECT count(*) FROM k) AS removed, (SELECT count(*) FROM k) AS final,
  count(*) AS lines_removed, count(DISTINCT split || '/' || CAST(stem AS VARCHAR)) AS files_touched FROM g""")
def cleanup_report(spark, d):
    return ops.cleanup_report(b.classes(spark, d), b.labels_txt(spark, d), ["Red", "widget"])


@query("class_list_check", """
SELECT 90 AS declared, count(*) AS actual, arg_max(p_name, p_partkey) AS last_name, count(*) FILTER (WHERE p_partkey = 42) > 0 AS has_probe, count(*) FILTER (WHERE NOT regexp_matches(p_name, '^[0-9]+$')) AS not_numbers FROM part""")
def class_list_check(spark, d):
    return ops.class_list_check(b.table(spark, d, "part").select(F.col("p_partkey").alias("class_idx"), F.col("p_name").alias("name")), 90, 42)


@query("class_from_labels", "WITH " + b.IMAGES + ", " + b.LABELS_TXT + """, f AS (SELECT split, stem, arg_min(class_idx, line_no * 10000000 + class_idx) AS class_idx FROM labels_txt GROUP BY split, stem)
SELECT class_idx, arg_max(regexp_extract(file, '^(.*)_[A-Za-z0-9]{8}\\.', 1), file) AS name, count(*) AS files FROM f JOIN images i ON f.split = i.split AND f.stem = i.stem GROUP BY class_idx""")
def class_from_labels(spark, d):
    return ops.class_from_labels(b.labels_txt(spark, d), b.images(spark, d))


MISSED = ", m AS (SELECT DISTINCT 'guh_a_t' || CAST(c_nationkey AS VARCHAR) AS name FROM customer WHERE c_nationkey % 2 = 0)"


def missed_names(spark, d):
    """Class names that customers stand for, some of which no image has."""
    return b.table(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.concat(F.lit("guh_a_t"), F.col("c_nationkey").cast("string")).alias("name"))


@query("reuse_examples", "WITH " + b.IMAGES + MISSED + """
SELECT name, min(file) AS file, count(*) AS files FROM m JOIN images ON regexp_extract(file, '^(.*)_[A-Za-z0-9]{8}\\.', 1) = name GROUP BY name""")
def reuse_examples(spark, d):
    return ops.reuse_examples(missed_names(spark, d), b.images(spark, d))


@query("reuse_examples_inside", "WITH " + b.IMAGES + MISSED + " SELECT name, min(file) AS file, count(*) AS files FROM m JOIN images ON contains(file, name) GROUP BY name")
def reuse_examples_inside(spark, d):
    return ops.reuse_examples(missed_names(spark, d), b.images(spark, d), inside=True)


@query("split_counts", "WITH " + b.IMAGES + " SELECT split, count(*) AS n FROM images GROUP BY split")
def split_counts(spark, d):
    return b.images(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("error_rate", """
SELECT user_id AS batch, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate, count(*) AS n FROM events GROUP BY user_id HAVING avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05""")
def error_rate(spark, d):
    rate = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return b.table(spark, d, "events").groupBy(F.col("user_id").alias("batch")).agg(rounded(rate, 6).alias("rate"), F.count(F.lit(1)).alias("n")).where("rate > 0.05")


@query("row_bucket_order", DET + """, r AS (SELECT image, event_id, y1 // 60 AS line, x1 FROM detections)
SELECT image, event_id, CAST(line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY image ORDER BY line, x1, event_id) AS INTEGER) AS place FROM r""")
def row_bucket_order(spark, d):
    return ops.row_bucket_order(b.detections(spark, d)).select("image", "event_id", "line", "place")


@query("x_order", DET + " SELECT image, event_id, CAST(row_number() OVER (PARTITION BY image ORDER BY x1, event_id) AS INTEGER) AS place FROM detections")
def x_order(spark, d):
    return ops.x_order(b.detections(spark, d)).select("image", "event_id", "place")


@query("reading_order")
def reading_order(spark, d):
    return ops.reading_order(b.detections(spark, d))


@query("assemble_text", DET + f""", r AS (SELECT *, y1 // 60 AS line, row_number() OVER (PARTITION BY image ORDER BY y1 // 60, x1, event_id) AS place FROM detections),
l AS (SELECT image, line, string_agg(translate(substr(event_type, 1, 2), '{b.LATIN}', '{b.NATIVE}'), '' ORDER BY place) AS t FROM r GROUP BY image, line)
SELECT image, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY image""")
def assemble_text(spark, d):
    ordered = ops.row_bucket_order(b.detections(spark, d)).withColumn("symbol", F.translate(F.substring("event_type", 1, 2), b.LATIN, b.NATIVE))
    return ops.assemble_text(ordered)


IOU = """greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"""


@query("iou_pairs", DET + f""", i AS (SELECT p.image, p.event_id AS a, q.event_id AS b, {IOU} AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS area
  FROM detections p JOIN detections q ON p.image = q.image AND p.event_id < q.event_id)
SELECT image, a, b, round(inter / (area - inter + 1e-6), 6)::DOUBLE AS iou FROM i WHERE round(inter / (area - inter + 1e-6), 6) >= 0.4""")
def iou_pairs(spark, d):
    return ops.iou_pairs(b.detections(spark, d))


@query("nms")
def nms(spark, d):
    return ops.nms(b.detections(spark, d))


SIZES = "sizes AS (SELECT o_orderkey AS image, CAST(700 + o_orderkey % 900 AS INTEGER) AS width, CAST(500 + o_orderkey % 700 AS INTEGER) AS height FROM orders)"


def sizes(spark, d):
    k = F.col("o_orderkey")
    return b.table(spark, d, "orders").select(k.alias("image"), (700 + k % 900).cast("int").alias("width"), (500 + k % 700).cast("int").alias("height"))


@query("tile_grid", f"WITH {SIZES}" + """, x AS (SELECT *, unnest(range(0, width, 560)) AS tile_x FROM sizes), y AS (SELECT *, unnest(range(0, height, 560)) AS tile_y FROM x)
SELECT image, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, CAST(least(tile_x + 640, width) AS INTEGER) AS x2, CAST(least(tile_y + 640, height) AS INTEGER) AS y2 FROM y""")
def tile_grid(spark, d):
    return ops.tile_grid(sizes(spark, d))


@query("tile_to_page", DET + """
SELECT event_id, x1 + CAST(image % 4 * 560 AS INTEGER) AS x1, y1 + CAST(image % 3 * 560 AS INTEGER) AS y1, x2 + CAST(image % 4 * 560 AS INTEGER) AS x2, y2 + CAST(image % 3 * 560 AS INTEGER) AS y2 FROM detections""")
def tile_to_page(spark, d):
    det = b.detections(spark, d).withColumn("tile_id", F.col("image"))
    t = F.col("tile_id")
    tiles = det.select("tile_id").distinct().select("tile_id", (t % 4 * 560).cast("int").alias("tile_x"), (t % 3 * 560).cast("int").alias("tile_y"))
    return ops.tile_to_page(det, tiles).select("event_id", "x1", "y1", "x2", "y2")


@query("stratified_split", """
WITH r AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY md5('s' || CAST(event_id AS VARCHAR)), event_id) AS i FROM events)
SELECT event_id, event_type, CASE WHEN i <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN i <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15)) THEN 'valid' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, d):
    return ops.stratified_split(b.table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("bernoulli_split", "SELECT event_id, CASE WHEN md5(CAST(event_id AS VARCHAR)) < 'cccccccc' THEN 'train' ELSE 'valid' END AS part FROM events")
def bernoulli_split(spark, d):
    """Each row's part by its own hash: four fifths of the hash space train."""
    return b.table(spark, d, "events").select("event_id", F.when(F.md5(F.col("event_id").cast("string")) < "cccccccc", "train").otherwise("valid").alias("part"))


GAPS = "WITH " + b.CLASS_METRICS + ", " + b.CLASSES + """, g AS (SELECT class_idx, n FROM class_metrics WHERE map50 < 0.8),
p AS (SELECT class_idx, name, 'train' AS split, k FROM g JOIN classes USING (class_idx), range(0, 300) t(k) UNION ALL SELECT class_idx, name, 'valid', k FROM g JOIN classes USING (class_idx), range(0, 30) t(k))"""


def gaps(spark, d):
    return b.class_metrics(spark, d).where("map50 < 0.8").select("class_idx")


@query("oversample_plan", GAPS + " SELECT class_idx, split, CAST(k AS INTEGER) AS k, 'boost_' || name || '_' || lpad(CAST(k AS VARCHAR), 4, '0') AS sample FROM p")
def oversample_plan(spark, d):
    plan, _ = ops.oversample_plan(gaps(spark, d), b.classes(spark, d), "boost", 300, 30)
    return plan


@query("oversample_totals", GAPS + " SELECT split, count(DISTINCT class_idx) AS classes, count(*) AS samples FROM p GROUP BY split")
def oversample_totals(spark, d):
    plan, _ = ops.oversample_plan(gaps(spark, d), b.classes(spark, d), "boost", 300, 30)
    return ops.oversample_totals(plan)


@query("oversample_skipped", GAPS + " SELECT class_idx FROM g WHERE class_idx NOT IN (SELECT class_idx FROM classes)")
def oversample_skipped(spark, d):
    _, skipped = ops.oversample_plan(gaps(spark, d), b.classes(spark, d), "boost", 300, 30)
    return skipped


@query("bootstrap_dict", "SELECT p_partkey AS class_idx, p_name AS syllable, 'no translation yet' AS english, false AS verified FROM part")
def bootstrap_dict(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("class_idx"), F.col("p_name").alias("syllable"), F.lit("no translation yet").alias("english"), F.lit(False).alias("verified"))




@query("grid_label", """
WITH i AS (SELECT event_id, CAST(event_id % 9000 AS INTEGER) AS class_id FROM events)
SELECT event_id, class_id, 'c' || CAST(class_id // 360 AS VARCHAR) || '_m' || CAST(class_id // 60 % 6 AS VARCHAR) || '_v' || CAST(class_id // 6 % 10 AS VARCHAR) || '_t' || CAST(class_id % 6 AS VARCHAR) AS label FROM i""")
def grid_label(spark, d):
    """The label of each event's class number, by arithmetic on the grid's ordinals."""
    rows = b.table(spark, d, "events").select("event_id", (F.col("event_id") % 9000).cast("int").alias("class_id"))
    return rows.withColumn("label", generate.grid_label(F.col("class_id"), [("c", 25), ("m", 6), ("v", 10), ("t", 6)]))


#: The published syllables: 25 bases of which two take no medial, five medials, ten vowels, six tones, two contractions (fixed values).
BASES = "guh hkuh ghuh hcah nguh suh_chuh hsuh_shuh shuh2 nyuh tuh htuh duh nuh pbuh hpuh buh muh yuh ruh luh wuh thuh huh uh uh2".split()
MEDIALS = "med_ya med_ra med_wa med_la med_gha".split()
VOWELS = "a ah ee er ay aw oh eh oo u".split()
TONES = "tone1_rise tone2_er_thee tone3_ah_thee tone4_pler_chee tone5_hah_thee tone6_geh_poh".split()
CONTRACTIONS = "muh_asat_maw duh_asat_dee".split()


def listed(name, xs):
    return f"{name}(i, x) AS (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(xs))})"


def grid_sql(takes, n_vowels, n_tones, contractions):
    n_base, n_medial = 1500, takes * 5 * n_vowels * n_tones
    more = f" UNION ALL SELECT {n_base + n_medial} + c.i, c.x FROM c" if contractions else ""
    return f"""WITH {listed('o', BASES)}, {listed('m', MEDIALS)}, {listed('v', VOWELS)}, {listed('t', TONES)}, {listed('c', CONTRACTIONS)},
grid AS (SELECT o.i * 60 + v.i * 6 + t.i AS class_id, o.x || '_' || v.x || '_' || t.x AS label FROM o, v, t
  UNION ALL SELECT {n_base} + ((o.i * 5 + m.i) * {n_vowels} + v.i) * {n_tones} + t.i, o.x || '_' || m.x || '_' || v.x || '_' || t.x FROM o, m, v, t WHERE o.i < {takes} AND v.i < {n_vowels} AND t.i < {n_tones}{more})
SELECT event_id, grid.class_id, label FROM events JOIN grid ON grid.class_id = event_id % {n_base + n_medial + 2}"""


@query("syllables", grid_sql(23, 5, 3, True))
def syllables(spark, d):
    """Each event's syllable in the published set of 3,227."""
    grid = generate.syllable_grid(spark, BASES, MEDIALS, VOWELS, TONES, plain=["uh", "uh2"], contractions=CONTRACTIONS, medial_vowels=5, medial_tones=3)
    rows = b.table(spark, d, "events").select("event_id", (F.col("event_id") % 3227).alias("class_id"))
    return rows.join(F.broadcast(grid), "class_id").select("event_id", "class_id", "label")  # a row for each syllable


@query("syllable_grid_9002", grid_sql(25, 10, 6, True))
def syllable_grid_9002(spark, d):
    """Each event's syllable in the larger published set, in which all bases take medials with all vowels and tones."""
    grid = generate.syllable_grid(spark, BASES, MEDIALS, VOWELS, TONES, contractions=CONTRACTIONS)
    rows = b.table(spark, d, "events").select("event_id", (F.col("event_id") % 9002).alias("class_id"))
    return rows.join(F.broadcast(grid), "class_id").select("event_id", "class_id", "label")  # a row for each syllable


@query("sample_paragraphs")
def sample_paragraphs(spark, d):
    words = b.vocabulary(spark, d).select("native").distinct()
    return generate.sample_paragraphs(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), words, seed=7)


# --- files written from the tables and read again


@query("scan_entries", "WITH " + b.ENTRIES + " SELECT karen, array_to_string(definitions, '|') AS definitions, page, flag, source, entry_type, array_length(definitions) % 2 = 0 AS promoted, CASE WHEN page % 3 = 0 THEN '{\"examples\":[\"x\"]}' END AS analysis FROM entries")
def scan_entries(spark, d):
    path = files.scratch(spark, "entries")
    analysis = F.when(F.col("page") % 3 == 0, '{"examples":["x"]}')
    files.write_entries(b.entries(spark, d).withColumn("promoted", F.size("definitions") % 2 == 0).withColumn("analysis", analysis), path)
    back = files.read_entries(spark, path, whole=False)
    return back.select("karen", F.array_join("definitions", "|").alias("definitions"), "page", "flag", "source", "entry_type", "promoted", "analysis")


@query("scan_labels", "WITH " + b.LABELS_TXT + " SELECT split, CAST(stem AS VARCHAR) AS stem, class_idx, 0.5::DOUBLE AS cx, 0.25::DOUBLE AS cy, 0.1::DOUBLE AS w, 0.2::DOUBLE AS h FROM labels_txt")
def scan_labels(spark, d):
    path = files.scratch(spark, "labels")
    boxes = b.labels_txt(spark, d).select("split", "stem", "class_idx", *(F.lit(x).alias(c) for c, x in (("cx", 0.5), ("cy", 0.25), ("w", 0.1), ("h", 0.2))))
    files.write_labels(boxes, path)
    return files.read_labels(spark, path)


@query("class_index_map", """
WITH p AS (SELECT DISTINCT p_partkey % 50 AS dataset, replace(p_name, ' ', '_') AS name FROM part)
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY name) - 1 AS INTEGER) AS class_idx, name FROM p""")
def class_index_map(spark, d):
    """Dataset files of class lists, written from parts and read again; a class's number is its place in its file."""
    path = files.scratch(spark, "classes")
    p = b.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("dataset"), F.concat(F.lit("  - "), F.translate("p_name", " ", "_")).alias("name"))
    listed = p.groupBy("dataset").agg(F.array_join(F.sort_array(F.collect_set("name")), "\n").alias("value"))
    listed.repartition("dataset").select("dataset", F.concat(F.lit("names:\n"), "value").alias("value")).write.partitionBy("dataset").text(path)
    return files.read_classes(spark, path).select(F.regexp_extract("file", "dataset=([0-9]+)", 1).cast("long").alias("dataset"), "class_idx", "name")


@query("scan_detections", DET + """
SELECT CAST(image AS VARCHAR) AS image, class_idx AS cls_idx, event_type AS syllable, '?' AS english, round(conf, 4) AS confidence, round((x1 + least(x2, 640)) / 2 / 640, 4) AS x_center, round((y1 + least(y2, 480)) / 2 / 480, 4) AS y_center,
  round((least(x2, 640) - x1) / 640, 4) AS width, round((least(y2, 480) - y1) / 480, 4) AS height FROM detections""")
def scan_detections(spark, d):
    path = files.scratch(spark, "detections")
    det = ops.box_convert(b.detections(spark, d)).select(F.col("image").cast("string").alias("image"), F.col("class_idx").alias("cls_idx"), F.col("event_type").alias("syllable"), F.lit("?").alias("english"), F.col("conf").alias("confidence"), F.col("nx").alias("x_center"), F.col("ny").alias("y_center"), F.col("nw").alias("width"), F.col("nh").alias("height"))
    files.write_detections(det, path)
    return files.read_detections(spark, path)


CURVES = "WITH g AS (SELECT user_id AS run, day(ts) AS epoch, max(value) / 100 AS v FROM events GROUP BY 1, 2), c AS (SELECT run, CAST(epoch AS INTEGER) AS epoch, CASE WHEN epoch % 9 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(v, 5) END AS map50, round(v, 5) AS loss FROM g)"


def curves(spark, d):
    """A run for each user, an epoch for each day, the metric infinite at times; through a CSV file."""
    path = files.scratch(spark, "curves")
    e = b.table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("epoch")).agg(rounded(F.max("value") / 100, 5).alias("v"))
    e.select(F.col("user_id").alias("run"), "epoch", F.when(F.col("epoch") % 9 == 0, "inf").otherwise(F.col("v").cast("string")).alias("map50"), F.col("v").alias("loss")).write.option("header", True).csv(path)
    return files.read_curve(spark, path, "run long, epoch int, map50 double, loss double")


@query("curve_scan", CURVES + " SELECT run, epoch, map50, loss FROM c")
def curve_scan(spark, d):
    return curves(spark, d)


BEST = CURVES + ", f AS (SELECT * FROM c WHERE NOT isinf(map50)), s AS (SELECT run, count(DISTINCT epoch) AS epochs, count(DISTINCT epoch) >= 20 AS done, max(map50) AS best FROM f GROUP BY run)"


@query("curve_summary", BEST + ", x AS (SELECT run, epoch, row_number() OVER (PARTITION BY run ORDER BY map50 DESC, epoch) AS n FROM f) SELECT s.run, epochs, done, x.epoch AS best_epoch, best FROM s JOIN x ON s.run = x.run AND x.n = 1")
def curve_summary(spark, d):
    return ops.curve_summary(curves(spark, d), 20)


@query("curve_deltas", BEST + """
SELECT a.run AS before, b.run AS after, a.best AS best_before, b.best AS best_after, round(b.best - a.best, 6) AS change, round(100 * (b.best - a.best) / nullif(a.best, 0), 2) AS percent FROM s a JOIN s b ON b.run = a.run + 1""")
def curve_deltas(spark, d):
    s = ops.curve_summary(curves(spark, d), 20)
    return ops.curve_deltas(s, s.select(F.col("run").alias("before"), (F.col("run") + 1).alias("after")))


@query("class_metrics_scan", "WITH " + b.CLASS_METRICS + " SELECT CAST(class_idx % 4 AS VARCHAR) AS model, class_idx, map50 FROM class_metrics")
def class_metrics_scan(spark, d):
    path = files.scratch(spark, "metrics")
    m = ops.detection_counts(b.detections(spark, d), 0.0).join(b.class_metrics(spark, d).select("class_idx", "map50"), "class_idx")
    m.groupBy((F.col("class_idx") % 4).cast("string").alias("model")).agg(F.avg("map50").alias("map50"), F.sort_array(F.collect_list(F.struct("class_idx", "map50"))).alias("per_class")).write.json(path)
    return files.read_class_metrics(spark, path)[1]


@query("seed_plan_rows", """
SELECT c_mktsegment AS plan, CAST(c_nationkey AS VARCHAR) AS band, c_name AS example, CAST(100 AS INTEGER) AS target, round(count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) / 100.0, 4)::DOUBLE AS share FROM customer""")
def seed_plan_rows(spark, d):
    """Plans as files hold them, ten examples a band at most; the next ones come in another plan of the same name."""
    c = b.table(spark, d, "customer")
    part = F.floor(F.col("c_custkey") / 200)
    bands = c.groupBy("c_mktsegment", F.col("c_nationkey").cast("string").alias("name"), part.alias("part")).agg(F.collect_list("c_name").alias("examples"))
    total = c.groupBy("c_mktsegment", F.col("c_nationkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    plans = bands.join(total, ["c_mktsegment", "name"]).groupBy(F.col("c_mktsegment").alias("plan"), "part").agg(F.collect_list(F.struct("name", F.lit(100).alias("target_count"), "examples", "n")).alias("bands"))
    rows = files.seed_plan(plans)
    share = rows.groupBy("plan", "band").agg(F.round(F.count(F.lit(1)) / 100, 4).alias("share"))
    return rows.drop("share").join(share, ["plan", "band"])


@query("image_inventory", "WITH " + b.IMAGES + " SELECT split, regexp_replace(file, '\\.[^.]*$', '') AS stem, 'jpg' AS ext FROM images WHERE stem % 5 <> 0")
def image_inventory(spark, d):
    """The images in a listing of files, which also holds label files."""
    rows = b.images(spark, d)
    name = F.when(F.col("stem") % 5 == 0, F.regexp_replace("file", "jpg$", "txt")).otherwise(F.col("file"))
    return files.image_inventory(rows.select(F.concat_ws("/", F.lit("/data"), "split", F.lit("images"), name).alias("path")))


RESOLVE = """CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || x WHEN x LIKE '/%' THEN host || x ELSE regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)[^/]*$', 1) || x END"""


@query("page_sample", f"""
WITH h AS (SELECT page_id, replace(html, '<a href="/', CASE WHEN page_id % 2 = 0 THEN '<img src="' ELSE '<IMG alt="" SRC="/' END) AS html, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\\b[^>]*>.*?</script\\s*>', '', 'gsi'), '<style\\b[^>]*>.*?</style\\s*>', '', 'gsi') AS bare FROM h),
t AS (SELECT *, list_filter(list_transform(string_split_regex(bare, '<[^>]*>'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM c)
SELECT page_id, substr(array_to_string(parts, chr(10)), 1, 2000) AS text,
  array_to_string(list_transform(list_slice(list_filter(regexp_extract_all(html, '(?i)<img\\b[^>]*?\\ssrc="([^"]*)"', 1), lambda x: x <> ''), 1, 20), lambda x: {RESOLVE}), ' ') AS images FROM t""")
def page_sample(spark, d):
    """Pages whose links are images, some with relative addresses."""
    p = b.table(spark, d, "pages")
    html = F.replace("html", F.lit('<a href="/'), F.when(F.col("page_id") % 2 == 0, '<img src="').otherwise('<IMG alt="" SRC="/'))
    return files.page_sample(p.withColumn("html", html)).withColumn("images", F.array_join("images", " "))
