"""Detections, labels and classes: joins to names, coverage and gaps, reading order, overlap, splits and sampling plans."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.functions.numbers import rounded
from lexicarta.operators.containment import holding
from lexicarta.operators.ranking import with_places
from lexicarta.sources.files import written


def box_convert(df: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """Corner boxes also as clamped corners, pixel centres and normalised centres with four decimals."""
    x1, y1 = F.greatest("x1", F.lit(0)), F.greatest("y1", F.lit(0))
    x2, y2 = F.least("x2", F.lit(width)), F.least("y2", F.lit(height))
    return df.select(
        "*",
        ((x1 + x2) / 2).alias("cx"),
        ((y1 + y2) / 2).alias("cy"),
        rounded((x1 + x2) / 2 / width, 4).alias("nx"),
        rounded((y1 + y2) / 2 / height, 4).alias("ny"),
        rounded((x2 - x1) / width, 4).alias("nw"),
        rounded((y2 - y1) / height, 4).alias("nh"),
    )


def valid_boxes(df: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """Boxes of two pixels or more that lie inside the frame."""
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height)
    return df.where(inside & (F.col("x2") - F.col("x1") >= 2) & (F.col("y2") - F.col("y1") >= 2))


def class_from_filename(name: Column) -> Column:
    """The parts of a file's stem before the first of eight letters or digits; with none, or that one first, the whole stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    at = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike("^[A-Za-z0-9]{8}$"), i)), lambda i: i.isNotNull())
    return F.when(F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(0)) > 0, F.array_join(F.slice(parts, 1, F.try_element_at(at, F.lit(1))), "_")).otherwise(stem)


def label_components(df: DataFrame, column: str = "name") -> DataFrame:
    """(..., kind, part): a class name's base, medials, tone and vowels."""
    rows = df.select("*", F.posexplode(F.split(column, "_")).alias("_at", "part"))
    kind = F.when(F.col("_at") == 0, "base").when(F.col("part").startswith("med"), "medial").when(F.col("part").rlike("^t[0-9]"), "tone").otherwise("vowel")
    return rows.withColumn("kind", kind).drop("_at")


def translate_detections(det: DataFrame, index_map: DataFrame, syllables: DataFrame, dictionary: DataFrame, least: float = 0.25) -> DataFrame:
    """Detections with what their class stands for, or the reason why nothing is known of it.

    index_map (class_idx, robo), syllables (class_id, native), dictionary (native, gloss); of a dictionary's repeated keys the
    last by place counts. The three tables have a row for each class, so Spark broadcasts them by size.
    """
    last = dictionary.groupBy("native").agg(F.max_by("gloss", "pos").alias("gloss"))
    d = det.where(F.col("conf") >= least).join(index_map, "class_idx", "left").withColumn("class_id", F.expr("try_cast(robo as int)"))
    d = d.join(syllables, "class_id", "left").join(last, "native", "left")
    reason = F.when(F.col("robo").isNull(), "not in map").when(F.col("class_id").isNull(), "not a number").when(F.col("native").isNull(), "no syllable").when(F.col("gloss").isNull(), "no translation").otherwise("ok")
    return d.select(*det.columns, F.coalesce("native", F.lit("?")).alias("native"), F.coalesce("gloss", F.lit("unknown")).alias("gloss"), reason.alias("status"))


def label_detections(det: DataFrame, classes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Detections with class name and gloss, or the defaults for what is missing."""
    named = det.join(classes, "class_idx", "left").withColumn("syllable", F.coalesce("name", F.concat(F.lit("unknown_"), F.col("class_idx").cast("string"))))
    return named.join(dictionary.select(F.col("name").alias("syllable"), "english"), "syllable", "left").select(*det.columns, "syllable", F.coalesce("english", F.lit("no translation yet")).alias("english"))


def label_integrity(images: DataFrame, labels: DataFrame, samples: int = 5) -> DataFrame:
    """Of each split, how many images have no label, labels no image, and the first stems of both."""
    both = images.select("split", "stem", F.lit(True).alias("image")).distinct().join(labels.select("split", "stem", F.lit(True).alias("label")).distinct(), ["split", "stem"], "full_outer")
    state = both.select("split", "stem", F.when(F.col("label").isNull(), "no label").when(F.col("image").isNull(), "no image").otherwise("ok").alias("state"))
    counts = state.groupBy("split", "state").agg(F.count(F.lit(1)).alias("rows"))
    # only the first few stems of each task reach the window
    rank = F.row_number().over(Window.partitionBy("split", "state").orderBy("stem"))
    first = state.where("state <> 'ok'").withColumn("n", rank).where(F.col("n") <= samples)
    listed = first.groupBy("split", "state").agg(F.array_join(F.sort_array(F.collect_list("stem")), ",").alias("first"))
    return counts.join(listed, ["split", "state"], "left").select("split", "state", "rows", F.coalesce("first", F.lit("")).alias("first"))


def detection_counts(det: DataFrame, least: float = 0.25) -> DataFrame:
    """(class_idx, n, n_images) over detections confident enough."""
    return det.where(F.col("conf") >= least).groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image").alias("n_images"))


def image_hits(det: DataFrame, images: DataFrame, least: float = 0.25) -> DataFrame:
    """One row: images, those with a detection confident enough, and those without any."""
    hit = det.where(F.col("conf") >= least).select("image", F.lit(1).alias("hit")).distinct()
    return images.select("image").distinct().join(hit, "image", "left").agg(
        F.count(F.lit(1)).alias("images"), F.count("hit").alias("with_hits"), (F.count(F.lit(1)) - F.count("hit")).alias("without_hits")
    )


def coverage_report(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Expected, detected and missed classes, and the part detected in percent."""
    e, d = expected.select("class_idx").distinct(), detected.select("class_idx", F.lit(1).alias("hit")).distinct()
    return e.join(d, "class_idx", "left").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("hit").alias("detected"),
        (F.count(F.lit(1)) - F.count("hit")).alias("missed"),
        rounded(100 * F.count("hit") / F.count(F.lit(1)), 1).alias("coverage"),
    )


def missed_classes(expected: DataFrame, detected: DataFrame) -> DataFrame:
    return expected.join(detected.select("class_idx").distinct(), "class_idx", "left_anti")


def metric_status(metric: Column, miss: float = 0.5, weak: float = 0.8) -> Column:
    return F.when(metric < miss, "missed").when(metric < weak, "weak").otherwise("ok")


def gap_report(metrics: DataFrame, classes: DataFrame, miss: float = 0.5, weak: float = 0.8) -> DataFrame:
    """(status, n, mean, names): classes by status, names by metric then number."""
    rows = metrics.join(classes, "class_idx", "left").withColumn("status", metric_status(F.col("map50"), miss, weak))
    listed = F.sort_array(F.collect_list(F.struct("map50", "class_idx", F.coalesce("name", F.lit("?")).alias("name"))))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("map50"), 6).alias("mean"), F.array_join(listed["name"], ",").alias("names"))


def true_gaps(metrics: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Metrics with the number of labels in the validation split: without any the metric says nothing."""
    counts = labels.where("split = 'valid'").groupBy("class_idx").agg(F.count(F.lit(1)).alias("instances"))
    rows = metrics.join(counts, "class_idx", "left").join(classes, "class_idx", "left")
    n = F.coalesce("instances", F.lit(0))
    return rows.select("class_idx", F.coalesce("name", F.lit("?")).alias("name"), "map50", n.alias("instances"), F.when(n == 0, "no_val").otherwise(metric_status(F.col("map50"))).alias("status"))


def holds_any(name: Column, keywords: list[str]) -> Column:
    """Whether a name holds one of the keywords, in any case."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower(name), F.lit(k.lower()))
    return found


def clean_classes(classes: DataFrame, labels: DataFrame, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classes without those whose name holds a keyword, renumbered, and the labels that stay, with the new numbers."""
    kept = with_places(classes.where(~holds_any(F.col("name"), keywords)), ["class_idx"], name="new_idx").withColumn("new_idx", F.col("new_idx").cast("int"))
    moved = labels.join(kept.select("class_idx", "new_idx"), "class_idx")
    return kept, moved


def cleanup_report(classes: DataFrame, labels: DataFrame, keywords: list[str]) -> DataFrame:
    """One row: classes before, removed and after, label lines removed, and label files that lose a line.

    Lines of a class that isn't listed go as well.
    """
    kept = classes.where(~holds_any(F.col("name"), keywords)).select("class_idx")
    gone = labels.join(kept, "class_idx", "left_anti").agg(F.count(F.lit(1)).alias("lines_removed"), F.countDistinct("split", "stem").alias("files_touched"))
    bad = F.count_if(holds_any(F.col("name"), keywords))
    totals = classes.agg(F.count(F.lit(1)).alias("original"), bad.alias("removed"), (F.count(F.lit(1)) - bad).alias("final"))
    return totals.crossJoin(gone)  # one row each


def class_list_check(classes: DataFrame, declared: int, probe: int) -> DataFrame:
    """Declared and actual numbers of classes, the last name, whether a number is there, names that aren't numbers."""
    return classes.agg(
        F.lit(declared).alias("declared"),
        F.count(F.lit(1)).alias("actual"),
        F.max_by("name", "class_idx").alias("last_name"),
        (F.count_if(F.col("class_idx") == probe) > 0).alias("has_probe"),
        F.count_if(~F.col("name").rlike("^[0-9]+$")).alias("not_numbers"),
    )


def class_from_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(class_idx, name, files): the class of each label file's first line, named after its image; the last file wins."""
    first = labels.groupBy("split", "stem").agg(F.min(F.struct("line_no", "class_idx"))["class_idx"].alias("class_idx"))
    named = first.join(images.select("split", "stem", "file", class_from_filename(F.col("file")).alias("name")), ["split", "stem"])
    return named.groupBy("class_idx").agg(F.max_by("name", "file").alias("name"), F.count(F.lit(1)).alias("files"))


def reuse_examples(missed: DataFrame, images: DataFrame, inside: bool = False) -> DataFrame:
    """(name, file, files): for each missed class the first file of its class, by exact class name; inside: whose name holds the class name.

    Names inside of file names meet them in a trie of the missed names.
    """
    names = missed.select("name").distinct()
    if inside:
        met = holding(images.select("file"), "file", names, "name")
    else:
        met = names.join(images.select("file", class_from_filename(F.col("file")).alias("name")), "name")
    return met.groupBy("name").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("files"))


def x_order(det: DataFrame) -> DataFrame:
    """Detections with their place in their image from left to right alone."""
    return det.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy("x1", "event_id")))


def row_bucket_order(det: DataFrame, height: int = 60) -> DataFrame:
    """Detections with their line (of a fixed height) and place in reading order."""
    rows = det.withColumn("line", F.floor(F.col("y1") / height).cast("int"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy("line", "x1", "event_id")))


#: Boxes of an image that a task works through at once, if it can be cut, and the side of the tiles in whose order boxes of larger images are dealt.
BOXES, TILE = 20_000, 512


def by_size(det: DataFrame, boxes: int) -> tuple[DataFrame, DataFrame | None]:
    """Detections of images of up to so many boxes, and those of larger ones, None if there are none."""
    large = written(det.groupBy("image").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > boxes).select("image"), "large")
    if large.isEmpty():
        return det, None
    large = F.broadcast(large)  # at most a row for each `boxes` rows of det
    return det.join(large, "image", "left_anti"), det.join(large, "image", "left_semi")


def in_bands(rows: DataFrame, free: Column, *order: str, boxes: int = BOXES) -> DataFrame:
    """Rows with the number of their band of an image: one starts, after boxes rows at least, where the condition on the rows before holds.

    A stream over each image in order.
    """
    stream = Window.partitionBy("image").orderBy(*order)
    start = F.when(free, F.floor((F.row_number().over(stream) - 1) / boxes)).cast("long")
    return rows.withColumn("band", F.coalesce(F.max(start).over(stream), F.lit(0).cast("long")))


def reading_order(det: DataFrame, tolerance: float = 0.4, boxes_at_once: int = BOXES) -> DataFrame:
    """(image, event_id, line, place): lines grow from the top, a box joining the first whose mean height on the page is near.

    Near is tolerance of the image's mean box height. The mean moves with each box, so boxes are worked through in order; but
    none joins a line across a gap of more than that, so a larger image is cut at such gaps.
    """
    import pandas as pd

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        near = rows["near"].iloc[0]
        rows = rows.sort_values(["cy", "event_id"])
        sums: list[float] = []
        sizes: list[int] = []
        line = []
        for y in rows["cy"]:
            at = next((k for k, s in enumerate(sums) if abs(y - s / sizes[k]) <= near), len(sums))
            if at == len(sums):
                sums.append(0.0)
                sizes.append(0)
            sums[at] += y
            sizes[at] += 1
            line.append(at)
        rows = rows.assign(line=line).sort_values(["line", "cx", "event_id"])
        return rows.assign(place=range(1, len(rows) + 1))[["image", "band", "event_id", "line", "place"]]

    boxes = det.select("image", "event_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("y2") - F.col("y1")).alias("height"))
    small, large = by_size(boxes, boxes_at_once)
    with_near = lambda rows: rows.join(rows.groupBy("image").agg((tolerance * F.avg("height")).alias("near")), "image")
    walked = lambda rows: rows.groupBy("image", "band").applyInPandas(order, "image long, band long, event_id long, line int, place int")
    out = walked(with_near(small).withColumn("band", F.lit(0).cast("long"))).drop("band")
    if large is None:
        return out
    before = F.lag("cy").over(Window.partitionBy("image").orderBy("cy", "event_id"))
    banded = in_bands(with_near(large).withColumn("gap", F.coalesce(F.col("cy") - before > F.col("near"), F.lit(False))), F.col("gap"), "cy", "event_id", boxes=boxes_at_once).drop("gap")
    local = written(walked(banded), "bands")  # read twice
    sizes = local.groupBy("image", "band").agg((F.max("line") + 1).alias("lines"), F.count(F.lit(1)).alias("boxes"))
    above = Window.partitionBy("image").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("image", "band", F.coalesce(F.sum("lines").over(above), F.lit(0)).alias("lines"), F.coalesce(F.sum("boxes").over(above), F.lit(0)).alias("boxes"))
    moved = local.join(offsets, ["image", "band"]).select("image", "event_id", (F.col("line") + F.col("lines")).cast("int").alias("line"), (F.col("place") + F.col("boxes")).cast("int").alias("place"))
    return out.unionByName(moved)


def assemble_text(ordered: DataFrame) -> DataFrame:
    """(image, text): symbols in reading order, a line on each line."""
    lines = ordered.groupBy("image", "line").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "symbol")))["symbol"], "").alias("t"))
    return lines.groupBy("image").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line", "t")))["t"], "\n").alias("text"))


def overlap(a: str, c: str) -> Column:
    """Intersection over union of two boxes (structs of corners), never dividing by zero."""
    x = F.greatest(F.lit(0), F.least(f"{a}.x2", f"{c}.x2") - F.greatest(f"{a}.x1", f"{c}.x1"))
    y = F.greatest(F.lit(0), F.least(f"{a}.y2", f"{c}.y2") - F.greatest(f"{a}.y1", f"{c}.y1"))
    area = lambda s: (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))
    return x * y / (area(a) + area(c) - x * y + F.lit(1e-6))


def iou_pairs(det: DataFrame, least: float = 0.4, cell: int = 64, exact: bool = False) -> DataFrame:
    """(image, a, b, iou): boxes of an image that overlap by least or more; boxes meet in the cells of a grid that they touch.

    The overlap has six decimals, and so it is compared; exact compares it as it is.
    """
    box = F.struct("event_id", "x1", "y1", "x2", "y2")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = det.select("image", box.alias("box"), F.explode(span("x1", "x2")).alias("gx"), "y1", "y2").select("image", "box", "gx", F.explode(span("y1", "y2")).alias("gy"))
    a, c = cells.withColumnRenamed("box", "a"), cells.withColumnRenamed("box", "b")
    pairs = a.join(c, ["image", "gx", "gy"]).where("a.event_id < b.event_id").select("image", "a", "b").distinct()
    return pairs.select("image", F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), (overlap("a", "b") if exact else rounded(overlap("a", "b"), 6)).alias("iou")).where(F.col("iou") >= least)


def nms(det: DataFrame, iou: float = 0.4, boxes_at_once: int = BOXES) -> DataFrame:
    """(image, event_id, conf): detections that stay when those overlapping a more confident one that stays, by iou or more, go.

    Of equally confident ones the smaller event_id is the stronger. Images of up to boxes_at_once boxes are worked through by one task each, larger ones in rounds.
    """
    import numpy as np
    import pandas as pd

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conf", "event_id"], ascending=[False, True])
        box = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        left, stay = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if left[i]:
                stay.append(i)
                w = np.clip(np.minimum(box[i, 2], box[:, 2]) - np.maximum(box[i, 0], box[:, 0]), 0, None)
                h = np.clip(np.minimum(box[i, 3], box[:, 3]) - np.maximum(box[i, 1], box[:, 1]), 0, None)
                left &= w * h / (area[i] + area - w * h + 1e-6) < iou
        return rows.iloc[stay][["image", "event_id", "conf"]]

    small, large = by_size(det.select("image", "event_id", "conf", "x1", "y1", "x2", "y2"), boxes_at_once)
    out = small.groupBy("image").applyInPandas(keep, "image long, event_id long, conf double")
    return out if large is None else out.unionByName(nms_in_rounds(large, iou, boxes_at_once))


def nms_in_rounds(det: DataFrame, iou: float, boxes_at_once: int) -> DataFrame:
    """nms() of images of any size: boxes are decided in rounds over the pairs that overlap.

    A box goes once a stronger neighbour stays, and stays once all stronger neighbours are gone. A round decides in each band of an image (so many
    boxes, tile by tile) all that the band and earlier rounds determine, so rounds are as many as the bands that a chain of
    decisions crosses. Pairs come from the cells of a grid; each round is a table in the shared folder.
    """
    import pandas as pd

    tile = [F.floor(F.col(c) / TILE) for c in ("y1", "x1")]
    boxes = with_places(det.withColumns({"ty": tile[0], "tx": tile[1]}), ["ty", "tx", "x1", "event_id"], ["image"]).withColumn("band", F.expr(f"place div {boxes_at_once}"))
    boxes = written(boxes.select("image", "band", "event_id", "conf", "x1", "y1", "x2", "y2"), "boxes")
    close = iou_pairs(boxes, iou, exact=True)
    own = lambda s: boxes.select("image", F.col("event_id").alias(s), F.col("conf").alias(f"{s}_conf"), F.col("band").alias(f"{s}_band"))
    pairs = close.join(own("a"), ["image", "a"]).join(own("b"), ["image", "b"])
    a_first = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a") < F.col("b")))
    side = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    pairs = written(pairs.select("image", side("a", "b").alias("strong"), side("b", "a").alias("weak"), side("b_band", "a_band").alias("band")), "pairs")
    left = written(boxes.select("image", "band", "event_id", "conf"), "undecided")
    kept = None

    def decide(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        stronger: dict = {}
        for weak, strong, stays in zip(over.weak, over.strong, over.stays, strict=True):
            stronger.setdefault(weak, []).append((strong, stays))
        rows = rows.sort_values(["conf", "event_id"], ascending=[False, True])
        known: dict = {}
        for i in rows.event_id:
            states = [known.get(s) or ("kept" if stays else None) for s, stays in stronger.get(i, ())]
            known[i] = "gone" if "kept" in states else None if None in states else "kept"
        return rows.assign(state=[known[i] for i in rows.event_id])

    while True:
        waiting = left.select("image", F.col("event_id").alias("strong"), F.lit(False).alias("stays"))
        decided = waiting if kept is None else waiting.unionByName(kept.select("image", F.col("event_id").alias("strong"), F.lit(True).alias("stays")))
        over = pairs.join(decided, ["image", "strong"])  # those of strong ones that are gone count no more
        over = over.join(left.select("image", F.col("event_id").alias("weak")), ["image", "weak"], "left_semi")
        met = left.groupBy("image", "band").cogroup(over.groupBy("image", "band"))
        states = written(met.applyInPandas(decide, "image long, band long, event_id long, conf double, state string"), "states")
        stay = states.where("state = 'kept'").select("image", "event_id", "conf")
        kept = stay if kept is None else kept.unionByName(stay)
        left = states.where("state is null").drop("state")
        if left.isEmpty():
            return kept


def tile_grid(images: DataFrame, size: int = 640, overlap_px: int = 80) -> DataFrame:
    """(image, tile_x, tile_y, x2, y2) of images (image, width, height): overlapping tiles, cut at the image's edge."""
    step = size - overlap_px
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(step))
    rows = images.select("image", "width", "height", F.explode(starts("width")).alias("tile_x")).select("*", F.explode(starts("height")).alias("tile_y"))
    return rows.select("image", "tile_x", "tile_y", F.least(F.col("tile_x") + size, "width").alias("x2"), F.least(F.col("tile_y") + size, "height").alias("y2"))


def tile_to_page(det: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes of tiles (tile_id) moved to the page's coordinates."""
    d = det.join(tiles.select("tile_id", "tile_x", "tile_y"), "tile_id")
    moved = {c: F.col(c) + F.col(f"tile_{c[0]}") for c in ("x1", "y1", "x2", "y2")}
    return d.select(*(moved.get(c, F.col(c)).alias(c) for c in det.columns))


def stratified_split(files: DataFrame, key: str, group: str, train: float = 0.7, valid: float = 0.15, seed: str = "s") -> DataFrame:
    """Files with a split: of each group in a fixed random order, a part for training and for validation (one at least), the rest for tests.

    The order is that of a hash. Places are counted within ranges of it, 4,096 a group, so that no task holds a group.
    """
    ranged = files.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_range", F.substring("_hash", 1, 3))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_m"))
    over = Window.partitionBy(group).orderBy("_range")  # 4,096 rows at most
    below = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), (F.sum("_m").over(over) - F.col("_m")).alias("_below"), F.sum("_m").over(Window.partitionBy(group)).alias("_n"))
    placed = ranged.join(below, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    at = F.col("_below") + F.row_number().over(Window.partitionBy(group, "_range").orderBy("_hash", key))
    a, c = F.greatest(F.lit(1), F.floor(F.col("_n") * train)), F.greatest(F.lit(1), F.floor(F.col("_n") * valid))
    placed = placed.select(*files.columns, at.alias("_at"), a.alias("_a"), c.alias("_c"))
    return placed.select(*files.columns, F.when(F.col("_at") <= F.col("_a"), "train").when(F.col("_at") <= F.col("_a") + F.col("_c"), "valid").otherwise("test").alias("part"))


def oversample_plan(gaps: DataFrame, classes: DataFrame, prefix: str, n_train: int, n_valid: int = 0) -> tuple[DataFrame, DataFrame]:
    """Numbered samples of each class with a gap, n_train for training and n_valid for validation, and the gaps whose class isn't known."""
    known = gaps.join(classes, "class_idx")
    parts = F.array(*[F.struct(F.lit(name).alias("split"), F.lit(n).alias("n")) for name, n in (("train", n_train), ("valid", n_valid)) if n > 0])
    rows = known.select("class_idx", "name", F.explode(parts).alias("p")).select("class_idx", "name", "p.split", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("k"))
    name = F.concat(F.lit(prefix), F.lit("_"), "name", F.lit("_"), F.lpad(F.col("k").cast("string"), 4, "0"))
    return rows.select("class_idx", "split", "k", name.alias("sample")), gaps.join(classes, "class_idx", "left_anti")


def oversample_totals(plan: DataFrame) -> DataFrame:
    """(split, classes, samples) of a plan."""
    return plan.groupBy("split").agg(F.countDistinct("class_idx").alias("classes"), F.count(F.lit(1)).alias("samples"))


def curve_summary(curves: DataFrame, done: int = 50) -> DataFrame:
    """Of each run (run, epoch, map50, loss): epochs, whether it is done, its best epoch and metric; infinite values don't count."""
    good = curves.where(~F.isnan("map50") & (F.abs("map50") < float("inf")))
    return good.groupBy("run").agg(F.countDistinct("epoch").alias("epochs"), (F.countDistinct("epoch") >= done).alias("done"), F.max_by("epoch", F.struct("map50", -F.col("epoch"))).alias("best_epoch"), F.max("map50").alias("best"))


def curve_deltas(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(before, after, best_before, best_after, change, percent) of pairs (before, after) of runs; percent is of the former best."""
    of = lambda name: summaries.select(F.col("run").alias(name), F.col("best").alias(f"best_{name}"))
    rows = pairs.select("before", "after").join(of("before"), "before").join(of("after"), "after")
    change = F.col("best_after") - F.col("best_before")
    return rows.select("before", "after", "best_before", "best_after", rounded(change, 6).alias("change"), rounded(100 * change / F.nullif("best_before", F.lit(0.0)), 2).alias("percent"))
