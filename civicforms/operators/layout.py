"""Form fields and their labels from page geometry.

Every operator works within a page (doc_id, page), so joins and folds are dealt by
page and bounded by what a page holds.  Order-dependent steps are folds over an
array sorted by an explicit position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicforms.functions.text import clean_label, is_placeholder, is_placeholder_ocr, is_readable, is_readable_ocr, is_skip_label, match_pattern, to_field_name

PAGE = ["doc_id", "page"]
DEFAULT_PAGE_HEIGHT = 841.89

# Thresholds of the detector, in points, and the width of a label that has none.
LABEL_WIDTH = 50
# How far a label may be from its field, in points (left, above) and in pixels of a page at 200 dots an inch.
LINE_SLACK, LEFT_LEAST, LEFT_MOST, LEFT_FAR, ABOVE_MOST, SIDE_SLACK = 10, -10, 300, 150, 25, 30
LINE_SLACK_PX, LEFT_LEAST_PX, LEFT_MOST_PX, ABOVE_MOST_PX, SIDE_SLACK_PX = 22, -20, 600, 70, 30
LEADER_SIGNS, LEADER_SHARE = 4, 0.5
#: Side of a cell of the grid that boxes meet in, and the most cells a side that a box is put in.
CELL, CELLS = 64, 16
BOX_LEAST, BOX_MOST, BOX_ASPECT = 5, 15, 2
UNDERLINE_HEIGHT, UNDERLINE_WIDTH = 2, 30
DIGIT_LEAST, DIGIT_MOST, DIGITS_IN_ROW, ROW_TOLERANCE = 8, 25, 13, 3


def px_to_pt(x: Column, y: Column, w: Column, h: Column, scale: Column, page_height: Column) -> dict[str, Column]:
    """Pixels from the top left to points from the bottom left."""
    return {"x": x / scale, "y": F.coalesce(page_height, F.lit(DEFAULT_PAGE_HEIGHT)) - y / scale - h / scale, "w": w / scale, "h": h / scale}


def pt_from_top(x: Column, y: Column, w: Column, h: Column, page_height: Column) -> dict[str, Column]:
    """Points from the bottom left to points from the top left: the edge of a box that was its lower one is its upper one."""
    return {"x": x, "y": F.coalesce(page_height, F.lit(DEFAULT_PAGE_HEIGHT)) - y - h, "w": w, "h": h}


def pt_to_px(value: Column, scale: Column) -> Column:
    """Points to whole pixels, halves to even."""
    return F.bround(value * scale, 0).cast("int")


def overlap_area(a: Column, b: Column) -> Column:
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    common = overlap_area(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    smallest = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(smallest > 0, overlap_area(a, b) / smallest).otherwise(0.0)


def combined_confidence(detection: Column, label_confidence: Column) -> Column:
    """Detection and label confidence as one; less without a label (F24, raster variant)."""
    return F.when(label_confidence.isNull(), detection * 0.7).otherwise(0.6 * detection + 0.4 * label_confidence)


def label_confidence(confidence: Column, usable: Column, pattern: Column, skip: Column) -> Column:
    """Confidence of a field raised by a label and a known pattern, lowered without (F24, stream variant)."""
    with_label = F.least(confidence + 0.03, F.lit(1.0))
    with_label = F.when(pattern, F.least(with_label + 0.02, F.lit(1.0))).otherwise(with_label)
    return F.when(usable, F.when(skip, with_label * 0.5).otherwise(with_label)).otherwise(confidence * 0.7)


def leader_confidence(length: Column) -> Column:
    """Confidence of a leader by its length."""
    return F.least(0.55 + length / 80.0, F.lit(0.92))


def underline_confidence(width: Column) -> Column:
    """Confidence of an underline by its width."""
    return F.least(0.7 + (width - 60) / 600.0, F.lit(0.95))


def classify_rect(w: Column, h: Column) -> Column:
    """What a rectangle may be: checkbox, underline or neither."""
    box = w.between(BOX_LEAST, BOX_MOST) & h.between(BOX_LEAST, BOX_MOST) & (F.abs(w - h) <= BOX_ASPECT)
    return F.when(box, "checkbox").when((h <= UNDERLINE_HEIGHT) & (w >= UNDERLINE_WIDTH), "underline")


def detect_leader(text: Column) -> Column:
    """Whether a text is mostly dots or mostly underscores, and at least four."""
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    long = lambda sign: (count(sign) >= LEADER_SIGNS) & (count(sign) / F.length(text) > LEADER_SHARE)
    return F.when(long("."), "dot_sequence").when(long("_"), "underscore_sequence")


def estimated_width(text: Column, size: Column) -> Column:
    """Width of a text by its length and font size."""
    return F.length(text) * size * 0.5


def widget_geometry(w: Column, h: Column, font: Column, kind: Column) -> dict[str, Column]:
    """Least sizes and font of a form widget."""
    check = kind == "checkbox"
    return {
        "w": F.when(check, F.greatest(w, F.lit(8.0))).otherwise(F.greatest(w, F.lit(20.0))),
        "h": F.when(check, F.greatest(h, F.lit(8.0))).otherwise(F.greatest(h, F.lit(12.0))),
        "font": F.least(F.coalesce(font, F.lit(10.0)), F.lit(14.0)),
    }


def leader_fields(elements: DataFrame) -> DataFrame:
    """Fields from texts that are leaders; a text without a width gets one by its length."""
    rows = elements.where("kind = 'text'").withColumn("context", detect_leader(F.col("text"))).where("context IS NOT NULL")
    confidence = F.when(F.col("context") == "dot_sequence", 0.95).otherwise(0.93)
    width = F.when(F.coalesce("w", F.lit(0)) == 0, estimated_width(F.col("text"), F.col("h"))).otherwise(F.col("w")).alias("w")
    return rows.select(*PAGE, "pos", F.lit("text").alias("type"), "x", (F.col("y") - 2).alias("y"), width, (F.col("h") + 4).alias("h"), confidence.alias("confidence"), "context")


def regular_rects(elements: DataFrame) -> DataFrame:
    """Rectangles with sizes above zero: one drawn upwards begins at its other edge."""
    up = F.when(F.col("h") < 0, F.col("y") + F.col("h")).otherwise(F.col("y"))
    return elements.where("kind = 'rect'").withColumns({"w": F.abs("w"), "h": F.abs("h"), "y": up})


def checkbox_fields(elements: DataFrame) -> DataFrame:
    """Fields from small squares."""
    rows = regular_rects(elements).where(classify_rect(F.col("w"), F.col("h")) == "checkbox")
    return rows.select(*PAGE, "pos", F.lit("checkbox").alias("type"), "x", "y", "w", "h", F.lit(0.90).alias("confidence"), F.lit("small_square").alias("context"))


def cluster_rows_by_y(rects: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Add ``band``: the first row anchor within tolerance, anchors taken in ascending y."""
    anchors = rects.groupBy(*PAGE).agg(F.array_sort(F.collect_list("y")).alias("ys"))
    fold = F.aggregate("ys", F.slice("ys", 1, 0), lambda acc, y: F.when(F.exists(acc, lambda a: F.abs(a - y) <= tolerance), acc).otherwise(F.concat(acc, F.array(y))))
    anchors = anchors.select(*PAGE, fold.alias("anchors"))
    return rects.join(anchors, PAGE).withColumn("band", F.element_at(F.filter("anchors", lambda a: F.abs(a - F.col("y")) <= tolerance), 1)).drop("anchors")


def digit_box_rows(elements: DataFrame) -> DataFrame:
    """Rows of at least 13 small boxes as one text field each, with its number of places.

    Boxes are put in rows by the edge they are drawn from, whatever the sign of their height.  Of boxes
    of one place the smaller begins a row and the larger ends it.
    """
    inside = lambda c: (F.abs(c) > DIGIT_LEAST) & (F.abs(c) < DIGIT_MOST)
    rects = elements.where("kind = 'rect'").where(inside("w") & inside("h"))
    place = F.struct("x", "y", "pos", F.abs("w").alias("w"), F.abs("h").alias("h"), F.col("h").alias("drawn"))
    rows = cluster_rows_by_y(rects).groupBy(*PAGE, "band").agg(
        F.count(F.lit(1)).alias("places"), F.min_by(F.struct("x", "y", "h"), place).alias("first"), F.max_by(F.col("x") + F.abs("w"), place).alias("right"), F.min("pos").alias("pos")
    )
    rows = rows.where(F.col("places") >= DIGITS_IN_ROW)
    top = F.when(F.col("first.h") < 0, F.col("first.y") + F.col("first.h")).otherwise(F.col("first.y"))
    return rows.select(*PAGE, "pos", "band", F.col("first.x").alias("x"), top.alias("y"), (F.col("right") - F.col("first.x")).alias("w"), F.abs("first.h").alias("h"), F.col("places").alias("max_length"))


def suppress_checkboxes(checkboxes: DataFrame, rows: DataFrame) -> DataFrame:
    """Checkboxes that are no part of a row of digits."""
    r = rows.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "x", "y", "w")])
    inside = (F.abs(F.col("y") - F.col("r_y")) < 5) & (F.col("x") >= F.col("r_x") - 5) & (F.col("x") <= F.col("r_x") + F.col("r_w") + 5)
    return checkboxes.join(r, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & inside, "left_anti")


def _gather(fields: DataFrame, order: Column) -> DataFrame:
    kept = [c for c in fields.columns if c not in PAGE]
    return fields.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(order.alias("__order"), *kept))).alias("items"))


def _scatter(pages: DataFrame, items: Column) -> DataFrame:
    return pages.select(*PAGE, F.inline(items)).drop("__order")


def underlines_not_covered(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Underlines as fields, unless a field that is there already, or an underline kept before, lies near."""
    there = fields.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("there"))
    thin = regular_rects(elements).where((F.col("h") <= UNDERLINE_HEIGHT) & (F.col("w") >= UNDERLINE_WIDTH))
    pages = _gather(thin.select(*PAGE, "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), F.col("pos")).join(there, PAGE, "left")
    near = lambda a, b: (F.abs(a["y"] - b["y"]) < 15) & (F.abs(a["x"] - b["x"]) < 20)
    covered = lambda acc, u: F.exists(acc, lambda k: near(k, u)) | F.exists(F.coalesce("there", F.array()), lambda k: near(k, u))
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, u: F.when(covered(acc, u), acc).otherwise(F.concat(acc, F.array(u))))
    rows = _scatter(pages, kept)
    return rows.select(*PAGE, "pos", F.lit("text").alias("type"), "x", "y", "w", F.lit(14.0).alias("h"), F.lit(0.85).alias("confidence"), F.lit("underline_rect").alias("context"))


def dedupe_near(fields: DataFrame, distance: float = 10) -> DataFrame:
    """Of fields of one type closer than ``distance``, the more confident, in the place of the first.

    Fields of one ``pos`` follow each other by their other columns.
    """
    near = lambda a, b: (a["type"] == b["type"]) & (F.abs(a["x"] - b["x"]) < distance) & (F.abs(a["y"] - b["y"]) < distance)

    def step(acc: Column, f: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: near(a, f)), True)
        better = F.transform(acc, lambda a, i: F.when((i + 1 == at) & (f["confidence"] > a["confidence"]), f).otherwise(a))
        return F.when(at > 0, better).otherwise(F.concat(acc, F.array(f)))

    return _scatter(_gather(fields, F.col("pos")), F.aggregate("items", F.slice("items", 1, 0), step))


def dedupe_overlap(fields: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Fields by falling confidence, then ``pos``, then their other columns, that overlap none kept before by more than ``ratio``."""
    pages = _gather(fields, F.struct((-F.col("confidence")).alias("c"), F.col("pos").alias("p")))
    step = lambda acc, f: F.when(F.exists(acc, lambda k: overlap_ratio(f, k) > ratio), acc).otherwise(F.concat(acc, F.array(f)))
    return _scatter(pages, F.aggregate("items", F.slice("items", 1, 0), step))


def dedupe_shapes(shapes: DataFrame, distance: float = 4) -> DataFrame:
    """Shapes of one kind whose place and size agree within ``distance`` count once."""
    same = lambda a, b: (a["kind"] == b["kind"]) & (F.abs(a["x"] - b["x"]) < distance) & (F.abs(a["y"] - b["y"]) < distance) & (F.abs(a["w"] - b["w"]) < distance) & (F.abs(a["h"] - b["h"]) < distance)
    step = lambda acc, f: F.when(F.exists(acc, lambda k: same(f, k)), acc).otherwise(F.concat(acc, F.array(f)))
    return _scatter(_gather(shapes, F.col("pos")), F.aggregate("items", F.slice("items", 1, 0), step))


def detect_fields(elements: DataFrame) -> DataFrame:
    """All fields of each page, near ones once: dots, then underscores, checkboxes, underlines and digit rows.

    Elements of one ``pos`` follow each other by their other columns.
    """
    first = leader_fields(elements).unionByName(checkbox_fields(elements))
    rows = digit_box_rows(elements)
    lines = underlines_not_covered(first, elements)
    boxes = suppress_checkboxes(first.where("type = 'checkbox'"), rows)
    digits = rows.select(*PAGE, "pos", F.lit("text").alias("type"), "x", "y", "w", "h", F.lit(0.92).alias("confidence"), F.lit("digit_boxes").alias("context"), "band")
    parts = [first.where("context = 'dot_sequence'"), first.where("context = 'underscore_sequence'"), boxes, lines, digits]
    typed = []
    for k, part in enumerate(parts):
        # Arrival order: by kind of source, then place on the page; digit rows from their least y on.
        own = F.struct(F.lit(k).alias("source"), (F.col("band") if part is digits else F.lit(0)).cast("double").alias("band"), F.col("pos").alias("pos"))
        numbers = {c: F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence")}
        typed.append(part.withColumns(numbers | {"pos": own}).drop("band"))
    union = typed[0]
    for part in typed[1:]:
        union = union.unionByName(part)
    return dedupe_near(union).withColumn("pos", F.col("pos.pos"))


def usable_labels(elements: DataFrame) -> DataFrame:
    """Texts that can be labels in the stream variant."""
    text = F.trim("text")
    return elements.where("kind = 'text'").where((F.length(text) >= 2) & is_readable(text) & ~is_placeholder(text))


def _labels(texts: DataFrame) -> DataFrame:
    conf = F.col("conf") if "conf" in texts.columns else F.lit(1.0)
    return texts.select(*PAGE, F.col("pos").alias("l_pos"), F.col("text").alias("label"), conf.cast("double").alias("l_conf"), *[F.col(c).alias(f"l_{c}") for c in ("x", "y", "w", "h")])


def _nearest(fields: DataFrame, labels: DataFrame, condition: Column, distance: Column) -> DataFrame:
    """The label with the least distance (then place, then text) for each field for which one meets the condition."""
    met = fields.select(*PAGE, "pos", "x", "y", "w", "h").join(labels, PAGE).where(condition).withColumn("distance", distance)
    best = met.groupBy(*PAGE, "pos").agg(F.min_by(F.struct("label", "l_pos", "distance", "l_conf"), F.struct("distance", "l_pos", "label", "l_conf")).alias("best"))
    return best.select(*PAGE, "pos", "best.label", "best.l_pos", "best.distance", "best.l_conf")


def nearest_label_left(fields: DataFrame, texts: DataFrame, dy: float = LINE_SLACK, least: float = LEFT_LEAST, most: float = LEFT_MOST) -> DataFrame:
    """The label next to the left of each field on its line."""
    gap = F.col("x") - (F.col("l_x") + F.col("l_w"))
    return _nearest(fields, _labels(texts), (F.abs(F.col("l_y") - F.col("y")) <= dy) & gap.between(least, most), gap)


def nearest_label_above(fields: DataFrame, texts: DataFrame, most: float = ABOVE_MOST, slack: float = SIDE_SLACK) -> DataFrame:
    """The label next above each field that overlaps it sideways; a label without a width counts as 50 wide."""
    up = F.col("l_y") - F.col("y")
    width = F.when(F.coalesce("l_w", F.lit(0)) == 0, LABEL_WIDTH).otherwise(F.col("l_w"))
    beside = (F.col("l_x") + width >= F.col("x") - slack) & (F.col("l_x") <= F.col("x") + F.col("w") + slack)
    return _nearest(fields, _labels(texts), up.between(0, most) & beside, up)


def nearest_label(fields: DataFrame, texts: DataFrame, far: float = LEFT_FAR) -> DataFrame:
    """Left label, or the one above if there is none on the left or it is far and the other nearer."""
    left = nearest_label_left(fields, texts).withColumnsRenamed({"label": "left_label", "distance": "left_distance"}).drop("l_pos", "l_conf")
    above = nearest_label_above(fields, texts).withColumnsRenamed({"label": "above_label", "distance": "above_distance"}).drop("l_pos", "l_conf")
    both = fields.join(left, [*PAGE, "pos"], "left").join(above, [*PAGE, "pos"], "left")
    take_above = F.col("above_label").isNotNull() & (F.col("left_label").isNull() | ((F.col("left_distance") > far) & (F.col("above_distance") < F.col("left_distance"))))
    return both.withColumn("label", F.when(take_above, F.col("above_label")).otherwise(F.col("left_label"))).drop("left_label", "left_distance", "above_label", "above_distance")


def nearest_label_px(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """The raster variant: the left label by middle lines, else the one above; readable, no leader; with its confidence, if texts have one as ``conf``."""
    texts = texts.where(~is_placeholder_ocr("text") & is_readable_ocr("text"))
    labels = _labels(texts)
    gap = F.col("x") - (F.col("l_x") + F.col("l_w"))
    middle = F.abs((F.col("l_y") + F.col("l_h") / 2) - (F.col("y") + F.col("h") / 2))
    left = _nearest(fields, labels, (middle <= LINE_SLACK_PX) & gap.between(LEFT_LEAST_PX, LEFT_MOST_PX), gap)
    up = F.col("y") - (F.col("l_y") + F.col("l_h"))
    beside = (F.col("l_x") + F.col("l_w") >= F.col("x") - SIDE_SLACK_PX) & (F.col("l_x") <= F.col("x") + F.col("w") + SIDE_SLACK_PX)
    above = _nearest(fields, labels, up.between(0, ABOVE_MOST_PX) & beside, up)
    a, b = (d.select(*PAGE, "pos", F.struct("label", "l_conf").alias(n)) for d, n in ((left, "__left"), (above, "__above")))
    both = fields.join(a, [*PAGE, "pos"], "left").join(b, [*PAGE, "pos"], "left").withColumn("__best", F.coalesce("__left", "__above"))
    return both.withColumns({"label": F.col("__best.label"), "label_conf": F.col("__best.l_conf")}).drop("__left", "__above", "__best")


def assign_field_names(fields: DataFrame) -> DataFrame:
    """Names unique in a document: label as identifier, numbered from its second use; a clash takes the page, further ones their place too."""
    usable = F.coalesce(is_readable("label") & (F.length("label") >= 2), F.lit(False))
    base = F.when(usable, F.coalesce(F.nullif(to_field_name("label"), F.lit("")), F.lit("field"))).otherwise("field")
    order = ["page", "pos"]
    rows = fields.withColumn("base", base).withColumn("use", F.row_number().over(Window.partitionBy("doc_id", "base").orderBy(*order)))
    rows = rows.withColumn("name", F.when(F.col("use") > 1, F.concat_ws("_", "base", "use")).otherwise(F.col("base")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(*order)))
    clash = F.concat(F.col("name"), F.lit("_p"), F.col("page").cast("string"))
    further = F.concat(clash, F.lit("_"), F.col("pos").cast("string"))
    return rows.withColumn("field_name", F.when(F.col("again") > 2, further).when(F.col("again") == 2, clash).otherwise(F.col("name"))).drop("base", "use", "name", "again")


def field_order(fields: DataFrame) -> DataFrame:
    """Running index of fields in each document."""
    return fields.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1)


def enrich_fields(fields: DataFrame) -> DataFrame:
    """Clean label, kind of value and confidence of labelled fields."""
    label = clean_label("label")
    rows = fields.withColumn("label", F.when(F.coalesce(is_readable(label) & (F.length(label) >= 2), F.lit(False)), label))
    rows = rows.withColumn("pattern", match_pattern("label"))
    skip = F.coalesce(is_skip_label("label"), F.lit(False))
    confidence = label_confidence(F.col("confidence"), F.col("label").isNotNull(), F.col("pattern").isNotNull(), skip)
    return rows.withColumn("confidence", confidence).withColumns({"pattern_id": F.col("pattern.id"), "max_length": F.col("pattern.max_length")}).drop("pattern")


def doc_confidence(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Average confidence and number of fields and pages of each document, zero without any."""
    stats = fields.groupBy("doc_id").agg(F.avg("confidence").alias("avg"), F.count(F.lit(1)).alias("fields"), F.count_distinct("page").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("doc_id").distinct().join(stats, "doc_id", "left").select("doc_id", F.coalesce("avg", F.lit(0.0)).alias("avg_confidence"), zero("fields"), zero("pages"))


def doc_status(stats: DataFrame, threshold: float = 0.75) -> DataFrame:
    """What happens to a document."""
    status = F.when(F.col("fields") == 0, "NO_FIELDS").when(F.col("avg_confidence") >= threshold, "PROCESSED").otherwise("NEEDS_REVIEW")
    return stats.withColumn("status", status)


def run_summary(stats: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Number of documents of each status."""
    return doc_status(stats, threshold).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def needs_review(avg_confidence: Column, n_written: Column, n_detected: Column) -> Column:
    """Whether a form should be looked at."""
    return (avg_confidence < 0.75) | (n_detected == 0) | (n_written < 0.8 * n_detected)


def _in_cells(boxes: DataFrame, box: str) -> DataFrame:
    """Boxes once for each cell of the page's grid that they touch; ones of more than CELLS cells a side not at all."""
    first = lambda c: F.floor(F.col(f"{box}.{c}") / CELL)
    last = lambda c, size: F.floor((F.col(f"{box}.{c}") + F.greatest(F.col(f"{box}.{size}"), F.lit(0.0))) / CELL)
    few = _few_cells(box)
    cells = lambda c, size: F.when(few, F.sequence(first(c), last(c, size))).otherwise(F.array().cast("array<bigint>"))
    return boxes.withColumn("cell_x", F.explode(cells("x", "w"))).withColumn("cell_y", F.explode(cells("y", "h")))


def _few_cells(box: str) -> Column:
    spans = [F.floor((F.col(f"{box}.{c}") + F.greatest(F.col(f"{box}.{s}"), F.lit(0.0))) / CELL) - F.floor(F.col(f"{box}.{c}") / CELL) for c, s in (("x", "w"), ("y", "h"))]
    return F.coalesce((spans[0] < CELLS) & (spans[1] < CELLS), F.lit(False))


def iou_pairs(truth: DataFrame, detected: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of true and detected boxes of a page that overlap enough.

    Boxes meet in cells of a grid.  One that would lie in very many cells is joined with the boxes of its page.
    """
    box = lambda n: F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]).alias(n)
    a = truth.select(*PAGE, F.col("pos").alias("gi"), box("a"))
    b = detected.select(*PAGE, F.col("pos").alias("di"), box("b"))
    # Boxes that do not meet are dropped before the division.
    meet = (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")) & (F.col("a.y") < F.col("b.y") + F.col("b.h")) & (F.col("b.y") < F.col("a.y") + F.col("a.h"))
    # A pair counts in the one cell that holds the first corner of its overlap.
    corner = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / CELL) == F.col(f"cell_{c}")
    pairs = _in_cells(a, "a").join(_in_cells(b, "b"), [*PAGE, "cell_x", "cell_y"]).where(meet & corner("x") & corner("y")).drop("cell_x", "cell_y")
    wide_a, wide_b = a.where(~_few_cells("a")), b.where(~_few_cells("b"))
    pairs = pairs.unionByName(wide_a.join(b, PAGE).where(meet)).unionByName(wide_b.join(a.where(_few_cells("a")), PAGE).where(meet))
    return pairs.select(*PAGE, "gi", "di", iou(F.col("a"), F.col("b")).alias("iou")).where(F.col("iou") >= least)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """Pairs by falling overlap, each box used once; ties take the greater indexes first."""
    pages = pairs.groupBy(*PAGE).agg(F.reverse(F.array_sort(F.collect_list(F.struct("iou", "gi", "di")))).alias("items"))
    step = lambda acc, p: F.when(F.exists(acc, lambda k: (k["gi"] == p["gi"]) | (k["di"] == p["di"])), acc).otherwise(F.concat(acc, F.array(p)))
    return pages.select(*PAGE, F.inline(F.aggregate("items", F.slice("items", 1, 0), step)))


def detection_metrics(truth: DataFrame, detected: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each document."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    rows = n(truth, "n_true").join(n(detected, "n_found"), "doc_id", "full").join(n(matches, "tp"), "doc_id", "left").na.fill(0, ["n_true", "n_found", "tp"])
    rows = rows.withColumns({"precision": F.col("tp") / F.greatest("n_found", F.lit(1)), "recall": F.col("tp") / F.greatest("n_true", F.lit(1))})
    both = F.col("precision") + F.col("recall")
    return rows.select("doc_id", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def born_digital(page_stats: DataFrame) -> DataFrame:
    """Whether a document (doc_id, page, n_chars, largest_image) was made digitally."""
    stats = page_stats.groupBy("doc_id").agg(F.avg("n_chars").alias("chars_per_page"), F.avg((F.coalesce("largest_image", F.lit(0)) > 250_000).cast("int")).alias("image_share"))
    return stats.select("doc_id", ((F.col("chars_per_page") >= 200) & (F.col("image_share") < 0.5)).alias("born_digital"))
