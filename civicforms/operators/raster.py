"""Form fields of scanned or drawn pages: shapes from drawings, and fields with labels from shapes and read texts.

Works in whole pixels from the top left, page by page like ``layout``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicforms.functions.text import clean_label_ocr, is_placeholder_ocr
from civicforms.operators.layout import PAGE, combined_confidence, dedupe_overlap, dedupe_shapes, leader_confidence, nearest_label_px, pt_to_px, underline_confidence

# Sizes in points that make a drawn line an underline, a rectangle a checkbox or a table cell, and what each is worth.
LEVEL, LINE_LENGTH, LINE_CONFIDENCE = 1.0, 50.0, 0.95
SQUARE_LEAST, SQUARE_MOST, SQUARE_CONFIDENCE = 6.0, 16.0, 0.92
CELL_WIDTHS, CELL_HEIGHTS, CELL_CONFIDENCE = (28.0, 360.0), (10.0, 36.0), 0.92
# The same for contours found in an image, in pixels.
RUN_WIDTH, RUN_HEIGHT, RUN_SHAPE = 60, 4, 15
CONTOUR_LEAST, CONTOUR_MOST, CONTOUR_CONFIDENCE = 18, 45, 0.80
#: The greatest difference of a checkbox's sides, as a share of the longer one.
ASPECT = 0.25


def classify_line(dx: Column, dy: Column) -> Column:
    """Whether a drawn line is an underline, by the distances of its end points."""
    return F.when((dy <= LEVEL) & (dx >= LINE_LENGTH), "underline")


def classify_drawn_rect(w: Column, h: Column) -> Column:
    """Whether a drawn rectangle is a checkbox, a table cell or neither."""
    square = w.between(SQUARE_LEAST, SQUARE_MOST) & h.between(SQUARE_LEAST, SQUARE_MOST) & (F.abs(w - h) / F.greatest(w, h) <= ASPECT)
    return F.when(square, "checkbox").when(w.between(*CELL_WIDTHS) & h.between(*CELL_HEIGHTS), "cell")


def classify_contour(w: Column, h: Column) -> Column:
    """What the outline of a thing in an image can be by its size: underline, checkbox or neither."""
    run = (w >= RUN_WIDTH) & (h <= RUN_HEIGHT) & (w / F.greatest(h, F.lit(1)) >= RUN_SHAPE)
    square = w.between(CONTOUR_LEAST, CONTOUR_MOST) & h.between(CONTOUR_LEAST, CONTOUR_MOST) & (F.abs(w - h) / F.greatest(w, h) <= ASPECT)
    return F.when(run, "underline").when(square, "checkbox")


def shapes_of_drawings(drawings: DataFrame, scale: float, distance: float = 4) -> DataFrame:
    """Shapes in pixels from drawn lines and rectangles (op ``l`` or ``re``, x0, y0, x1, y1 in points), near ones once."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    line = F.col("op") == "l"
    kind = F.when(line, classify_line(dx, dy)).when(F.col("op") == "re", classify_drawn_rect(dx, dy))
    pixels = lambda c: pt_to_px(c, F.lit(scale))
    height = F.when(line, F.greatest(F.lit(1), pixels(F.greatest(dy, F.lit(0.5))))).otherwise(pixels(dy))
    confidence = F.when(line, LINE_CONFIDENCE).when(kind == "checkbox", SQUARE_CONFIDENCE).otherwise(CELL_CONFIDENCE)
    shapes = drawings.select(
        *PAGE, "pos", kind.alias("kind"), pixels(F.least("x0", "x1")).alias("x"), pixels(F.least("y0", "y1")).alias("y"), pixels(dx).alias("w"), height.alias("h"), confidence.alias("conf")
    ).where("kind IS NOT NULL")
    return dedupe_shapes(shapes, distance)


def shapes_of_contours(contours: DataFrame, distance: float = 6) -> DataFrame:
    """Shapes from outlines (x, y, w, h in pixels) found in an image, near ones once."""
    kind = classify_contour(F.col("w"), F.col("h"))
    confidence = F.when(kind == "underline", underline_confidence(F.col("w"))).otherwise(CONTOUR_CONFIDENCE)
    return dedupe_shapes(contours.select(*PAGE, "pos", kind.alias("kind"), "x", "y", "w", "h", confidence.alias("conf")).where("kind IS NOT NULL"), distance)


def leader_source(text: Column) -> Column:
    """What a leader is made of: underscores if it has at least four, else dots (F27, raster variant)."""
    underscores = F.length(text) - F.length(F.replace(text, F.lit("_"), F.lit("")))
    return F.when(underscores >= 4, "underscore_leader").otherwise("dot_leader")


def fields_of_leaders(items: DataFrame) -> DataFrame:
    """Fields from texts that are leaders, worth more the longer they are."""
    rows = items.where(is_placeholder_ocr("text"))
    worth = leader_confidence(F.length(F.trim("text")))
    return rows.select(*PAGE, "pos", F.lit("text").alias("type"), leader_source(F.col("text")).alias("source"), "x", "y", "w", "h", worth.alias("confidence"))


def fields_of_shapes(shapes: DataFrame) -> DataFrame:
    """Fields from shapes: a checkbox is one, all others are for text."""
    kind = F.when(F.col("kind") == "checkbox", "checkbox").otherwise("text")
    return shapes.select(*PAGE, "pos", kind.alias("type"), F.col("kind").alias("source"), "x", "y", "w", "h", F.col("conf").alias("confidence"))


def assemble_fields(items: DataFrame, shapes: DataFrame) -> DataFrame:
    """Fields of a page with their labels, from read texts (with ``conf``) and shapes.

    Of fields that overlap the surer one stays; of equally sure ones leaders come before shapes.  Adds ``label``,
    ``label_conf`` (0 without a label), ``detection_conf`` and the ``confidence`` of both.
    """
    order = lambda k: F.struct(F.lit(k).alias("part"), F.col("pos").alias("pos"))
    parts = [fields_of_leaders(items).withColumn("pos", order(0)), fields_of_shapes(shapes).withColumn("pos", order(1))]
    sizes = {c: F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence")}
    fields = dedupe_overlap(parts[0].withColumns(sizes).unionByName(parts[1].withColumns(sizes)))
    labelled = nearest_label_px(fields, items)
    label = F.nullif(clean_label_ocr("label"), F.lit(""))
    rows = labelled.withColumnRenamed("confidence", "detection_conf").withColumn("label", label)
    return rows.withColumns({
        "confidence": combined_confidence(F.col("detection_conf"), F.when(F.col("label").isNotNull(), F.col("label_conf"))),
        "label_conf": F.coalesce("label_conf", F.lit(0.0)), "part": F.col("pos.part"), "pos": F.col("pos.pos"),
    })
