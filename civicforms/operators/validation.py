"""Checks of filled-in values, and the merge of field annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_form_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Violations of the rules of fields (template_id, name, type, required, pattern, max_length, min, options) by values."""
    rows = fields.join(values, ["template_id", "name"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    filled = F.col("value") != ""
    checks = {
        "required": F.col("required") & ~filled,
        "pattern": filled & F.col("pattern").isNotNull() & ~F.expr("value rlike pattern"),
        "max_length": filled & (F.length("value") > F.col("max_length")),
        "min_length": filled & (F.length("value") < F.col("min_length")),
        "option": filled & F.col("type").isin("dropdown", "radio") & ~F.array_contains("options", F.col("value")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return rows.select("template_id", "name", F.explode(found).alias("violation"))


ANNOTATIONS = ("label", "placeholder", "hint", "section", "order")


def merge_field_annotations(new: DataFrame, old: DataFrame) -> DataFrame:
    """New fields with the annotations of old ones of the same name, nulls of the old included."""
    before = old.select("template_id", "name", F.struct(*ANNOTATIONS).alias("old"))
    rows = new.join(before, ["template_id", "name"], "left")
    kept = {c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(c)) for c in ANNOTATIONS}
    return rows.withColumns(kept).drop("old")


def replaced_templates(templates: DataFrame, replaced: DataFrame) -> DataFrame:
    """Templates with the version after a form was replaced: one more for each that has new fields, 1 where none was given before."""
    changed = replaced.select("template_id").distinct().withColumn("__changed", F.lit(True))
    rows = templates.join(changed, templates["id"] == changed["template_id"], "left").drop("template_id")
    version = F.coalesce("version", F.lit(1))
    return rows.withColumn("version", F.when(F.col("__changed"), version + 1).otherwise(version)).drop("__changed")
