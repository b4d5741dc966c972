"""Record linkage: listing entries, procedures, templates, files and progress records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicforms.functions.text import doc_id_from_stem, normalize_url, sanitize_folder, split_progress_key


def keep_by_order(df: DataFrame, key: str | list[str], ordinal: str, keep: str = "first") -> DataFrame:
    """One row per key: the first (W1) or the last (W2) in the given order."""
    keys = [key] if isinstance(key, str) else key
    turn = F.Column.asc if keep == "first" else F.Column.desc
    # Of equal ordinals the other columns decide, so that the result does not depend on chance.
    rest = [F.col(c) for c, kind in df.dtypes if c not in {*keys, ordinal} and "map<" not in kind]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[turn(c) for c in [F.col(ordinal), *rest]])))
    return ranked.where("__rank = 1").drop("__rank")


def with_progress_ids(progress: DataFrame) -> DataFrame:
    """Add bundle, stem and doc_id to progress records (key, template_id)."""
    bundle, stem = split_progress_key("key")
    return progress.withColumns({"bundle": bundle, "stem": stem}).withColumn("source_doc_id", doc_id_from_stem("stem"))


def doc_to_procedure(progress: DataFrame, entries: DataFrame, keep: str = "first") -> DataFrame:
    """Templates of progress records with the procedure of their document."""
    known = keep_by_order(entries.where(F.col("procedure_id").isNotNull()), "id", "ordinal", keep).select(F.col("id").alias("source_doc_id"), "procedure_id", "procedure")
    return with_progress_ids(progress).join(known, "source_doc_id").select("template_id", "source_doc_id", "procedure_id", "procedure")


def url_to_doc_id(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents of procedures with the listing id of the same address."""
    known = keep_by_order(entries.where(F.col("download_url").isNotNull()).withColumn("url_key", normalize_url("download_url")), "url_key", "ordinal")
    known = known.select("url_key", F.col("id").alias("source_doc_id"))
    return documents.withColumn("url_key", normalize_url("download_url")).join(known, "url_key", "left").drop("url_key")


def nest_documents(documents: DataFrame) -> DataFrame:
    """Documents gathered again, in order, for each procedure."""
    fields = [c for c in documents.columns if c not in ("procedure_id", "pos")]
    parts = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    return documents.groupBy("procedure_id").agg(F.transform(parts, lambda d: F.struct(*[d[c].alias(c) for c in fields])).alias("documents"))


def procedure_meta(procedures: DataFrame, entries: DataFrame) -> DataFrame:
    """Procedures with institution, county and city of their first entry."""
    first = keep_by_order(entries.where(F.col("procedure_id").isNotNull()), "procedure_id", "ordinal")
    return procedures.join(first.select("procedure_id", F.col("institution").alias("listed_institution"), F.col("county").alias("listed_county"), F.col("city").alias("listed_city")), "procedure_id", "left")


def procedures_in_scope(procedures: DataFrame, progress: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Procedures with an uploaded form, and ids of such procedures that are missing."""
    wanted = doc_to_procedure(progress, entries, keep="last").select("procedure_id").distinct()
    return procedures.join(wanted, "procedure_id", "left_semi"), wanted.join(procedures, "procedure_id", "left_anti")


def institution_county_map(entries: DataFrame) -> DataFrame:
    """The first county given for each institution."""
    return keep_by_order(entries.where("institution <> '' AND county IS NOT NULL"), "institution", "ordinal").select(F.col("institution").alias("organization"), F.col("county").alias("listed_county"))


def pair_artifacts(files: DataFrame) -> DataFrame:
    """pdf and json of the same bundle and stem (J7): bundle, stem, pdf, json; unpaired ones keep a null."""
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    return files.groupBy("bundle", "stem").agg(of("pdf"), of("json"))


def locate_source(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs with the first source file of their bundle and stem."""
    source = files.groupBy("bundle", "stem").agg(F.min("path").alias("source"))
    return outputs.join(source, ["bundle", "stem"], "left")


def reconcile_patches(patches: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """What a patch would do: missing, already_set or to_patch."""
    there = existing.select(key, F.col(value).alias("__current"), F.lit(True).alias("__there"))
    outcome = F.when(F.col("__there").isNull(), "missing").when(F.col("__current").eqNullSafe(F.col(value)), "already_set").otherwise("to_patch")
    return patches.join(there, key, "left").withColumn("outcome", outcome).drop("__current", "__there")


def rule_patch(templates: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Organisation and county of templates without one, by the first rule whose pattern the name matches."""
    hit: Column | None = None
    for pattern, organization, county in rules:
        value = F.struct(F.lit(organization).alias("organization"), F.lit(county).alias("county"))
        found = F.col("name").rlike(f"(?iu){pattern}")
        hit = F.when(found, value) if hit is None else hit.when(found, value)
    open_rows = templates.where(F.coalesce("organization", F.lit("")) == "").withColumn("patch", hit)
    return open_rows.where("patch IS NOT NULL").select("id", "patch.organization", "patch.county")


def classify_missing_county(templates: DataFrame) -> DataFrame:
    """Which templates had a county, get one from their organisation (``county_of_org``), or stay without."""
    had = F.coalesce("county", F.lit("")) != ""
    kind = F.when(had, "had").when(F.col("county_of_org").isNotNull(), "derived").otherwise("missing")
    return templates.select("id", "organization", F.when(had, F.col("county")).otherwise(F.col("county_of_org")).alias("county"), kind.alias("outcome"))


def county_distribution(patches: DataFrame) -> DataFrame:
    """Patched rows of each county (A3)."""
    return patches.where("outcome = 'derived'").groupBy("county").agg(F.count(F.lit(1)).alias("n"))


def skip_reasons(progress: DataFrame, entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Why progress records can or cannot be linked, and how many of each."""
    listed = keep_by_order(entries, "id", "ordinal").select(F.col("id").alias("source_doc_id"), F.col("procedure_id").alias("found_procedure"), F.lit(True).alias("listed"))
    current = templates.select(F.col("id").alias("template_id"), F.col("procedure_id").alias("current"), F.lit(True).alias("there"))
    rows = with_progress_ids(progress).join(listed, "source_doc_id", "left").join(current, "template_id", "left")
    reason = (
        F.when(F.col("template_id").isNull(), "no_template_id").when(F.col("source_doc_id").isNull(), "no_stem_id")
        .when(F.col("listed").isNull() | F.col("found_procedure").isNull(), "no_index_hit").when(F.col("there").isNull(), "missing")
        .when(F.col("current").eqNullSafe(F.col("found_procedure")), "already_set").otherwise("to_patch")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def placement_plan(templates: DataFrame, placed: DataFrame) -> DataFrame:
    """Folder of each template by its organisation, and whether it must move (J21); originals go to a sub-folder."""
    target = sanitize_folder(F.coalesce(F.nullif("organization", F.lit("")), F.lit("Altele")))
    files = templates.select("id", F.lit("filled").alias("kind"), target.alias("target"))
    originals = templates.select("id", F.lit("original").alias("kind"), F.concat(target, F.lit("/originals")).alias("target"))
    plan = files.unionByName(originals).join(placed, ["id", "kind"], "left")
    return plan.select("id", "kind", "target", F.when(F.col("folder").eqNullSafe(F.col("target")), "in_place").otherwise("move").alias("action"))


LAST_SUFFIX = 99


def next_free_name(name: Column, taken: Column, most: int = LAST_SUFFIX) -> Column:
    """The name, or the first of name_2 .. name_<most> that is not taken; the last if all are (W13, one file)."""
    tries = F.concat(F.array(name), F.transform(F.sequence(F.lit(2), F.lit(most)), lambda i: F.concat(name, F.lit("_"), i.cast("string"))))
    return F.coalesce(F.try_element_at(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(1)), F.concat(name, F.lit(f"_{most}")))


def free_names(files: DataFrame, existing: DataFrame, most: int = LAST_SUFFIX) -> DataFrame:
    """Names for new files (id, folder, base, ordinal) beside existing ones (folder, name), as if named one after another.

    The k-th new file of a base takes the base's k-th free name; further ones the last.  Where bases of a folder
    differ by a numbered ending alone, as ``x`` and ``x_2``, a name given to one is no longer free for
    the other; those few families are named in order, with the names they hold as all that is kept.
    """
    root = lambda c: F.regexp_replace(c, r"(_([2-9]|[1-9][0-9]))+$", "")
    rows = files.select("id", "folder", "base", "ordinal").withColumn("root", root("base"))
    mixed = rows.groupBy("folder", "root").agg(F.min("base").alias("a"), F.max("base").alias("b")).where("a <> b").select("folder", "root")
    key = ["folder", "root"]
    return _free_by_rank(rows.join(mixed, key, "left_anti"), existing, most).unionByName(_free_in_order(rows.join(mixed, key, "left_semi"), existing.withColumn("root", root("name")).join(mixed, key, "left_semi"), most))


def _free_by_rank(rows: DataFrame, existing: DataFrame, most: int) -> DataFrame:
    number = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("number")
    tries = rows.select("folder", "base").distinct().select("folder", "base", number)
    tries = tries.withColumn("name", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("number").cast("string"))))
    free = tries.join(existing.select("folder", "name"), ["folder", "name"], "left_anti")
    free = free.withColumn("rank", F.row_number().over(Window.partitionBy("folder", "base").orderBy("number"))).select("folder", "base", "rank", "name")
    # Only as many files of a base as there can be names are ranked; Spark drops the others before they are moved.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("folder", "base").orderBy("ordinal", "id"))).where(F.col("rank") <= most)
    named = ranked.join(free, ["folder", "base", "rank"]).select("id", "name")
    last = F.concat(F.col("base"), F.lit(f"_{most}"))
    return rows.join(named, "id", "left").select("id", "folder", F.coalesce("name", last).alias("name"))


def _free_in_order(rows: DataFrame, existing: DataFrame, most: int) -> DataFrame:
    there = existing.select("folder", "root", F.lit(False).alias("new"), F.col("name").alias("base"))
    both = rows.withColumn("new", F.lit(True)).unionByName(there, allowMissingColumns=True)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken = None, set()
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if (r["folder"], r["root"]) != family:
                    family, taken = (r["folder"], r["root"]), set()
                name = r["base"]
                if r["new"]:
                    tries = (name if k == 1 else f"{name}_{k}" for k in range(1, most + 1))
                    name = next((t for t in tries if t not in taken), f"{name}_{most}")
                    found.append((r["id"], r["folder"], name))
                taken.add(name)
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(n).type) for c, n in zip(columns, ("id", "folder", "base"), strict=True)], names=["id", "folder", "name"])

    ordered = both.repartition("folder", "root").sortWithinPartitions("folder", "root", "new", "ordinal", "id")
    return ordered.mapInArrow(run, f"id {kind}, folder string, name string")
