"""The catalog of templates and procedures: slim rows, search, filters, trees and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicforms.functions import rules
from civicforms.functions.text import blank_to_null, fold, xml_escape
from civicforms.operators.county import PROCEDURE_NATIONAL, TEMPLATE_NATIONAL
from civicforms.operators.linkage import keep_by_order
from civicforms.storage import Workspace

NO_ORGANIZATION, NO_INSTITUTION, NO_GROUP = "Altele", "Necunoscut", "General"


def filter_active(templates: DataFrame) -> DataFrame:
    """Templates that are not archived (P5)."""
    return templates.where(~F.coalesce("archived", F.lit(False)))


def project_slim_template(templates: DataFrame) -> DataFrame:
    """Templates without their nested fields, with the number of visible ones."""
    visible = F.size(F.filter(F.coalesce("fields", F.array()), lambda f: ~F.coalesce(f["hidden"], F.lit(False))))
    optional = [blank_to_null(c).alias(c) for c in ("organization", "county", "procedure_id", "source_doc_id")]
    return templates.select("id", "name", *optional, F.coalesce("version", F.lit(1)).alias("version"), "created_at", "archived", visible.alias("visible_field_count"))


def institution_fallback(institution: Column, responsible: Column) -> Column:
    """The institution, else the responsible one up to its first comma, else unknown."""
    first = F.trim(F.element_at(F.split(responsible, ","), 1))
    return F.coalesce(blank_to_null(institution), blank_to_null(first), F.lit(NO_INSTITUTION))


def project_slim_procedure(procedures: DataFrame) -> DataFrame:
    """Known parts of a procedure with defaults, its documents rebuilt."""
    text = lambda d, k: F.coalesce(d[k], F.lit("")).alias(k)
    documents = F.transform(
        F.coalesce("documents", F.array()),
        lambda d: F.struct(text(d, "name"), F.coalesce(d["required"], F.lit(False)).alias("required"), d["download_url"].alias("download_url"), d["source_doc_id"].alias("source_doc_id")),
    )
    return procedures.select("procedure_id", "title", institution_fallback(F.col("institution"), F.col("responsible")).alias("institution"), "county", "city", documents.alias("documents"))


def filter_has_documents(procedures: DataFrame) -> DataFrame:
    """Procedures with at least one document."""
    return procedures.where(F.size(F.coalesce("documents", F.array())) > 0)


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose columns, joined by blanks, hold the needle, whatever case and accents (P10)."""
    if not needle.strip():
        return df
    return df.where(fold(F.concat_ws(" ", *columns)).contains(fold(F.lit(needle.strip()))))


def filter_county(df: DataFrame, county: str) -> DataFrame:
    """Rows of one county bucket; ``__all__`` passes all."""
    return df if county == "__all__" else df.where(F.col("county_bucket") == county)


def filter_org_contains(templates: DataFrame, needle: str) -> DataFrame:
    """Templates whose organisation holds a text."""
    return templates.where(F.lower(F.coalesce("organization", F.lit(NO_ORGANIZATION))).contains(needle.lower()))


def visible_fields(fields: Column) -> Column:
    """Fields that are shown, by their order and then their place."""
    placed = F.transform(fields, lambda f, i: F.struct(F.coalesce(f["order"], F.lit(0)).alias("order"), i.alias("place"), f.alias("field")))
    shown = F.filter(placed, lambda p: ~F.coalesce(p["field"]["hidden"], F.lit(False)))
    return F.transform(F.array_sort(shown), lambda p: p["field"])


def no_title_no_docs(procedures: DataFrame) -> DataFrame:
    """Procedures with neither title nor documents."""
    return procedures.where(F.col("title").isNull() & (F.size(F.coalesce("documents", F.array())) == 0))


def editable_pairs(documents: DataFrame, procedures: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (procedure_id, template_id) that a document or the procedure itself leads to.

    Two equi-joins in place of one join on an OR, which Spark could only run as a nested loop.
    """
    active = filter_active(templates)
    by_doc = keep_by_order(active.where(F.coalesce("source_doc_id", F.lit("")) != ""), "source_doc_id", "ordinal", "last").select("source_doc_id", F.col("id").alias("template_id"))
    a = documents.select("procedure_id", "source_doc_id").join(by_doc, "source_doc_id").select("procedure_id", "template_id")
    b = procedures.select("procedure_id").join(active.select("procedure_id", F.col("id").alias("template_id")), "procedure_id")
    return a.unionByName(b).distinct()


def _document_ids(documents: DataFrame) -> DataFrame:
    return documents.select("procedure_id", "source_doc_id").where("source_doc_id IS NOT NULL").distinct()


def procedure_forms(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (procedure_id, template_id) of active templates with the procedure's id or any of its documents' ids."""
    active = filter_active(templates).select("id", "procedure_id", "source_doc_id")
    # Each pair of ids meets the templates once, however many documents of a procedure have it.
    a = _document_ids(documents).join(active.select("source_doc_id", F.col("id").alias("template_id")), "source_doc_id").select("procedure_id", "template_id")
    b = documents.select("procedure_id").distinct().join(active.select("procedure_id", F.col("id").alias("template_id")), "procedure_id")
    return a.unionByName(b).distinct()


def editable_count(documents: DataFrame, procedures: DataFrame, templates: DataFrame) -> DataFrame:
    """Number of templates that can be edited from each procedure."""
    counts = editable_pairs(documents, procedures, templates).groupBy("procedure_id").agg(F.count(F.lit(1)).alias("n"))
    return procedures.select("procedure_id").join(counts, "procedure_id", "left").select("procedure_id", F.coalesce("n", F.lit(0)).alias("n"))


def filter_editable_only(procedures: DataFrame, documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Procedures with an editable template."""
    return procedures.join(editable_pairs(documents, procedures, templates), "procedure_id", "left_semi")


def document_form_pairing(documents: DataFrame, forms: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents with the form of the same id among their procedure's forms; of several the last counts."""
    own = forms.join(templates.select(F.col("id").alias("template_id"), "source_doc_id", "ordinal"), "template_id").where("source_doc_id IS NOT NULL")
    own = keep_by_order(own, ["procedure_id", "source_doc_id"], "ordinal", "last").select("procedure_id", "source_doc_id", "template_id")
    return documents.join(own, ["procedure_id", "source_doc_id"], "left").select("procedure_id", "pos", "source_doc_id", "template_id")


def orphan_forms(documents: DataFrame, forms: DataFrame, templates: DataFrame) -> DataFrame:
    """Forms of a procedure that none of its documents is paired with."""
    paired = document_form_pairing(documents, forms, templates).where("template_id IS NOT NULL").select("procedure_id", "template_id").distinct()
    return forms.join(paired, ["procedure_id", "template_id"], "left_anti")


def catalog_tree(templates: DataFrame) -> DataFrame:
    """County and organisation, their templates by name in Romanian order, and totals (A4, O1).  Needs ``county_bucket``.

    All items of a node are one row; for nodes of any size see ``item_places``.
    """
    return _tree(templates, F.coalesce(blank_to_null("organization"), F.lit(NO_ORGANIZATION)).alias("organization"), "organization", F.struct(F.coalesce("name", F.lit("")).alias("label"), "id"))


def procedure_tree(procedures: DataFrame) -> DataFrame:
    """County and institution, their procedures by title in Romanian order, and totals (A5, O1).  Needs ``county_bucket``; as ``catalog_tree``."""
    return _tree(procedures, F.coalesce("institution", F.lit(NO_INSTITUTION)).alias("institution"), "institution", F.struct(F.coalesce("title", F.lit("")).alias("label"), F.col("procedure_id").alias("id")))


def _tree(df: DataFrame, node: Column, name: str, item: Column) -> DataFrame:
    groups = df.groupBy("county_bucket", node).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.collate(item["label"], "ro").alias("order"), item["label"].alias("label"), item["id"].alias("id")))).alias("items"))
    groups = groups.withColumn("items", F.transform("items", lambda x: F.struct(x["label"], x["id"])))
    # Totals come from the groups, one row an organisation, not from the rows again.
    return groups.select(F.col("county_bucket").alias("county"), name, "n", F.sum("n").over(Window.partitionBy("county_bucket")).alias("total"), "items")


def _romanian(name: str, pinned: str, first: bool) -> list[Column]:
    """Order by a name in Romanian, with one value pinned first or last."""
    pin = F.when(F.col(name) == pinned, 0 if first else 1).otherwise(1 if first else 0)
    return [pin, F.collate(name, "ro"), F.col(name)]


def tree_order(tree: DataFrame, name: str, pinned: str, first: bool) -> DataFrame:
    """A tree in Romanian order with one county pinned first or last (O1, O2)."""
    return tree.orderBy(*_romanian("county", pinned, first), F.collate(name, "ro"), name)


def tree_positions(tree: DataFrame, name: str, pinned: str, first: bool) -> DataFrame:
    """The place of each county among the counties, and of each node within its county, in that order (O1, O2)."""
    # Places of counties come from one row each; those of nodes are counted county by county.
    counties = tree.select("county").distinct()
    counties = counties.withColumn("county_place", F.row_number().over(Window.orderBy(*_romanian("county", pinned, first))))
    placed = tree.join(counties, "county")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("county").orderBy(F.collate(name, "ro"), name)))


def item_places(df: DataFrame, node: Column, label: Column, item_id: Column) -> DataFrame:
    """county, node, item and its place among the items of the node, by label in Romanian order and then by id (A4, A5, O1).

    Works for nodes of any size: rows are dealt by ranges of the whole order, so that a large node lies in
    many partitions.  An item's place is its place within its partition and what the node has in those before.
    """
    space = Workspace(df.sparkSession, "item-places")
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col("county_bucket").alias("county"), node.alias("node"), F.coalesce(label, F.lit("")).alias("label"), item_id.alias("item"))
    order = [F.collate("label", "ro"), F.col("label"), F.col("item")]
    # Written, since the borders of ranges come from a sample and must stay what they are.
    dealt = space.write(rows.repartitionByRange(width, "county", "node", *order).withColumn("slice", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("county", "node", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("county", "node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"__{c}") for c in ("county", "node", "slice")], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("county", "node", "slice").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("county", "node", "slice")]
    return within.join(before, same).select("county", "node", "item", (F.col("before") + F.col("place")).alias("place"))


def tree_totals(df: DataFrame, name: str) -> DataFrame:
    """Counts of each county and institution, each county, and all."""
    return df.rollup("county_bucket", name).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def national_bucket_report(procedures: DataFrame, most: int = 30, samples: int = 3, order: str = "procedure_id") -> DataFrame:
    """Nationwide institutions with the most procedures: counts, documents, and the titles of the first ones by ``order`` (A7).  A top-k report."""
    rows = procedures.where(F.col("county_bucket") == PROCEDURE_NATIONAL).withColumn("institution", F.coalesce(blank_to_null("institution"), F.lit("(no institution)")))
    counts = rows.groupBy("institution").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.coalesce("documents", F.array()))).alias("docs"))
    top = counts.orderBy(F.desc("n"), "institution").limit(most)
    # A few rows an institution are kept before anything is gathered.
    place = F.row_number().over(Window.partitionBy("institution").orderBy(order))
    first = rows.select("institution", F.coalesce("title", F.lit("(no title)")).alias("title"), place.alias("place")).where(F.col("place") <= samples)
    titles = first.groupBy("institution").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("titles"))
    return top.join(titles, "institution", "left")


def present_counties(templates: DataFrame) -> DataFrame:
    """County buckets that occur: canonical ones in order, nationwide last."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate([*rules.COUNTIES, TEMPLATE_NATIONAL]) for x in (c, i)])
    return templates.select(F.col("county_bucket").alias("county")).distinct().withColumn("position", F.element_at(order, F.col("county"))).where("position IS NOT NULL")


def public_counties(procedures: DataFrame) -> DataFrame:
    """Every county bucket of the procedures with its place: nationwide first, then in Romanian order."""
    found = procedures.select(F.col("county_bucket").alias("county")).distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy(*_romanian("county", PROCEDURE_NATIONAL, True))))


def fields_by_type(fields: DataFrame) -> DataFrame:
    """Fields of each type in each template, and how many are hidden."""
    return fields.groupBy("template_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("hidden").alias("hidden"))


def fields_by_group(fields: DataFrame) -> DataFrame:
    """Fields of each section of each template."""
    return fields.groupBy("template_id", F.coalesce(blank_to_null("section"), F.lit(NO_GROUP)).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def catalog_summary(slim: DataFrame) -> DataFrame:
    """Number of templates, active ones, and the first and last by name."""
    order = F.struct("name", "id")
    return slim.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("archived", F.lit(False))).alias("active"),
        F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"),
    )


def sitemap_rows(slim: DataFrame, site: str, generated_at: str) -> DataFrame:
    """Home, listing and every active template as sitemap rows, all as of the catalog's time."""
    row = lambda loc, often, priority: F.struct(loc.alias("loc"), F.lit(generated_at[:10]).alias("lastmod"), F.lit(often).alias("changefreq"), F.lit(priority).alias("priority"))
    fixed = slim.sparkSession.range(1).select(F.inline(F.array(row(F.lit(f"{site}/"), "monthly", "1.0"), row(F.lit(f"{site}/proceduri"), "daily", "0.9"))))
    pages = filter_active(slim).select(row(xml_escape(F.concat(F.lit(f"{site}/fill/"), F.col("id"))), "monthly", "0.7").alias("row")).select("row.*")
    return fixed.unionByName(pages)


def sitemap_lines(rows: DataFrame) -> DataFrame:
    """Sitemap rows as XML elements, one a row."""
    return rows.select(F.format_string("  <url>\n    <loc>%s</loc>\n    <lastmod>%s</lastmod>\n    <changefreq>%s</changefreq>\n    <priority>%s</priority>\n  </url>", "loc", "lastmod", "changefreq", "priority").alias("value"))


def by_id(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The row with an identifier (J20); the filter reaches the scan."""
    return df.where(F.col(key) == value)
