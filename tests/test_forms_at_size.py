"""Pairing of documents and forms where a procedure names one document many times."""

import re

from civicforms.operators import catalog


def _many(spark):
    documents = spark.range(600).selectExpr("concat('', id % 2) AS procedure_id", "id AS pos", "concat('', id % 3) AS source_doc_id")
    templates = spark.range(12).selectExpr("concat('t', id) AS id", "id AS ordinal", "false AS archived", "CASE WHEN id > 9 THEN '1' END AS procedure_id", "concat('', id % 4) AS source_doc_id")
    return documents, templates


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_ids_of_documents_meet_templates_once(spark):
    documents, templates = _many(spark)
    forms = catalog.procedure_forms(documents, templates)
    by_id = {(p, f"t{t}") for p in "01" for t in range(12) if t % 4 < 3}
    assert {tuple(r) for r in forms.collect()} == by_id | {("1", "t10"), ("1", "t11")}
    assert forms.count() == len(by_id) + 1
    assert re.search(r"Aggregate \[procedure_id, source_doc_id\]", _plan(forms))


def test_orphans_meet_each_paired_form_once(spark):
    documents, templates = _many(spark)
    orphans = catalog.orphan_forms(documents, catalog.procedure_forms(documents, templates), templates)
    last = {"t8", "t9", "t10"}
    assert sorted(map(tuple, orphans.collect())) == sorted([(p, f"t{t}") for p in "01" for t in range(12) if t % 4 < 3 and f"t{t}" not in last] + [("1", "t11")])
    assert re.search(r"^\+- Aggregate \[procedure_id, template_id\]", _plan(orphans), re.M), _plan(orphans)
