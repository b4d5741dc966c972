"""Domain views over the carrier tables, in SQL that Spark and other engines read alike.

Each view names what it reads in braces: carrier tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "Primaria Municipiului Lugoj", "Primaria Orasului Baicoi - Prahova", "Primaria Comunei Gruiu-Ilfov", "Primaria Sectorului 3 Bucuresti", "Consiliul Judetean Brăila",
    "Prefectura Judetului Cluj", "Prefectura Municipiului Bucuresti", "Ministerul Apararii Nationale - Spitalul Militar Constanta", "Agentia Nationala de Administrare Fiscala",
    "Colegiul Medicilor Brăila", "Universitatea Babeș-Bolyai din Cluj-Napoca", "Primaria Onesti", "Primaria Municipiului Cluj-Napoca", "S.C. APA PROD S.A. Deva",
    "Some unknown entity", "ANCOM", "Casa Județeană de Pensii Bistrița-Năsăud", "Directia Silvica Satu Mare", "", "Orange Romania S.A.",
    "Academia Navala Mircea cel Batran", "Inspectoratul de Stat in Constructii - I.S.C", "Primaria Comunei Valea Marului",
)
COUNTIES = ("București", "CLUJ", "Municipiul București", "Atlantis", "National", "Bistrita Nasaud")
LABELS = ("Nume:", "........", "____", "Data nasterii", "1. Adresa,", "Pag. 3", "E-mail:", "CNP", "#$%^~~", "Telefon / fax")


def pick(expression: str, values: tuple[str, ...]) -> str:
    """One of the values by a number."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE ({expression}) % {len(values)} {cases} END"


VIEWS = {
    "v_raw_entries": f"""
        SELECT doc_id AS id, doc_id AS ordinal, {pick("doc_id", NAMES)} AS institution_name,
          CASE doc_id % 5 WHEN 0 THEN concat('acte/f_', doc_id, '.PDF') WHEN 1 THEN concat('f_', doc_id, '.docx') WHEN 2 THEN concat('f ', doc_id, '%20b+.doc') WHEN 3 THEN NULL ELSE concat('f_', doc_id % 50, '.pdf') END AS path,
          concat('  Formular  ', lang, ' ', source, '/', doc_id, ' ') AS document_name, text AS description, concat('Procedura ', doc_id % 37) AS procedure,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 37 END AS procedure_id
        FROM {{documents}}""",
    "v_procedures": f"""
        SELECT concat('', page_id) AS procedure_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE url END AS title, {pick("page_id", NAMES)} AS institution,
          CASE WHEN page_id % 3 = 0 THEN {pick("page_id", COUNTIES)} ELSE NULL END AS county, CASE WHEN page_id % 4 = 0 THEN 'Lugoj' ELSE NULL END AS city,
          concat(CASE page_id % 2 WHEN 0 THEN 'Directia X' ELSE '' END, ',Județ ', CASE page_id % 3 WHEN 0 THEN 'BUCURESTI' ELSE 'Iași' END) AS responsible
        FROM {{pages}}""",
    "v_proc_docs": """
        SELECT concat('', doc_id % 41) AS procedure_id, doc_id AS pos, concat('Document ', doc_id) AS name, doc_id % 2 = 0 AS required,
          CASE doc_id % 4 WHEN 0 THEN concat(' https://forms.example/f%20', doc_id % 50, '%2Fx.pdf') WHEN 1 THEN concat('https://forms.example/f_', doc_id % 50, '.pdf') WHEN 2 THEN 'https://forms.example/bad%zz' ELSE NULL END AS download_url,
          CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('', doc_id % 97) END AS source_doc_id
        FROM {documents}""",
    "v_templates": f"""
        SELECT concat('t', p_partkey) AS id, p_partkey AS ordinal, p_name AS name, {pick("p_partkey", NAMES)} AS organization,
          CASE WHEN p_partkey % 5 = 0 THEN {pick("p_partkey", COUNTIES)} ELSE NULL END AS county, p_partkey % 7 = 0 AS archived,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('', p_partkey % 41) END AS procedure_id,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('', p_partkey % 211) END AS source_doc_id, '2024-05-06T07:08:09Z' AS created_at
        FROM {{part}}""",
    "v_fields": """
        SELECT concat('t', l_partkey) AS template_id, l_orderkey * 10 + l_linenumber AS pos,
          CASE l_linenumber % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'dropdown' WHEN 3 THEN 'radio' ELSE 'unsupported' END AS type,
          l_returnflag = 'R' AS hidden, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Date' ELSE NULL END AS section
        FROM {lineitem}""",
    "v_form": """
        SELECT template_id, pos, min(type) AS type, min(section) AS section FROM {v_fields} GROUP BY template_id, pos""",
    "v_progress": """
        SELECT CASE p_partkey % 13 WHEN 0 THEN concat('nokey_', p_partkey) WHEN 1 THEN concat('bundle-', p_size, '/plain') ELSE concat('bundle-', p_size, '/Form_a/', p_brand, '_', p_partkey % 1500) END AS "key",
          CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('t', p_partkey + CASE WHEN p_partkey % 19 = 0 THEN 1000000 ELSE 0 END) END AS template_id, p_partkey AS ordinal
        FROM {part}""",
    "v_votes": """
        SELECT event_id % 50 AS template_id, user_id AS device_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 7 END AS value,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS comment, ts, event_id
        FROM {events}""",
    "v_elements": f"""
        SELECT CAST(floor(l_orderkey / 60) AS bigint) AS doc_id, l_linenumber % 2 AS page, (l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000 AS pos,
          CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'text' ELSE 'rect' END AS kind, {pick("l_suppkey + l_linenumber", LABELS)} AS text,
          (l_partkey * 7 + l_linenumber) % 500 AS x, CAST(l_quantity AS bigint) % 6 * 60 AS y,
          CASE l_suppkey % 3 WHEN 0 THEN 40 + l_partkey % 60 ELSE 6 + l_partkey % 12 END AS w, CASE l_suppkey % 3 WHEN 0 THEN 2 ELSE 7 + l_partkey % 9 END AS h
        FROM {{lineitem}}""",
    "v_drawn": """
        SELECT doc_id, page, pos, kind, text, x % 240 AS x, CASE WHEN pos % 4 = 0 THEN 40 ELSE 0 END + pos % 5 AS y,
          CASE WHEN kind = 'rect' AND pos % 5 = 0 THEN -w ELSE w END AS w, CASE WHEN kind = 'rect' AND pos % 3 = 0 THEN -h ELSE h END AS h
        FROM {v_elements}""",
    "v_drawings": """
        SELECT doc_id, page, pos, op, x0, y0, x0 + dx AS x1, y0 + dy AS y1
        FROM (
          SELECT doc_id, page, pos, CASE pos % 4 WHEN 0 THEN 'l' WHEN 3 THEN 'c' ELSE 're' END AS op, CAST(x % 20 AS double) * 7.25 AS x0, CAST(y AS double) + CAST(pos % 3 AS double) / 4 AS y0,
            CAST(CASE pos % 4 WHEN 0 THEN 30 + pos % 90 WHEN 1 THEN 5 + pos % 13 ELSE 20 + pos % 400 END * CASE WHEN pos % 7 = 0 THEN -1 ELSE 1 END AS double) AS dx,
            CASE pos % 4 WHEN 0 THEN CAST(pos % 5 AS double) * 0.375 WHEN 1 THEN CAST(5 + pos % 12 AS double) ELSE CAST(8 + pos % 33 AS double) END AS dy
          FROM {v_elements}) AS drawn""",
    "v_items": """
        SELECT doc_id, page, pos, text, x, y, w, h, CAST(50 + pos % 50 AS double) / 100 AS conf FROM {v_elements} WHERE kind = 'text'""",
    "v_counter_writes": """
        SELECT event_id % 50 AS template_id, event_id, ts, event_id * 7 % 6 - 1 AS up, event_id * 5 % 4 AS down FROM {events}""",
    "v_truth": """
        SELECT doc_id, page, pos, x + pos % 3 AS x, y, w + pos % 4 AS w, h FROM {v_elements} WHERE kind = 'rect'""",
    "v_detected": """
        SELECT doc_id, page, pos, x, y, w, h, CAST(50 + pos % 50 AS double) / 100 AS confidence FROM {v_elements} WHERE kind = 'rect' AND pos % 9 <> 0""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a carrier table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace('"key"', "`key`")
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in needs(name)})


def needs(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def with_views(sql: str) -> str:
    """SQL for another engine: the views that the text names in braces as common table expressions before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for t in needs(name):
                visit(t)
            order.append(name)

    for name in re.findall(r"\{(\w+)\}", sql):
        visit(name)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    heads = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not order:
        return body
    if body.upper().startswith("WITH "):
        recursive = "RECURSIVE " * body.upper().startswith("WITH RECURSIVE ")
        return f"WITH {recursive}{heads},\n{body[5 + len(recursive):]}"
    return f"WITH {heads}\n{body}"
