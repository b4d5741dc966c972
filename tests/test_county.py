"""County resolution: known cases of each rule."""

import pytest
from pyspark.sql import functions as F

from civicforms.operators import county

CANONICAL = [
    ("București", "Bucuresti"), ("Bistrița-Năsăud", "Bistrita-Nasaud"), ("Iași", "Iasi"), ("CLUJ", "Cluj"), ("cluj", "Cluj"), ("Cluj", "Cluj"),
    ("Atlantis", None), ("", None), (None, None),
]
TEMPLATE = [
    (("București", None, "x"), "Bucuresti"), (("Bucuresti", None, "x"), "Bucuresti"), (("Municipiul București", None, "x"), "Bucuresti"), (("Atlantis", None, "x"), "Atlantis"),
    ((None, None, "no hints"), county.TEMPLATE_NATIONAL), ((None, "Primaria Municipiului Lugoj", "x"), "Timis"), ((None, "Primaria Onesti", "x"), "Bacau"), ((None, "Primaria Pitesti", "x"), "Arges"),
    ((None, "Ministerul Agriculturii si Dezvoltării Rurale", "x"), "Bucuresti"), ((None, "Agentia Nationala de Administrare Fiscala", "x"), "Bucuresti"), ((None, "Primaria Sectorului 3", "x"), "Bucuresti"),
    (("Național", "Colegiul Farmaciștilor din România", "x"), county.TEMPLATE_NATIONAL), (("National", "Colegiul Farmaciștilor din România", "x"), county.TEMPLATE_NATIONAL),
]
PROCEDURE = [
    (("București", "x", None, None), "Bucuresti"), (("CLUJ", "x", None, None), "Cluj"), ((None, "Primaria Municipiului Lugoj", "Lugoj", None), "Timis"),
    ((None, "Primaria Onesti", None, None), "Bacau"), ((None, "Primaria Pitesti", None, None), "Arges"), ((None, "Ministerul Agriculturii si Dezvoltării Rurale", None, None), "Național"),
    ((None, "Agentia Nationala de Administrare Fiscala", None, None), "Național"), ((None, "Ministerul Justitiei", None, "Ministerul Justitiei,Județ BUCURESTI"), "Național"),
    ((None, "Inspectoratul de Stat in Constructii - I.S.C", None, "ISC,Județ BUCURESTI"), "Național"), (("Constanta", "Ministerul Apararii Nationale - Spitalul Militar Constanta", None, None), "Constanta"),
    (("Național", "Colegiul Farmaciștilor din România", None, None), "Național"), ((None, "Some unknown entity", None, None), "Național"),
]


def test_canonicalize(spark):
    df = spark.createDataFrame([(a,) for a, _ in CANONICAL], "a string")
    assert [r[0] for r in df.select(county.canonicalize_county(F.col("a"))).collect()] == [b for _, b in CANONICAL]


@pytest.mark.parametrize(("cases", "keys", "resolve"), [(TEMPLATE, ["county", "organization", "name"], county.with_template_county), (PROCEDURE, ["county", "institution", "city", "responsible"], county.with_procedure_county)])
def test_buckets(spark, cases, keys, resolve):
    df = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} string" for k in keys))
    found = {r["i"]: r["county_bucket"] for r in resolve(df).collect()}
    assert [found[i] for i in range(len(cases))] == [w for _, w in cases]
