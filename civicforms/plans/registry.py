"""All registered queries of the forms library, with their SQL."""

from civicforms.plans import detection, queries  # noqa: F401  importing registers

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
