"""All registered queries of the library's own operators and the SQL that gives the same rows."""

from corpusloom.jobs import answering, extraction, retrieval, website

MODULES = [retrieval, extraction, answering, website]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
