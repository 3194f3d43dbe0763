"""Registered queries and, where one exists, the SQL text that must give the same rows."""
from kinweave.sources.tables import DOMAIN_SQL, Tables

QUERIES, ORACLES = {}, {}


def query(name, sql=None, ctes="", recursive=False):
    """Register a function Tables -> DataFrame under an operator id."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            head = "WITH RECURSIVE " if recursive or "RECURSIVE" in ctes else "WITH "
            ORACLES[name] = head + DOMAIN_SQL + (",\n" + ctes.strip().rstrip(",") if ctes else "") + "\n" + sql.strip()
        return fn
    return register
