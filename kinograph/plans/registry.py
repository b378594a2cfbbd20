"""Registered queries and the SQL each is checked against."""

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, floats: tuple = ()):
    """Register a query. ``floats`` names integer columns that may be NULL: both sides
    return them as doubles, since data frames have no nullable integer."""
    def add(fn):
        run = fn
        if floats:
            def run(spark, d):
                return fn(spark, d).withColumns({c: F.col(c).cast("double") for c in floats})
        assert name not in QUERIES, name
        run.family = fn.__module__
        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in floats)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if floats else sql
        return run
    return add
