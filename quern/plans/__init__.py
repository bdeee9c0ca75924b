"""Registered queries: each a Spark plan over the test tables, with its SQL where SQL can say it."""

from quern.plans import core, ingest, ledger, registry, sessions, statements

QUERIES = {**registry.QUERIES, **core.QUERIES}
SQL = {**registry.SQL, **core.SQL}
__all__ = ["QUERIES", "SQL", "core", "ingest", "ledger", "sessions", "statements"]
