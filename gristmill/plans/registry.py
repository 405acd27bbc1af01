"""All queries of the core and their SQL."""

from gristmill.plans import catalog, documents, drift, evaluation, relational, search, streams, timeseries

MODULES = (search, drift, catalog, documents, evaluation, timeseries, relational, streams)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
