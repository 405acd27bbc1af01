"""gristmill: document, table, retrieval and series analytics as Spark jobs."""
