"""Queries over the given tables, by subject: each module has QUERIES and ORACLES."""

from docspark.plans import documents, ingest, retrieval, scalars, sessions

MODULES = (documents, ingest, retrieval, scalars, sessions)
