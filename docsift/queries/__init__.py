"""Queries over the standard tables with their DuckDB twins."""

from docsift.queries import batch, models, pages, text

QUERIES = text.QUERIES | pages.QUERIES | models.QUERIES | batch.QUERIES
ORACLES = text.ORACLES | pages.ORACLES | models.ORACLES | batch.ORACLES
