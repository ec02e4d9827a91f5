"""Training-data operators. Nothing else in ``docsift`` imports this subpackage."""
