"""Training-data operators: one module per operator, queries in :mod:`loam.llm.queries`."""
