"""Every registered query with its oracle SQL, gathered from the plan modules."""

from . import books, catalog, derivations, facets, feed, grids, kernels, lives, lookups, merges, outlines, questions, records, retrieval, review, rollups, scalars, search, sequences, sinks

MODULES = [search, catalog, facets, lives, books, grids, rollups, sequences, merges, retrieval, kernels, derivations, questions, outlines, lookups, scalars, feed, review, sinks, records]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
