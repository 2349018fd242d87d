"""The registered queries, and the same in DuckDB's SQL where SQL can say it."""

from . import files, ranking, reports, retrieval, stats, streams

QUERIES = {**stats.QUERIES, **retrieval.QUERIES, **ranking.QUERIES, **streams.QUERIES, **files.QUERIES, **reports.QUERIES}
ORACLES = {**stats.ORACLES, **retrieval.ORACLES, **ranking.ORACLES, **streams.ORACLES, **files.ORACLES, **reports.ORACLES}
