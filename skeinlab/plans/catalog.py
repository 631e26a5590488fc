"""Every query over the driver tables, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from skeinlab.plans import extra_queries, graph_queries, metric_queries, program_queries, read_queries

QUERIES = {**read_queries.QUERIES, **metric_queries.QUERIES, **graph_queries.QUERIES, **extra_queries.QUERIES, **program_queries.QUERIES}
ORACLES = {**read_queries.ORACLES, **metric_queries.ORACLES, **graph_queries.ORACLES, **extra_queries.ORACLES, **program_queries.ORACLES}
